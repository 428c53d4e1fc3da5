"""URL filters: lists of rules first, then the reputation of the page's host.

Labelled pages give each host a number of outcomes and of bad ones.  A host's bad rate has a beta prior whose mean
is the posterior mean of its registered domain, a domain's that of its suffix, and a suffix's the rate over all.
The prior's strength at each level is estimated from the counts themselves: the spread of the groups around their
priors beyond what chance gives (method of moments for the beta-binomial law).  So a host with many labelled pages
stands on its own, and one with few or none is judged by its domain.  A page is blocked if the bad rate of its host
lies above ``LIMIT`` with a posterior chance of at least ``SURE``, that is, if the lower posterior bound does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

#: Fixed rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level names that form a suffix together with a country's two letters.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
LIMIT = 0.5
SURE = 0.9
WEAKEST, STRONGEST = 0.5, 1e-4      # correlation of two outcomes of a group: the limits of its estimate
STEPS = 100                         # Simpson intervals on either side of the limit
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix_of(host: str) -> Column:
    """The last name of a host, or the last two under a country's second level; an address of digits as it is.

    A user name, a port and dots at the end are left out."""
    names = F.split(_bare(host), r"\.")
    last, second = F.element_at(names, -1), F.try_element_at(names, F.lit(-2))
    joined = F.concat_ws(".", second, last)
    return (F.when(_bare(host).rlike(r"^[0-9.]*$"), _bare(host))
            .when((F.length(last) == 2) & second.isin(*SECOND), joined).otherwise(last))


def domain_of(host: str, suffix: str) -> Column:
    """The suffix with the name before it; the suffix alone if there is none."""
    names = F.split(_bare(host), r"\.")
    width = F.size(F.split(F.col(suffix), r"\.")) + 1
    own = F.concat_ws(".", F.slice(names, F.greatest(F.size(names) - width + 1, F.lit(1)), width))
    return F.when(_bare(host) == F.col(suffix), F.col(suffix)).otherwise(own)


def _bare(host: str) -> Column:
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")


def rule_of(host: str, path: str, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of rules of one length that fit
    the same url, that of the longer host counts, and ``block`` before ``allow``."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in reversed(order):
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """Rows ``(page, bad)`` from ``labels (doc_id, quality, toxic)``: 1 if any row of the page says quality 0 or
    toxic 1, 0 if all that is known speaks for it.  Rows without id or without both labels say nothing."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return (labels.where("doc_id is not null").select(F.col("doc_id").alias("page"), bad.alias("bad"))
            .where("bad is not null").groupBy("page").agg(F.max("bad").alias("bad")))


def _strength(groups: DataFrame) -> float:
    """The prior's strength for ``groups (n, x, prior)``: what spread of x there is beyond chance."""
    chance = F.col("prior") * (1 - F.col("prior"))
    beyond = F.pow(F.col("x") - F.col("n") * F.col("prior"), 2.0) - F.col("n") * chance
    row = groups.agg(F.sum(beyond).alias("beyond"),
                     F.sum(F.col("n").cast("double") * (F.col("n") - 1) * chance).alias("room")).first()
    between = row["beyond"] / row["room"] if row["room"] else WEAKEST
    return 1 / min(max(between, STRONGEST), WEAKEST) - 1


def _log_density(u: str) -> str:
    """Logarithm of Beta(a, b) at log-odds ``u``, but for a constant."""
    return f"(a*{u} - (a + b)*(greatest({u}, 0D) + ln(1 + exp(-abs({u})))))"


def _mass(low: str, high: str) -> str:
    """The density's integral by Simpson's rule over ``STEPS`` intervals."""
    weight = f"case when i = 0 or i = {STEPS} then 1D when i % 2 = 1 then 4D else 2D end"
    at = f"({low} + ({high} - {low})*i/{STEPS}D)"
    height = f"exp({_log_density(at)} - {_log_density('middle')})"
    return f"({high} - {low})*aggregate(sequence(0, {STEPS}), 0D, (s, i) -> s + ({weight})*{height})"


def over_limit(groups: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``groups (a, b, ...)`` with ``over``: the chance that a rate of law Beta(a, b) is over ``limit``.

    On the scale of log-odds the density falls off smoothly on both sides, so Simpson's rule within 12 deviations
    of the middle, cut at the limit, is exact to six places, or to four where a or b is below 1."""
    edge = math.log(limit / (1 - limit))
    return (groups.withColumn("middle", F.expr("ln(a/b)"))
            .withColumn("reach", F.expr("12*sqrt(1/a + 1/(a*a) + 1/b + 1/(b*b))"))
            .withColumn("edge", F.expr(f"least(greatest({edge!r}D, middle - reach), middle + reach)"))
            .withColumn("above", F.expr(_mass("edge", "(middle + reach)")))
            .withColumn("below", F.expr(_mass("(middle - reach)", "edge")))
            .withColumn("over", F.expr("above/(above + below)"))
            .drop("middle", "reach", "edge", "above", "below"))


def reputations(pages: DataFrame, bad: DataFrame, limit: float = LIMIT, sure: float = SURE) -> DataFrame:
    """One row per host of ``pages (page, host)``: its labelled pages ``n``, the bad ones ``x``, the posterior's
    ``a`` and ``b``, ``over`` (the chance that its bad rate is over ``limit``) and ``verdict``.

    ``bad`` has ``(page, bad)``, one row per page.  Every row of a repeated page counts.  Hosts without labelled
    pages stand where their domain does; without any labels all hosts are allowed."""
    known = lookup(pages, bad, {"page": "page"}, ["bad"])
    hosts = known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = hosts.withColumn("suffix", suffix_of("host"))
    hosts = cut_lineage(hosts.withColumn("domain", domain_of("host", "suffix")))
    counts = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(*counts))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(*counts))
    total = suffixes.agg(*counts).first()
    rate = ((total["x"] or 0) + 1) / ((total["n"] or 0) + 2)

    def posterior(groups: DataFrame) -> DataFrame:
        k = _strength(groups)
        return (groups.withColumn("a", k * F.col("prior") + F.col("x"))
                .withColumn("b", k * (1 - F.col("prior")) + F.col("n") - F.col("x")))

    def below(groups: DataFrame, key: str, parents: DataFrame) -> DataFrame:
        means = parents.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
        return posterior(cut_lineage(lookup(groups, means, [key], ["prior"])))

    suffixes = posterior(suffixes.withColumn("prior", F.lit(rate)))
    hosts = below(hosts, "domain", below(domains, "suffix", suffixes))
    judged = over_limit(hosts, limit)
    return judged.withColumn("verdict", F.when(F.col("over") >= sure, "block").otherwise("allow"))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, limit: float = LIMIT, sure: float = SURE,
           page: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    A url that is null or has no ``://`` has an empty host and path; no rule fits it, and such pages are judged
    together as one host.  Repeated pages and urls are judged row by row, and alike; null ids take no label.
    Long urls are read whole.  Other columns, also of names used here, are left aside; empty tables give none."""
    rows = pages.select(F.col(page).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = reputations(rows.select(F.col("page_id").alias("page"), "host"), outcomes(labels), limit, sure)
    rule, verdict = rule_of("host", "path", rules)
    placed = lookup(rows, hosts.select("host", F.col("verdict").alias("own")), ["host"], ["own"])
    return placed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"))


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(pages, labels)


REPORT_SQL = r"""
with rows as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
marks as (
  select doc_id, max(greatest((quality = 0)::int, (toxic = 1)::int)) as bad
  from labels where doc_id is not null group by doc_id),
counted as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as x,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') as bare
  from rows left join marks on doc_id = page_id group by host),
named as (
  select *, string_split(bare, '.') as names,
         case when regexp_full_match(bare, '[0-9.]*') then bare
              when len(string_split(bare, '.')[-1]) = 2 and len(string_split(bare, '.')) > 1
                and string_split(bare, '.')[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
              then string_split(bare, '.')[-2] || '.' || string_split(bare, '.')[-1]
              else string_split(bare, '.')[-1] end as suffix from counted),
hosts as (
  select host, n, x, suffix, case when bare = suffix then suffix else array_to_string(
    names[greatest(len(names) - len(string_split(suffix, '.')), 1):], '.') end as domain from named),
domains as (select domain, suffix, sum(n) as n, sum(x) as x from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(x) as x,
                    (sum(sum(x)) over () + 1)::double / (sum(sum(n)) over () + 2) as prior
             from domains group by suffix),
s1 as (select *, sum(pow(x - n*prior, 2) - n*prior*(1 - prior)) over () as beyond,
              sum(n::double*(n - 1)*prior*(1 - prior)) over () as room from suffixes),
s2 as (select *, 1/least(greatest(case when room <> 0 then beyond/room else 0.5 end, 1e-4), 0.5) - 1 as k from s1),
s3 as (select suffix, (k*prior + x)/(k + n) as prior from s2),
d1 as (select d.*, prior from domains d join s3 using (suffix)),
d2 as (select *, sum(pow(x - n*prior, 2) - n*prior*(1 - prior)) over () as beyond,
              sum(n::double*(n - 1)*prior*(1 - prior)) over () as room from d1),
d3 as (select *, 1/least(greatest(case when room <> 0 then beyond/room else 0.5 end, 1e-4), 0.5) - 1 as k from d2),
d4 as (select domain, (k*prior + x)/(k + n) as prior from d3),
h1 as (select h.host, h.n, h.x, prior from hosts h join d4 using (domain)),
h2 as (select *, sum(pow(x - n*prior, 2) - n*prior*(1 - prior)) over () as beyond,
              sum(n::double*(n - 1)*prior*(1 - prior)) over () as room from h1),
h3 as (select *, 1/least(greatest(case when room <> 0 then beyond/room else 0.5 end, 1e-4), 0.5) - 1 as k from h2),
h4 as (select host, k*prior + x as a, k*(1 - prior) + n - x as b from h3),
h5 as (select *, ln(a/b) as middle, 12*sqrt(1/a + 1/(a*a) + 1/b + 1/(b*b)) as reach from h4),
h6 as (select *, least(greatest(0.0, middle - reach), middle + reach) as edge from h5),
steps as (select unnest(range(0, 101)) as i),
h7 as (
  select host, a, b, middle, edge, i, reach, case when i in (0, 100) then 1.0 when i % 2 = 1 then 4.0 else 2.0 end as w,
         edge + (middle + reach - edge)*i/100 as u, middle - reach + (edge - middle + reach)*i/100 as v
  from h6, steps),
h8 as (
  select host, max(middle + reach - edge)*sum(w*exp(
           a*u - (a + b)*(greatest(u, 0) + ln(1 + exp(-abs(u))))
           - a*middle + (a + b)*(greatest(middle, 0) + ln(1 + exp(-abs(middle)))))) as above,
         max(edge - middle + reach)*sum(w*exp(
           a*v - (a + b)*(greatest(v, 0) + ln(1 + exp(-abs(v))))
           - a*middle + (a + b)*(greatest(middle, 0) + ln(1 + exp(-abs(middle)))))) as below
  from h7 group by host),
own as (select host, case when above/(above + below) >= 0.9 then 'block' else 'allow' end as verdict from h8),
rules(kind, name, start) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls as (select distinct host, path from rows),
fits as (
  select host, path, arg_max(name || start, len(name || start)) as rule, arg_max(kind, len(name || start)) as kind
  from urls join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start)
  group by host, path)
select r.page_id, r.host, r.path, f.rule, coalesce(f.kind, o.verdict) as verdict
from rows r join own o on o.host = r.host
left join fits f on f.host = r.host and f.path = r.path
"""
