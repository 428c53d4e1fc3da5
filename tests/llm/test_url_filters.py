"""URL filters: parsing, rules, and reputations against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import url_filters as uf

PAGES = "page_id long, url string, html string, host string, own string"
LABELS = "doc_id long, quality int, toxic int"


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u in enumerate(urls)], PAGES)


def judged(spark, urls, labels=()):
    out = uf.judged(pages_of(spark, urls), spark.createDataFrame(list(labels), LABELS)).collect()
    return {r["page_id"]: r for r in out}


def test_parts(spark):
    cases = [
        ("HTTP://Www.ÄB.com:80/A?x#y", "www.Äb.com:80", "/A"), ("http://a.org", "a.org", ""), ("a.org/x", "", ""),
        ("x://a.org?u=http://b.net/p", "a.org", ""), ("x://a.org#f/g", "a.org", ""), ("", "", ""), (None, "", ""),
        ("x:///p", "", "/p"), ("://a\n.org/p\nq", "a\n.org", "/p\nq"),
        ("x://a.org/" + "p" * 50_000, "a.org", "/" + "p" * 50_000)]
    rows = judged(spark, [url for url, _, _ in cases])
    assert [(rows[i]["host"], rows[i]["path"]) for i in range(len(cases))] == [c[1:] for c in cases]


def test_longest_rule(spark):
    cases = [
        ("http://a.com/x", "com/", "allow"), ("http://a.com", None, "allow"),
        ("http://m.example.com/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com/en/", "allow"),
        ("http://w.www.example.com/en/", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/", "com/", "allow"), ("http://a.net/es/1", "net/es/", "block"),
        ("http://a.net/es", None, "allow"), ("http://net/fr/", "net/fr/", "block"),
        ("http://a.net/de/fr/", None, "allow"), ("a.com/x", None, "allow")]
    rows = judged(spark, [url for url, _, _ in cases])
    assert [(rows[i]["rule"], rows[i]["verdict"]) for i in range(len(cases))] == [c[1:] for c in cases]


def test_names(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.y.org": ("org", "y.org"), "org": ("org", "org"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"),
             "u@a.b.de.": ("de", "b.de"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("s", uf.suffix_of("host"))
    found = {r["host"]: (r["s"], r["d"]) for r in frame.withColumn("d", uf.domain_of("host", "s")).collect()}
    assert found == hosts


def chance_over(a, b, limit):
    """By a fine trapezoid rule on either side of the limit, on log-odds."""
    middle, edge = math.log(a / b), math.log(limit / (1 - limit))
    reach = 40 * math.sqrt(1 / a + 1 / a**2 + 1 / b + 1 / b**2)

    def mass(low, high):
        u = np.linspace(low, max(low, high), 400_001)
        softplus = np.logaddexp(0, u) - np.logaddexp(0, middle)
        return np.trapezoid(np.exp(a * (u - middle) - (a + b) * softplus), u)
    above, below = mass(max(edge, middle - reach), middle + reach), mass(middle - reach, min(edge, middle + reach))
    return above / (above + below)


def test_posterior_chance(spark):
    laws = [(0.2, 0.7), (1.0, 1.0), (3.0, 9.0), (60.5, 50.0), (5e5, 5.01e5), (9e3, 10.0), (10.0, 9e3)]
    for row in uf.over_limit(spark.createDataFrame(laws, "a double, b double")).collect():
        assert row["over"] == pytest.approx(chance_over(row["a"], row["b"], 0.5), abs=1e-4), row


def plain(counts, limit, sure):
    """Verdicts of ``{(suffix, domain, host): (n, x)}`` by loops."""
    def posterior(groups, prior):
        spread = sum((x - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, x) in groups.items())
        room = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, x) in groups.items())
        k = 1 / min(max(spread / room if room else 0.5, 1e-4), 0.5) - 1
        return {g: (k * prior[g] + x, k * (1 - prior[g]) + n - x) for g, (n, x) in groups.items()}

    def total(depth):
        out = {}
        for key, (n, x) in counts.items():
            old = out.get(key[:depth], (0, 0))
            out[key[:depth]] = (old[0] + n, old[1] + x)
        return out
    n, x = total(0).get((), (0, 0))
    means = {(): (x + 1) / (n + 2)}
    for depth in (1, 2, 3):
        groups = total(depth)
        laws = posterior(groups, {g: means[g[:-1]] for g in groups})
        means = {g: a / (a + b) for g, (a, b) in laws.items()}
    return {g[2]: "block" if chance_over(a, b, limit) >= sure else "allow" for g, (a, b) in laws.items()}


def test_reputations_follow_the_plain_version(spark):
    plan = {("org", "spam.org", "a.spam.org"): (30, 28), ("org", "spam.org", "b.spam.org"): (12, 11),
            ("org", "spam.org", "new.spam.org"): (0, 0), ("org", "spam.org", "good.spam.org"): (200, 3),
            ("org", "fine.org", "fine.org"): (50, 2), ("org", "fine.org", "one.fine.org"): (1, 1),
            ("de", "x.de", "x.de"): (40, 4), ("de", "y.de", "y.de"): (3, 3), ("", "", ""): (2, 0)}
    urls, labels = [], []
    for (_, _, host), (n, x) in plan.items():
        for i in range(max(n, 1)):
            if i < n:
                labels.append((len(urls), 0 if i < x and i % 2 else 1, int(i < x and not i % 2)))
            urls.append(f"http://{host}/p{i}" if host else "none")
    labels += [(0, 1, 0), (None, 0, 1), (10**6, 0, 1), (3, None, None)]
    got = judged(spark, urls, labels)
    assert {r["host"]: r["verdict"] for r in got.values()} == plain(plan, uf.LIMIT, uf.SURE)
    verdicts = {r["host"]: r["verdict"] for r in got.values()}
    assert verdicts["a.spam.org"] == "block" and verdicts["fine.org"] == verdicts["good.spam.org"] == "allow"
    assert len(got) == len(urls)


def test_empty_tables_and_repeats(spark):
    assert judged(spark, []) == {}
    twice = pages_of(spark, ["http://a.de/x"] * 2).withColumn("page_id", F.lit(None).cast("long"))
    rows = uf.judged(twice, spark.createDataFrame([(None, 0, 1)], LABELS)).collect()
    assert [r["verdict"] for r in rows] == ["allow"] * 2
