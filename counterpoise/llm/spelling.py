"""Spelling variants: near words found in a reduced alphabet.

Letters are hashed to a few symbols.  One edit of a word is at most one edit of its reduced form, so two near words
have reduced forms that are equal or one edit apart.  Each reduced word generates its whole one-edit neighbourhood
(with few symbols that is a short list, whatever the alphabet), which is joined with the reduced vocabulary; the
words behind the reduced forms that meet are then compared themselves.  All of this works on distinct words; texts
are read once, to count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

#: Fixed: letters are a-z (A-Z lower-cased) and the code points U+00C0 to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = 8             # a letter's symbol is its code point modulo this; common letters spread evenly
LONG = 40               # longer words have no neighbourhoods: those grow with the square of the length
SHORTEST = 6
LEAST = 5
SLIP = 199
RATIO = 5


def words_in(docs: DataFrame, key: str, text: str, shortest: int = SHORTEST, slip: int = SLIP) -> DataFrame:
    """One row ``word`` per run of letters whose result has at least ``shortest`` letters.

    With ``h`` the crc32 of ``<key>:<run>``, a run whose ``h`` is divisible by ``slip`` loses its letter at
    ``h % length`` (a planted slip).  Runs are maximal, so shorter ones can be passed over by the pattern."""
    run = F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), run)
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    hashed = (runs.select("key", lower.alias("run"))
              .withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (hashed.select(F.when(F.pmod("h", F.lit(slip)) == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= shortest))


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows ``(word, n)`` of words that occur at least ``least`` times."""
    return words.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def reduced(word: str | Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter replaced by its symbol; other characters stay."""
    return F.translate(word, LETTERS, "".join(chr(ord("a") + ord(c) % symbols) for c in LETTERS))


def neighbourhood(word: str, symbols: int = SYMBOLS) -> Column:
    """The reduced word itself and all that one edit makes of it, each once."""
    alphabet = F.array(*[F.lit(chr(ord("a") + i)) for i in range(symbols)])
    size = F.length(word)
    before = lambda i: F.substring(F.col(word), F.lit(1), i)                # noqa: E731
    after = lambda i: F.substring(F.col(word), i + 1, size)                 # noqa: E731
    places, gaps = F.sequence(F.lit(0), size - 1), F.sequence(F.lit(0), size)
    deleted = F.transform(places, lambda i: F.concat(before(i), after(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        alphabet, lambda s: F.concat(before(i), s, after(i + 1)))))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(
        alphabet, lambda s: F.concat(before(i), s, after(i)))))
    return F.array_distinct(F.concat(F.array(F.col(word)), deleted, replaced, inserted))


def near_words(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """Rows ``(word, n, other, other_n)`` of all words of ``words (word, n)`` that differ by one inserted, deleted or
    replaced code point, each pair from both sides.  Words are distinct, not null and not empty.

    Two words of more than ``long`` letters, one edit apart, have their first or their last ``long // 2`` letters in
    common and are found by those.  Pairs stream out of the last joins; what reads them should aggregate."""
    known = cut_lineage(words.select("word", "n", reduced("word", symbols).alias("form")))
    size = lambda word: F.length(word)                                      # noqa: E731
    short = known.where(size("word") <= long + 1)
    forms = short.select("form").distinct()
    meets = (forms.withColumn("reach", F.explode(neighbourhood("form", symbols)))
             .join(forms.select(F.col("form").alias("reach")), "reach"))
    here = meets.join(short, "form").select("word", "n", "reach")
    there = short.select(F.col("form").alias("reach"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    by_form = here.join(there, "reach").where(F.least(size("word"), size("other")) <= long)

    half = long // 2
    ends = known.where(size("word") > long).select("word", "n", F.explode(F.array(
        F.concat(F.lit("<"), F.substring("word", 1, half)), F.concat(F.lit(">"), F.substring("word", -half, half))
    )).alias("reach"))
    others = ends.select("reach", F.col("word").alias("other"), F.col("n").alias("other_n"))
    first = F.col("reach").startswith("<") | (F.substring("word", 1, half) != F.substring("other", 1, half))
    by_end = ends.join(others, "reach").where(first)
    columns = ["word", "n", "other", "other_n"]
    return by_form.select(columns).union(by_end.select(columns)).where(F.levenshtein("word", "other", 1) == 1)


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms (word, form, ...)`` with ``root``: what following the forms ends at.

    Every step's word is more frequent, so there are no circles; steps are doubled each round, and rounds end when
    nothing moves.  Words without form are their own root."""
    ends = cut_lineage(forms.select("word", F.col("form").alias("to")).where("to is not null"))
    while True:
        far = ends.select("word", F.col("to").alias("next"))
        moved = cut_lineage(lookup(ends, far, {"to": "word"}, ["next"], stored=True))
        if moved.where("next is not null").isEmpty():
            break
        ends = cut_lineage(moved.select("word", F.coalesce("next", "to").alias("to")))
    rooted = lookup(forms, ends, ["word"], ["to"], unique_left=True, stored=True)
    return rooted.withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """``words (word, n)`` with ``n_near`` (near words, 0 if none), ``form`` (the near word of largest n, the first
    in code point order of several, if its n is at least ``ratio`` times the word's; else null), ``form_n`` and
    ``root``.  Other columns are left aside; an empty table gives none."""
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other", "other_n")).alias("best")
    near = near_words(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = lookup(cut_lineage(words.select("word", "n")), near, ["word"], ["n_near", "best"], unique_left=True)
    enough = F.col("best.other_n") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(enough, F.col("best.other")).alias("form"),
                           F.when(enough, F.col("best.other_n")).alias("form_n"))
    return with_roots(cut_lineage(formed))


def report(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of ``docs (doc_id, text)``; every text is read whole.

    Null and empty texts have no words; a null doc_id counts as empty in the hash; repeated rows count again."""
    words = cut_lineage(vocabulary(words_in(docs, "doc_id", "text")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The same by plain means: crc32 byte by byte, pairs by words with one letter left out or masked.
REPORT_SQL = r"""
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
each as (select doc_id, run, count(*) as times from runs group by doc_id, run),
crc as (
  select list(v order by i) as remainders from (
    select i, list_reduce(range(0, 9), lambda c, k: case when k = 0 then c when c % 2 = 1
             then xor(c // 2, 3988292384) else c // 2 end, i) as v
    from (select unnest(range(0, 256)) as i))),
bytes as (
  select run, times, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as digits from each),
hashed as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
      range(0, (len(digits) // 2)::bigint), lambda i: ('0x' || substr(digits, (2*i + 1)::bigint, 2))::bigint)),
    lambda c, b: xor(c // 256, remainders[(xor(c, b) % 256 + 1)::bigint]))) as h
  from bytes, crc),
slipped as (
  select times, case when h % 199 = 0 then substr(run, 1, (h % len(run))::bigint) || substr(run, (h % len(run) + 2)::bigint)
                     else run end as word from hashed),
words as (
  select word, sum(times)::bigint as n from slipped where len(word) >= 6 group by word having sum(times) >= 5),
places as (select word, n, unnest(range(1, len(word) + 1)) as i from words),
masks as (
  select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as mask,
         substr(word, 1, i - 1) || substr(word, i + 1) as shorter from places),
near as (
  select a.word, b.word as other, b.n as other_n from masks a join masks b on a.mask = b.mask where a.word <> b.word
  union
  select a.word, b.word, b.n from masks a join words b on a.shorter = b.word
  union
  select b.word, a.word, a.n from masks a join words b on a.shorter = b.word),
best as (
  select word, count(*)::bigint as n_near, arg_min(other, (-other_n, other)) as form, max(other_n) as form_n
  from near group by word),
formed as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 5*w.n then b.form end as form,
         case when b.form_n >= 5*w.n then b.form_n end as form_n
  from words w left join best b on b.word = w.word),
steps as (
  select word, word as here, 0 as step from formed
  union all
  select s.word, f.form, s.step + 1 from steps s join formed f on f.word = s.here where f.form is not null),
roots as (select word, arg_max(here, step) as root from steps group by word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join roots r on r.word = f.word
"""
