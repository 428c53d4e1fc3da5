"""Spelling variants against loops over all pairs."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from counterpoise.llm import spelling

DOCS = "doc_id long, text string, word string, n string, form string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = sorted((v for v in words if one_apart(w, v)), key=lambda v: (-words[v], v))
        if near and words[near[0]] >= 5 * n:
            forms[w] = near[0]
        out[w] = (n, len(near))
    def root(w):
        while w in forms:
            w = forms[w]
        return w
    return {(w, forms.get(w), root(w), n, near, words.get(forms.get(w))) for w, (n, near) in out.items()}


def rows_of(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_report_is_the_plain_version(spark):
    draw = random.Random(3)
    stems = ["garden", "Straße", "éclair", "ÀÉÎÕÜß", "letter", "bananas", "a×b÷cd"]
    texts = [None, "", "  ", "short one two"]
    for _ in range(150):
        words = []
        for _ in range(draw.randrange(1, 60)):
            w = draw.choice(stems)
            while draw.random() < 0.25:
                i = draw.randrange(len(w) + 1)
                w = draw.choice([w[:i] + draw.choice("aeé") + w[i:], w[:i] + w[i + 1:], w[:i] + draw.choice("nß") + w[i + 1:]])
            words.append(w if draw.random() < 0.8 else w.upper())
        texts.append(draw.choice([" ", "-", "1", "\n"]).join(words))
    giants = ["x" * n + "y" * (n % 7) for n in range(36, 45)]
    texts += ["verylong" * 1_000] * 5 + [("verylong" * 1_000 + "s ") * 30] + [" ".join(giants + [g + "z" for g in giants])] * 6 + ["garden " * 20_000]
    ids = list(range(len(texts)))
    ids[5:9] = [None, None, 7, 7]
    expected = plain_variants(plain_words(zip(ids, texts)))
    frame = spelling.report(docs_of(spark, texts, ids))
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert frame.count() == len(expected) and rows_of(frame) == expected
    assert any(form for _, form, *_ in expected)


def test_slips_happen(spark):
    words = spelling.words_in(docs_of(spark, ["garden"] * 3000), "doc_id", "text").groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in words} == {
        "garden": sum(zlib.crc32(f"{i}:garden".encode()) % 199 != 0 for i in range(3000))}
    longer = spelling.words_in(docs_of(spark, ["gardens"] * 3000), "doc_id", "text").groupBy("word").count().collect()
    assert {r["word"] for r in longer} > {"gardens"}


def test_reduced_words_meet(spark):
    """Any one edit stays in the neighbourhood of the reduced word."""
    draw, pairs = random.Random(1), []
    for _ in range(300):
        w = "".join(draw.choice(spelling.LETTERS) for _ in range(draw.randrange(1, 12)))
        i, c = draw.randrange(len(w) + 1), draw.choice(spelling.LETTERS)
        pairs.append((w, draw.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:] or c])))
    frame = spark.createDataFrame(pairs, "a string, b string").select(
        spelling.reduced("a").alias("a"), spelling.reduced("b").alias("b"))
    assert frame.where(~F.array_contains(spelling.neighbourhood("a"), F.col("b"))).count() == 0


def test_chains_and_ties(spark):
    words = {"aaaaaa": 10_000, "aaaaab": 2_000, "aaaabb": 400, "aaabbb": 80, "aabbbb": 16, "abbbbb": 3,
             "cccccc": 5, "ccccca": 30, "cccccb": 30, "zzzzzz": 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r["word"]: r for r in spelling.variants(frame).collect()}
    assert found["abbbbb"]["root"] == "aaaaaa" and found["abbbbb"]["form"] == "aabbbb"
    assert found["cccccc"]["form"] == "ccccca" and found["ccccca"]["form"] is None
    assert (found["zzzzzz"]["root"], found["zzzzzz"]["n_near"]) == ("zzzzzz", 0)


def test_empty_table(spark):
    assert spelling.report(docs_of(spark, [])).count() == 0
