"""Alignment of two tokenizers against loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from counterpoise.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
DOCS = "doc_id long, text string, block string, place string, key string, pair string, docs string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, *"vwxyz") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def plain():
    a_of = Tokenizer.from_file(PATHS[0])
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def cut(text):
        """Links and groups of one text; None without tokens."""
        if not text:
            return None
        a = a_of.encode(" " + text, add_special_tokens=False)
        b = b_of.encode(text)
        pieces = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in ((i, b_of.id_to_piece(i)) for i in b)]
        if b"".join(pieces) != (" " + text).encode():
            return None
        letters = alignment._byte_letters()
        sizes = [len(bytes(letters[c] for c in a_of.id_to_token(i))) for i in a.ids]
        links, groups, x, y = [], [], 0, 0
        ends_a, ends_b = np.cumsum(sizes).tolist(), np.cumsum([len(p) for p in pieces]).tolist()
        fresh = True
        while x < len(a.ids):
            if fresh:
                groups.append(([a.ids[x]], [b[y]]))
            links.append((a.ids[x], b[y]))
            fresh = ends_a[x] == ends_b[y]
            step_a, step_b = ends_a[x] <= ends_b[y], ends_b[y] <= ends_a[x]
            x, y = x + step_a, y + step_b
            if not fresh:
                groups[-1][0 if step_a else 1].append(a.ids[x] if step_a else b[y])
        return links, groups, len(a.ids), len(b)
    return cut


def expected(cut, texts):
    each = [cut(t) for t in texts]
    counts = Counter(link for e in each if e for link in e[0])
    most = defaultdict(int)
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, e in enumerate(each):
        if e is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links, groups, n_a, n_b = e
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts, each


def test_report_is_the_plain_version(spark, plain, monkeypatch):
    draw = random.Random(2)
    words = ["the", "Straße", "naïve", "running", "  ", "\n", "▁", "<s>", "<|endoftext|>", "<0x41>", "日本", "\U0001f600", "x1", "...", "\x00"]
    texts = [None, "", " ", "a", "the the the", "<s></s>", "▁x"] + ["the cat and the dog"] * 2_300
    texts += [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(300)] + ["the cat " * 3_000]
    rows, counts, each = expected(plain, texts)
    frame = alignment.report(docs_of(spark, texts).coalesce(1), *PATHS)
    got = sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                 for r in frame.collect())
    assert got == rows

    table = alignment.inverted(docs_of(spark, texts).coalesce(1), "doc_id", "text", *PATHS)
    assert table.where(F.octet_length("docs") == alignment._BITS).count() > 0       # both kinds of bitmaps
    found = {(r["a_id"], r["b_id"]): (r["documents"], r["links"]) for r in alignment.pair_counts(table).collect()}
    holds = Counter(link for e in each if e for link in set(e[0]))
    assert found == {link: (holds[link], n) for link, n in counts.items()}


def test_groups_are_the_plain_ones(spark, plain):
    texts = ["the running cat", None, "", "Straße \U0001f600 x", "a▁b"]
    found = docs_of(spark, texts).select("doc_id", alignment.groups("text", *PATHS).alias("g")).collect()
    for row in found:
        cut = plain(texts[row["doc_id"]])
        assert [(g["a"], g["b"]) for g in row["g"]] == ([] if cut is None else cut[1])


def test_bitmaps_hold_the_multiplicities():
    draw = random.Random(9)
    times = {(pair, doc): draw.choice([1, 1, 2, 3, 5, 300]) for pair in (3, 8) for doc in range(0, 9_000, pair)}
    keys = np.sort(np.array([p * alignment.BLOCK_DOCS + d for (p, d), n in times.items() for _ in range(n)]))
    pairs, planes, bitmaps = alignment.containers(keys)
    rows = [row for bitmap in bitmaps for row in bitmap.to_pylist()]
    found = Counter()
    for pair, plane, row in zip(pairs.tolist(), planes.tolist(), rows):
        if len(row) == alignment._BITS:
            docs = np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8), bitorder="little"))
        else:
            docs = np.frombuffer(row, "<u2")
        for doc in docs.tolist():
            found[pair, doc] += 1 if plane == 0 else 1 << (plane - 1)
    assert found == times and {len(r) == alignment._BITS for r in rows} == {True, False}


def test_blocks_of_few_links(spark, plain, monkeypatch):
    """The same where each document is a block; ids of text, null and repeated."""
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 1)
    frame = spark.createDataFrame([("x", "the cat"), (None, "the dog"), ("x", "the cat"), ("e", None)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["n_links"], r["count_sum"]) for r in alignment.report(frame, *PATHS).collect())
    rows, _, _ = expected(plain, ["the dog", None, "the cat", "the cat"])
    assert got == [(i, r[4], r[6]) for i, r in zip(["", "e", "x", "x"], rows)]


def test_empty_table(spark):
    assert alignment.report(docs_of(spark, []), *PATHS).count() == 0
