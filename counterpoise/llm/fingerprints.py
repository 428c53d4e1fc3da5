"""Merkle fingerprints of documents: sections, paragraphs, and the sentences of a paragraph.

A leaf is the digest of a sentence, a paragraph (a line) the digest of its leaves, a section (a run of
paragraphs that ends where the digest of one says so) the digest of its paragraphs, and the root that
of the sections.  A fingerprint writes the tree down, so two of them tell without the texts whether the
documents are equal (roots) and, by going down branches that differ, where an edit lies and how much
of the text it leaves.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

ROOT = 16                       # bytes of a digest, and of the root in a fingerprint
DIGEST = 6                      # bytes that a fingerprint shows of the digests of sections and paragraphs
LEAF = 4                        # and of the digests of leaves
RANGE_BYTES = 16 << 20          # bytes of text in a range of doc_ids, about
RANGES = 4096                   # ranges at most
_FRAME = 64                     # documents whose fingerprints a task holds at a time
LINES_KEPT = 2048               # paragraphs of up to LINE_KEPT code points that a Python worker remembers: an edited
LINE_KEPT = 2048                # text has most of its lines from the text itself and the next one
SECTION_PARAGRAPHS = 8          # paragraphs in a section, on average
#: Leaves: sentences, and within longer ones stretches of 60 characters.
_LENGTH = re.compile(r"\.(\d+)")
_SENTENCE = re.compile(r"[^.!?]{0,60}[.!?]+\s*|[^.!?]{1,60}")


def _digest(kind: bytes, data: bytes) -> str:
    return hashlib.blake2b(kind + data, digest_size=ROOT).hexdigest()


def _paragraph(line: str) -> tuple[str, str]:
    """Digest of a line, and how a fingerprint writes the line down."""
    digest = hashlib.blake2b
    sentences = _SENTENCE.findall(line)
    if line.isascii():
        leaves = [digest(b"s" + s.encode(), digest_size=ROOT).hexdigest() for s in sentences]
    else:
        leaves = [digest(b"s" + s.encode("utf-8", "surrogatepass"), digest_size=ROOT).hexdigest() for s in sentences]
    node = _digest(b"p", "".join(leaves).encode())
    return node, f"{node[:2 * DIGEST]}(" + "-".join([f"{d[:2 * LEAF]}.{len(s)}" for d, s in zip(leaves, sentences)]) + ")"


_remembered = functools.lru_cache(maxsize=LINES_KEPT)(_paragraph)


def fingerprint(text: str | None) -> str:
    """``root=sections``: sections joined by ``/``, each ``digest:paragraph,paragraph``, each paragraph
    ``digest(leaf.length-leaf.length)``.  Null and empty texts have the same fingerprint, a bare root."""
    sections, paragraphs, inside = [], [], []
    shown = 2 * DIGEST
    for line in (text or "").splitlines(keepends=True) if text else []:
        node, told = _remembered(line) if len(line) <= LINE_KEPT else _paragraph(line)
        paragraphs.append(told)
        inside.append(node)
        if int(node, 16) % SECTION_PARAGRAPHS == 0:
            sections.append((_digest(b"c", "".join(inside).encode()), paragraphs))
            paragraphs, inside = [], []
    if inside:
        sections.append((_digest(b"c", "".join(inside).encode()), paragraphs))
    root = _digest(b"r", "".join(d for d, _ in sections).encode())
    return root + "=" + "/".join(f"{d[:shown]}:" + ",".join(p) for d, p in sections)


def _children(text: str, mark: str) -> list[str]:
    return text.split(mark) if text else []


def _inside(node: str) -> list[str]:
    """Leaves of a paragraph."""
    return node[node.index("(") + 1:-1].split("-")


def _size(node: str) -> int:
    """Code points under a section, paragraph or leaf."""
    if node.find(".") == 2 * LEAF and "(" not in node:       # a leaf
        return int(node[2 * LEAF + 1:])
    return sum(map(int, _LENGTH.findall(node)))


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal nodes in the same order in both lists, as much text as there is.

    The k-th occurrence of a node in one list can only meet the k-th in the other, so what is left is the heaviest
    rising sequence of places, found in n log n steps with a tree of best weights by place.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    best: list[tuple[int, int]] = [(0, -1)] * (len(b) + 1)      # weight and last link, by place from 1
    links: list[tuple[int, int, int]] = []                      # places in a and b, link before
    top = (0, -1)
    for i in range(head, len(a) - tail):
        if not places.get(a[i]):
            continue
        j = places[a[i]].pop()
        weight, before, at = 0, -1, j
        while at > 0:
            if best[at][0] > weight:
                weight, before = best[at]
            at -= at & -at
        links.append((i, j, before))
        found = (weight + _size(a[i]), len(links) - 1)
        at = j + 1
        while at < len(best):
            if found[0] > best[at][0]:
                best[at] = found
            at += at & -at
        if found[0] > top[0]:
            top = found
    middle, at = [], top[1]
    while at >= 0:
        middle.append(links[at][:2])
        at = links[at][2]
    return ([(i, i) for i in range(head)] + middle[::-1]
            + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)])


def _between(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of both lists between aligned nodes."""
    i = j = 0
    for x, y in aligned(a, b) + [(len(a), len(b))]:
        if x > i or y > j:
            yield i, x, j, y
        i, j = x + 1, y + 1


def _starts(nodes: list[str], start: int) -> list[int]:
    return list(itertools.accumulate(map(_size, nodes), initial=start))


def _down(a: list[str], b: list[str], i: int, j: int, levels: tuple) -> Iterator[tuple[list, list]]:
    """Leaves ``(start, leaf)`` of either side between aligned nodes, stretch by stretch; ``i`` and ``j`` are
    where the lists start in their texts.  Equal branches in the same order are not entered."""
    at, to = _starts(a, i), _starts(b, j)
    for low, high, left, right in _between(a, b):
        x, y = a[low:high], b[left:right]
        if levels:
            yield from _down([n for node in x for n in levels[0](node)], [n for node in y for n in levels[0](node)],
                             at[low], to[left], levels[1:])
        else:
            yield list(zip(at[low:high], x)), list(zip(to[left:right], y))


def differing(a: str, b: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Leaves ``(start, leaf)`` of either fingerprint that the other lacks at that place in the order."""
    (root, _, x), (other, _, y) = a.partition("="), b.partition("=")
    if root == other:
        return [], []
    gone, new = [], []
    levels = (lambda section: _children(section.partition(":")[2], ","), _inside)
    for left, right in _down(_children(x, "/"), _children(y, "/"), 0, 0, levels):
        gone += left
        new += right
    return gone, new


def size_of(fingerprint_text: str) -> int:
    return _size(fingerprint_text.partition("=")[2])


def likeness(a: str, b: str) -> float:
    """Share of both texts' length in leaves that both have in the same order: 1 for equal roots alone, 0 for
    nothing in common.  Text that only moved counts as differing on one side of the move."""
    if a.partition("=")[0] == b.partition("=")[0]:
        return 1.0
    gone, new = differing(a, b)
    total = size_of(a) + size_of(b)
    differs = sum(_size(leaf) for _, leaf in gone + new)
    return min(1.0 - differs / total, math.nextafter(1.0, 0.0)) if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans ``(start, end)`` of the first text, in code points, whose leaves the second lacks at that place."""
    spans: list[tuple[int, int]] = []
    for start, leaf in differing(a, b)[0]:
        end = start + _size(leaf)
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def moves(a: str, b: str) -> list[tuple[int, int, int]]:
    """Leaves that stand elsewhere in the second text: start in the first, start in the second, length."""
    gone, new = differing(a, b)
    waiting: dict[str, list[int]] = {}
    for start, leaf in reversed(new):
        waiting.setdefault(leaf, []).append(start)
    return [(start, waiting[leaf].pop(), _size(leaf)) for start, leaf in gone if waiting.get(leaf)]


def fingerprint_of(text: Column | str) -> Column:
    """The fingerprint as a column."""

    @pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(fingerprint)

    return told(text)


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """:func:`likeness` of two fingerprint columns."""

    @pandas_udf("double")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype=float)

    return told(a, b)


def _limits(rows: DataFrame, key: Column, kind: str) -> Column | None:
    """Ascending keys that cut the rows into ranges of about ``RANGE_BYTES`` of text, as one array column.

    They are those of the rows whose keys have the smallest hashes, so equally drawn from all rows, and no more
    than ``RANGES``.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    count = min(RANGES, max(16, size // RANGE_BYTES)) - 1
    drawn = rows.select(key.alias("key")).orderBy(F.xxhash64(F.lit(5), "key"), "key").limit(count)
    limits = [tuple(row["key"]) for row in drawn.distinct().orderBy("key").collect()]
    if not limits:
        return None
    parts = ("doc_id", kind), ("hash", "bigint"), ("salt", "bigint")
    return F.array(*[F.struct(*[F.lit(value).cast(to).alias(name) for value, (name, to) in zip(limit, parts)])
                     for limit in limits])


def next_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``: the text of the document after this one by descending
    doc_id (null last; ties by text), and for the last one that of the first.

    Rows are cut into ranges by a pure function of doc_id, a hash of the text and a salt, so rows of one doc_id, without
    doc_id, or equal altogether are spread too; the number of ranges follows the bytes of text.  Each range also gets the
    first document of the range after it, so the order never meets in one task and texts are moved once.  doc_ids
    may be of any type with an order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    # the salt only parts rows that are equal in doc_id and text, which may stand in any order
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    key = F.struct("doc_id", "hash", "salt")
    cuts = _limits(rows, key, kind)
    if cuts is None:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    # the number of limits up to a key, by halving steps; nulls sort below all else
    steps = F.lit([1 << i for i in reversed(range(RANGES.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at))
    placed = rows.withColumn("part", place)
    # one row per range
    tops = placed.groupBy("part").agg(F.max(key).alias("top"))
    firsts = sorted(((row["part"], tuple(row["top"])) for row in tops.collect()), key=lambda x: -x[0])
    heads = spark.createDataFrame(
        [(before[0], *head[1][:2]) for before, head in zip(firsts, firsts[1:] + firsts[:1])],
        f"into int, head_id {kind}, head_hash long")
    guests = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id"))
                         & (F.col("hash") == F.col("head_hash"))).select(
        "doc_id", "text", "hash", "salt", F.col("into").alias("part"), F.lit(1).alias("guest")).dropDuplicates(["part"])
    everyone = placed.withColumn("guest", F.lit(0)).unionByName(guests)
    line = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(),
                                              F.col("salt").desc())
    return (everyone.withColumn("next_text", F.lead("text").over(line)).where("guest = 0")
            .select("doc_id", "text", "next_text"))


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits, fingerprints and likeness of texts and next texts, in small frames: fingerprints of many long
    texts are never held together."""
    for frame in frames:
        for low in range(0, len(frame), _FRAME):
            part = frame.iloc[low:low + _FRAME]
            rows = []
            for doc_id, text, following in zip(part["doc_id"], part["text"], part["next_text"]):
                cut = len(text) // 3
                edited = text[:len(text) - cut] + following[:cut]
                own, other = fingerprint(text), fingerprint(edited)
                rows.append((len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other,
                             likeness(own, other), likeness(own, fingerprint(following))))
            told = pd.DataFrame(rows, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                               "near_edited", "near_next"])
            told.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield told


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Null texts count as empty.  Rows without doc_id come last; rows of one doc_id are ordered by a hash of their texts, and
    repeated rows follow each other.  Long texts are read whole.  Columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # as text, so that null ids in a batch don't turn the others into floats
    named = next_texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    told = named.mapInPandas(_told, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
    return told.withColumn("doc_id", F.col("doc_id").cast(kind))
