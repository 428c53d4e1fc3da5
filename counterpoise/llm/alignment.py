"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the same bytes, so the places where tokens of both end cut a text into groups, and the pieces
between any two neighbouring ends are exactly the overlapping pairs of tokens, the links.  Links are kept inverted:
documents are numbered within blocks, and each pair of ids has, per block, a compressed bitmap of the documents that
hold it (sorted numbers if few, bits if many) and further bitmaps, its planes, of the binary digits of how often a
document holds it beyond once.  Blocks hold different documents, so the OR of a pair's bitmaps joins them block by
block, and popcounts add up: those of the first bitmap to documents, those of all with their weights to links.
Counts go back the same way: each posting returns its pair's count to the documents in its bitmaps.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

BLOCK_DOCS = 1 << 15            # documents in a block, at most: a number takes two bytes
BLOCK_LINKS = 4_000_000         # a block ends after so many links; a longer document is a block of its own
_BITS = BLOCK_DOCS // 8         # bytes of a bitmap of bits; sorted numbers are always shorter
_CHUNK = 2_000_000              # bytes of text that are encoded at a time
_SHIFT = 20                     # bits of an id within a pair
_PIECE = 1 << 16                # bytes of a text above which the exact library is asked, whatever it takes
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _table(pieces: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(pieces, type=pa.large_binary()), np.array([len(p) for p in pieces], dtype=np.int64)


class Pair:
    """Tokenizer A (byte-level BPE, a JSON file) and B (a SentencePiece model), and their tokens' bytes."""

    def __init__(self, json_path: str, model_path: str, pattern: str):
        with open(json_path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        vocab = model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        of_a = [b""] * size
        for entry, i in vocab.items():
            if entry not in special:
                of_a[i] = bytes(letters[c] for c in entry)
        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = True
        # Ids in the order of merges are ranks, and then a faster coder gives the same ids
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        places = [vocab.get(x + y) for x, y in merges]
        ranked = places == list(range(256, 256 + len(places))) and len(vocab) - len(special.keys() & vocab) == 256 + len(places)
        self.quick = tiktoken.Encoding("own", pat_str=pattern, special_tokens={}, mergeable_ranks={
            b: i for i, b in enumerate(of_a) if b}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        of_b = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            of_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i)
                        else piece.replace(_SPACE, " ").encode())
        self.bytes_a, self.width_a = _table(of_a)
        self.bytes_b, self.width_b = _table(of_b)
        digits_a = [b"%d" % i for i in range(size)]
        digits_b = [b"%d" % i for i in range(len(of_b))]
        self.written, _ = _table([d + e for d in digits_a for e in (b",", b"|")]
                                 + [d + e for d in digits_b for e in (b",", b";", b"")])
        self.first_b = 2 * size

    def encode_a(self, text: str) -> list[int]:
        if self.quick is not None and len(text) <= _PIECE:
            return self.quick.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, texts)


@functools.lru_cache(maxsize=4)
def pair_of(json_path: str, model_path: str, pattern: str) -> Pair:
    return Pair(json_path, model_path, pattern)


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of ``ids`` in a row, and where each starts (and the end)."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b"").cast("B"), ends


def _starts(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])


class Aligned:
    """Texts cut by both tokenizers: per text ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (0 where the tokens don't give
    back the text behind a space), and the links of all texts in a row (``link_doc``, ``link_a``, ``link_b``)."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.pair = pair
        full = [b" " + t.encode() if t else b"" for t in texts]
        of_a = [pair.encode_a(" " + t) if t else [] for t in texts]
        of_b = pair.pieces.encode([t or "" for t in texts], num_threads=1)
        ids_a = np.array([i for ids in of_a for i in ids], dtype=np.int64)
        ids_b = np.array([i for ids in of_b for i in ids], dtype=np.int64)
        whole = np.ones(len(texts), dtype=bool)
        sizes = []
        for table, ids, lists in ((pair.bytes_a, ids_a, of_a), (pair.bytes_b, ids_b, of_b)):
            data, ends = _joined(table, ids)
            at = _starts([len(x) for x in lists])
            cuts = ends[at].tolist()
            whole &= [data[s:e] == text for s, e, text in zip(cuts, cuts[1:], full)]
            sizes.append(np.diff(at))
        keep = whole & np.array([bool(t) for t in texts], dtype=bool)
        self.n_a, self.n_b = (np.where(keep, n, 0) for n in sizes)
        self.ids_a, self.ids_b = ids_a[np.repeat(keep, sizes[0])], ids_b[np.repeat(keep, sizes[1])]

        limits = _starts([len(text) if k else 0 for text, k in zip(full, keep)])
        marks = np.zeros(int(limits[-1]) + 1, dtype=np.uint8)
        marks[np.cumsum(pair.width_a[self.ids_a])] |= 1
        marks[np.cumsum(pair.width_b[self.ids_b])] |= 2
        marks[0] = 0
        ends = np.flatnonzero(marks)
        self.marks = marks[ends]
        self.both = self.marks == 3
        is_a, is_b = (self.marks & 1).astype(np.int64), (self.marks >> 1).astype(np.int64)
        self.link_a = self.ids_a[np.cumsum(is_a) - is_a]
        self.link_b = self.ids_b[np.cumsum(is_b) - is_b]
        cuts = np.searchsorted(ends, limits, side="right")
        self.n_links = np.diff(cuts)
        self.n_groups = np.diff(_starts(self.both)[cuts])
        self.link_doc = np.repeat(np.arange(len(texts)), self.n_links)

    def _group_limits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        last_a = self.both[(self.marks & 1) > 0]
        last_b = self.both[(self.marks & 2) > 0]
        return last_a, last_b, np.concatenate([[0], np.flatnonzero(last_a) + 1]), np.concatenate(
            [[0], np.flatnonzero(last_b) + 1])

    def groups(self) -> list[list[dict[str, list[int]]]]:
        """Per text its groups, each with the ids of both sides."""
        _, _, to_a, to_b = self._group_limits()
        flat = [{"a": self.ids_a[a:c].tolist(), "b": self.ids_b[b:d].tolist()}
                for a, c, b, d in zip(to_a, to_a[1:], to_b, to_b[1:])]
        at = _starts(self.n_groups)
        return [flat[s:e] for s, e in zip(at, at[1:])]

    def digests(self) -> list[str]:
        """Per text the sha256 of its groups written as ``a,a|b;a|b,b``; empty without tokens."""
        last_a, last_b, to_a, to_b = self._group_limits()
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.int64)
        codes[np.arange(len(self.ids_a)) + to_b[group_a]] = 2 * self.ids_a + last_a
        ending = last_b.astype(np.int64)
        ending[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        codes[np.arange(len(self.ids_b)) + to_a[group_b + 1]] = self.pair.first_b + 3 * self.ids_b + ending
        data, ends = _joined(self.pair.written, codes)
        cuts = ends[_starts(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(cuts, cuts[1:])]


def groups(text: Column | str, json_path: str, model_path: str, pattern: str) -> Column:
    """The groups of a text: an array of structs of the ids ``a`` and ``b``; empty where it has no tokens."""
    @pandas_udf("array<struct<a: array<int>, b: array<int>>>")
    def cut(texts: pd.Series) -> pd.Series:
        pair = pair_of(json_path, model_path, pattern)
        out: list = []
        for part in _chunks(texts.tolist()):
            out += pair.align(part).groups()
        return pd.Series(out)
    return cut(text)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > _CHUNK:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def containers(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Bitmaps of a block's sorted keys (pair above, document below): pairs, planes and bitmaps, plane by plane.

    Plane 0 has the documents of a pair, plane j those with binary digit j - 1 in how often beyond once."""
    new = np.ones(len(links), dtype=bool)
    new[1:] = links[1:] != links[:-1]
    first = np.flatnonzero(new)
    unique, more = links[first], np.diff(np.append(first, len(links))) - 1
    pairs, planes, bitmaps = [], [], []
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        keys = unique[(more >> (plane - 1)) & 1 > 0] if plane else unique
        if not len(keys):
            continue
        pair, doc = keys // BLOCK_DOCS, (keys % BLOCK_DOCS).astype("<u2")
        head = np.ones(len(pair), dtype=bool)
        head[1:] = pair[1:] != pair[:-1]
        cuts = np.append(np.flatnonzero(head), len(pair))
        pairs.append(pair[head])
        planes.append(np.full(len(cuts) - 1, plane, dtype=np.int32))
        many = np.flatnonzero(np.diff(cuts) >= _BITS // 2)
        if len(many):
            rows = [doc[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
            for i in many:
                bits = np.zeros(BLOCK_DOCS, dtype=np.uint8)
                bits[doc[cuts[i]:cuts[i + 1]]] = 1
                rows[i] = np.packbits(bits, bitorder="little").tobytes()
            bitmaps.append(pa.array(rows, type=pa.binary()))
        else:
            bitmaps.append(pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [
                None, pa.py_buffer((2 * cuts).astype(np.int32)), pa.py_buffer(doc)]))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int32), [pa.array([], pa.binary())]
    return np.concatenate(pairs), np.concatenate(planes), bitmaps


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_LONG, _INT, _TEXT, _BYTES = pa.int64(), pa.int32(), pa.string(), pa.binary()


def inverted(docs: DataFrame, key: str, text: str, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """Two kinds of rows, by ``block``: documents (``place`` in the block, ``key``, counts, ``groups_sha256``) and
    postings (``pair``, ``plane``, ``docs``: a bitmap of places), where the other kind's columns are null.

    Null and empty texts are documents without tokens.  Write the result before it is read twice: blocks are
    numbered by task."""
    kind = docs.schema[key].dataType
    fields = [T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("key", kind),
              *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType()),
              T.StructField("pair", T.LongType()), T.StructField("plane", T.IntegerType()),
              T.StructField("docs", T.BinaryType())]

    def block_batches(number: int, rows: list[dict], links: list[np.ndarray], key_type) -> Iterator[pa.RecordBatch]:
        done = sum(len(r["n_a"]) for r in rows)
        columns = [pa.array(np.full(done, number), _LONG), pa.array(np.arange(done), _INT),
                   pa.concat_arrays([r["key"] for r in rows]),
                   *[pa.array(np.concatenate([r[c] for r in rows]), _LONG) for c in _COUNTS],
                   pa.array([d for r in rows for d in r["groups_sha256"]], _TEXT),
                   pa.nulls(done, _LONG), pa.nulls(done, _INT), pa.nulls(done, _BYTES)]
        names = [f.name for f in fields]
        yield pa.RecordBatch.from_arrays(columns, names)
        pairs, planes, bitmaps = containers(np.sort(np.concatenate(links)))
        at = 0
        for bitmap in bitmaps:
            n = len(bitmap)
            part = slice(at, at + n)
            at += n
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number), _LONG), pa.nulls(n, _INT), pa.nulls(n, key_type),
                *[pa.nulls(n, _LONG) for _ in _COUNTS], pa.nulls(n, _TEXT), pa.array(pairs[part], _LONG),
                pa.array(planes[part], _INT), bitmap], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(json_path, model_path, pattern)
        number = TaskContext.get().partitionId() << 28
        rows, links, size, held = [], [], 0, 0
        key_type = None
        for batch in batches:
            keys = batch.column(0)
            key_type = keys.type
            at = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                for start in range(0, len(texts), BLOCK_DOCS):
                    part = texts[start:start + BLOCK_DOCS]
                    if rows and held + len(part) > BLOCK_DOCS:
                        yield from block_batches(number, rows, links, key_type)
                        number, rows, links, size, held = number + 1, [], [], 0, 0
                    cut = pair.align(part)
                    rows.append({"key": keys.slice(at, len(part)), "groups_sha256": cut.digests(),
                                 **{c: getattr(cut, c) for c in _COUNTS}})
                    links.append(((cut.link_a << _SHIFT) | cut.link_b) * BLOCK_DOCS + cut.link_doc + held)
                    at, held, size = at + len(part), held + len(part), size + len(cut.link_doc)
                    if size >= BLOCK_LINKS:
                        yield from block_batches(number, rows, links, key_type)
                        number, rows, links, size, held = number + 1, [], [], 0, 0
        if rows:
            yield from block_batches(number, rows, links, key_type)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(build, T.StructType(fields))


def _cardinality(docs: str = "docs") -> Column:
    return F.when(F.octet_length(docs) == _BITS, F.bitmap_count(docs)).otherwise(F.octet_length(docs) / 2).cast("long")


def _weight(plane: str = "plane") -> Column:
    return F.when(F.col(plane) == 0, F.lit(1)).otherwise(F.expr(f"shiftleft(1L, {plane} - 1)")).cast("long")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Rows ``(pair, a_id, b_id, documents, links, best, bitmaps)``: popcounts of the bitmaps of each pair.

    ``best`` says that no other pair of ``b_id`` has more links.  The highest counts are one per B id, so at most
    as many as B has tokens, and are broadcast."""
    counts = postings.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, _cardinality()).otherwise(0)).alias("documents"),
        F.sum(_cardinality() * _weight()).alias("links"), F.count(F.lit(1)).alias("bitmaps"))
    counts = cut_lineage(counts.withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")))
    highest = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(highest), "b_id").select(
        "pair", F.shiftright("pair", _SHIFT).cast("int").alias("a_id"), "b_id", "documents", "links",
        (F.col("links") == F.col("most")).alias("best"), "bitmaps")


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``rows`` (of :func:`inverted`, written) with ``n_best`` (links whose pair is the best of its
    B id) and ``count_sum`` (sum of the links' pair counts), which the postings return."""
    postings = lookup(rows.where("pair is not null").select("block", "pair", "plane", "docs"), counts, ["pair"],
                      ["links", "best"], count="bitmaps")
    documents = rows.where("pair is null").drop("pair", "plane", "docs")
    both = documents.unionByName(postings.drop("pair"), allowMissingColumns=True)
    kept = ["key", *_COUNTS, "groups_sha256"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])

    def finish(found, best, total):
        table = pa.concat_batches(found)
        place = table.column("place").to_numpy()
        return pa.RecordBatch.from_arrays([*[table.column(c) for c in kept], pa.array(best[place], _LONG),
                                           pa.array(total[place], _LONG)], schema.names)

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, []
        best, total = np.zeros(BLOCK_DOCS, dtype=np.int64), np.zeros(BLOCK_DOCS, dtype=np.int64)
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if blocks[start] != block:
                    if found:
                        yield finish(found, best, total)
                    block, found = blocks[start], []
                    best[:], total[:] = 0, 0
                part = batch.slice(start, end - start)
                is_doc = part.column("docs").is_null()
                documents = part.filter(is_doc)
                if documents.num_rows:
                    found.append(documents)
                held = part.filter(pa.compute.invert(is_doc))
                if held.num_rows:
                    add(held, best, total)
        if found:
            yield finish(found, best, total)

    return both.repartition("block").sortWithinPartitions("block").mapInArrow(give_back, schema)


def add(postings: pa.RecordBatch, best: np.ndarray, total: np.ndarray) -> None:
    """Add what ``postings`` (plane, docs, links, best) of one block return to its documents' sums."""
    weight = np.left_shift(1, np.maximum(postings.column("plane").to_numpy() - 1, 0).astype(np.int64))
    links = postings.column("links").to_numpy() * weight
    won = np.where(np.asarray(postings.column("best")), weight, 0)
    bitmaps = postings.column("docs")
    sizes = pa.compute.binary_length(bitmaps).to_numpy()
    full = sizes == _BITS
    short = bitmaps.filter(pa.array(~full)) if full.any() else bitmaps
    short = pa.concat_arrays([short])       # offsets from zero
    ends = np.frombuffer(short.buffers()[1], dtype=np.int32)[short.offset:short.offset + len(short) + 1]
    places = np.frombuffer(short.buffers()[2] or b"", dtype="<u2")[ends[0] // 2:ends[-1] // 2] if len(short) else []
    times = sizes[~full] // 2
    np.add.at(total, places, np.repeat(links[~full], times))
    np.add.at(best, places, np.repeat(won[~full], times))
    for i in np.flatnonzero(full):
        bits = np.unpackbits(np.frombuffer(bitmaps[int(i)].as_buffer(), dtype=np.uint8), bitorder="little").astype(bool)
        total[bits] += links[i]
        best[bits] += won[i]


def report(docs: DataFrame, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """Per document of ``docs (doc_id, text)`` its counts of tokens, groups and links, what the corpus says of its
    links, and the digest of its groups.

    Texts that are null or empty, and those that either tokenizer doesn't give back, have zeros and an empty digest.
    Texts are read whole; repeated rows count again and have rows of their own; other columns are left aside."""
    rows = cut_lineage(inverted(docs, "doc_id", "text", json_path, model_path, pattern))
    counts = pair_counts(rows)
    return scored(rows, counts).select(F.col("key").alias("doc_id"), *_COUNTS, "n_best", "count_sum", "groups_sha256")
