"""Byte-level BPE: exact merges found by backtracking from longest matches.

The vocabulary's byte strings, read as Latin-1 text, form an Aho-Corasick automaton, which lists all
tokens that start at each byte of a piece.  A search takes the longest one whose neighbour on the left
is compatible, and goes back when none is left.  Two neighbours are compatible if merging their joined
bytes in rank order would leave the border between them alone; that answer is remembered per pair.
As an encoding is right exactly if all neighbours are compatible, and each prefix has one encoding,
a position that failed once is never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import functools
import itertools
import operator
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

PIECES_KEPT = 300_000       # remembered encodings per Python worker; more than that are found again
PIECE_KEPT_CHARS = 64
PAIRS_KEPT = 500_000        # remembered pairs of neighbours per Python worker
_CHUNK = 100_000
_GROUP = operator.methodcaller("group")
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}


class Vocabulary:
    """Ranks of byte strings, with what the search needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        if rank not in self.parts:
            row = [bytes([b]) for b in self.bytes_of[rank]]
            while len(row) > 2:
                found = [(self.ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(row, row[1:]))]
                best, i = min(found)
                if best >= rank:
                    break
                row[i:i + 2] = [row[i] + row[i + 1]]
            known = len(row) == 2 and all(x in self.ranks for x in row)
            self.parts[rank] = (self.ranks[row[0]], self.ranks[row[1]]) if known else None
        return self.parts[rank]

    def _age(self, rank: int) -> int:
        return -1 if len(self.bytes_of[rank]) == 1 else rank

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side."""
        pair = (left, right)
        holds = self.fits.get(pair)
        if holds is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            holds = self.fits[pair] = self._border_holds(left, right)
        return holds

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo the younger merge at the border again and again; at no point may the two tokens that
        # touch there have had a merge of their own that was due before the one just undone.
        due = None
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and (due is None or across < due):
                return False
            if self._age(left) > self._age(right):
                due, left = left, self.halves(left)[1]
            elif self._age(right) >= 0:
                due, right = right + 1, self.halves(right)[0]     # equal ranks merge from the left
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token itself is that token."""
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        size = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            starts[end - token[0] + 1].append(token)        # ends rise, so the longest comes last
        # the answers of halves() and compatible() are looked up here, as calls take longer than the look
        parts, fits = self.parts, self.fits
        failed: set[int] = set()
        path: list[tuple[int, int, list[tuple[int, int]]]] = []
        at, before, choices = 0, -1, starts[0]
        while True:
            while choices:
                length, rank = choices.pop()        # the longest that is left
                to = at + length
                if to in failed or length > 1 and (parts[rank] if rank in parts else self.halves(rank)) is None:
                    continue
                if before < 0:
                    break
                holds = fits.get((before, rank))
                if holds or holds is None and self.compatible(before, rank):
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                failed.add(at)
                _, _, choices = path.pop()
                at, before = (path[-1][0], path[-1][1]) if path else (0, -1)
                continue
            path.append((to, rank, choices))
            if to == size:
                return [rank for _, rank, _ in path]
            at, before, choices = to, rank, starts[to]      # entered once: a start that was left has failed


class _Pieces(dict):
    """Packed ids of pieces of text, remembered up to a fixed number.

    When half of it is full, what was not asked for since the last such time is forgotten, so frequent
    pieces stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.vocabulary.encode(piece.encode("utf-8"))
            packed = struct.pack(f"={len(ids)}i", *ids)
        if len(piece) <= PIECE_KEPT_CHARS:
            if len(self) >= PIECES_KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary in a file of lines "base64-token rank"; once per Python worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@functools.lru_cache(maxsize=2)
def _remembered(path: str) -> _Pieces:
    """Pieces that a Python worker remembers from task to task."""
    return _Pieces(load(path))


@functools.lru_cache(maxsize=8)
def ascii_pattern(pattern: regex.Pattern) -> regex.Pattern | re.Pattern:
    """What finds the same in ASCII texts and takes half the time: classes in place of properties, for ``re``.

    The pattern itself if it has flags, groups, or an escape other than letters, numbers and white space."""
    if pattern.flags != regex.compile("a").flags or re.search(r"\((?!\?[!=])|\[:|\[\[", pattern.pattern):
        return pattern
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern.pattern, re.DOTALL):
        if part in _ASCII:
            out.append(_ASCII[part] if inside else f"[{_ASCII[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{_ASCII[chr(92) + 's']}]")
        elif part.startswith("\\"):
            return pattern
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


def encode_text(text: str | None, pieces: dict, pattern: regex.Pattern) -> np.ndarray:
    if text and text.isascii():
        pattern = ascii_pattern(pattern)
    if text and len(text) <= _CHUNK and not pattern.groups:        # all pieces at once are few enough
        return np.frombuffer(b"".join(map(pieces.__getitem__, pattern.findall(text))), dtype=np.int32)
    out = bytearray()
    found = map(_GROUP, pattern.finditer(text or ""))
    while part := list(itertools.islice(found, _CHUNK)):
        out += b"".join(map(pieces.__getitem__, part))
    return np.frombuffer(bytes(out), dtype=np.int32)


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """``array<int>`` of ids.  A null or empty text gives an empty array; text of any length is
    encoded whole; text that looks like a special token is ordinary text."""

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, compiled = _remembered(path), regex.compile(pattern)
        for batch in batches:
            yield pd.Series([encode_text(text, pieces, compiled) for text in batch], dtype=object)

    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """``binary`` with the bytes of the ids; null gives null, an unknown id raises."""

    @pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = load(path).bytes_of
        for batch in batches:
            yield pd.Series([None if row is None else b"".join(map(bytes_of.__getitem__, row.tolist()))
                             for row in batch], dtype=object)

    return raw(ids)


def coded(docs: DataFrame, columns: list[str], path: str, pattern: str) -> DataFrame:
    """``columns`` of each row with ``ids`` and ``decoded``, the bytes that the ids stand for.

    Both directions in one pass, given back a few rows at a time, so a worker never holds the ids of a
    whole batch of documents.  Nulls and lengths as in :func:`encode`.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields]
                       + ["ids array<int>", "decoded binary"])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, compiled = _remembered(path), regex.compile(pattern)
        bytes_of = load(path).bytes_of
        for frame in frames:
            for low in range(0, len(frame), 100):
                part = frame.iloc[low:low + 100]
                out = part[columns].copy()
                ids = [encode_text(text, pieces, compiled) for text in part["text"]]
                out["ids"] = pd.Series(ids, index=out.index, dtype=object)
                out["decoded"] = [b"".join(map(bytes_of.__getitem__, row.tolist())) for row in ids]
                yield out

    return docs.select(*columns, "text").mapInPandas(rows, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and of decoded bytes."""
    return coded(docs, ["doc_id"], path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
