"""What several operators of this package need: tables, tiles of large groups, whole groups in a stream."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(df: DataFrame, outputs: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without names that clash, and the renaming that brings names back.

    Columns that begin with an underscore, as the working columns of the operators do, get other names until they
    are renamed back.  Columns named like one of ``outputs`` get ``_input`` behind their names, for good.  Names are
    compared without case, as Spark resolves them.
    """
    taken, back, moved = {c.lower() for c in df.columns}, {}, {}
    for column in df.columns:
        if column.startswith("_"):
            new = f"kept{column}"
        elif column.lower() in outputs:
            new = f"{column}_input"
        else:
            continue
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        moved[column] = new
        if column.startswith("_"):
            back[new] = column
    return df.withColumnsRenamed(moved), back


def tiled(df: DataFrame, group: str, size: str, ident: str, block: int) -> DataFrame:
    """Deal the rows of each group to tiles of at most about ``2 * block`` rows.

    ``size`` names a column with the group's number of rows.  A group is cut into blocks by a hash of
    ``ident`` and every pair of blocks (also a block with itself) is a tile, so every pair of rows meets
    in exactly one tile and no task has to hold the group.  Adds ``tile_i``, ``tile_j`` and ``part``,
    the row's own block.  A row is copied once per block of its group, and a group of up to ``block``
    rows is one tile.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = df.withColumn("_blocks", blocks).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(17), ident), F.col("_blocks")).cast("int"))
    return (dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("tile_i", F.least("part", "_other"))
            .withColumn("tile_j", F.greatest("part", "_other"))
            .drop("_blocks", "_other"))


def by_tile(df: DataFrame, group: str) -> DataFrame:
    """Bring the rows of each tile together, sorted so that :func:`whole_groups` can cut the stream."""
    return (df.repartition(group, "tile_i", "tile_j")
            .sortWithinPartitions(group, "tile_i", "tile_j"))


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]
                 ) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Cut a stream of frames sorted by ``keys`` at group limits.

    Yields a frame with the first and one-past-last row of each group in it; a group that is split
    over frames is put together first.  Keys are never null.
    """
    held = None
    for frame in frames:
        if not len(frame):
            continue
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        new = np.zeros(len(frame), dtype=bool)
        new[0] = True
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield frame, starts[:-1], starts[1:]
        held = frame.iloc[starts[-1]:].reset_index(drop=True)
    if held is not None:
        yield held, np.array([0]), np.array([len(held)])


class Forest:
    """Disjoint sets over positions 0..n-1; the root of a set is its smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(x) for x in range(len(self.up))), dtype=np.int64,
                           count=len(self.up))


_U = np.uint64
_SEGMENT = 1 << 17
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@functools.lru_cache(maxsize=64)
def factors(count: int, kind: int) -> np.ndarray:
    """Odd 64-bit factors; a number times one of them, cut to 64 bits, is one hash of the number."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(kind)) | _U(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts, and where each text's words start (and the end).

    Words are runs without ASCII white space.  The texts go through together, in segments.
    """
    codes = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = ~_WHITE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    limits = np.cumsum([0] + [len(text) + 1 for text in texts])
    bounds = np.searchsorted(starts, limits)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), bounds
    weights = factors(1 << 16, 900)
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _SEGMENT)))
        low, high = starts[at], ends[to - 1]
        begin, size = starts[at:to] - low, ends[at:to] - starts[at:to]
        place = np.arange(high - low, dtype=np.int64)
        place -= np.repeat(begin, np.append(begin[1:], high - low) - begin)
        long = size.max() > 1 << 16
        part = weights[place & 0xFFFF if long else np.minimum(place, 0xFFFF)]
        if long:
            part = part * factors(int(place.max() >> 16) + 1, 901)[place >> 16]
        part *= (codes[low:high].astype(np.uint64) + _U(1)) * inside[low + 1:high + 1]
        out.append(mix(np.add.reduceat(part, begin) + size.astype(np.uint64)))
        at = to
    return np.concatenate(out), bounds
