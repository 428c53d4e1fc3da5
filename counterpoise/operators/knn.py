"""Exact nearest-neighbour imputation without comparing all pairs.

Distance between rows with unknown cells: sqrt(d / m * sum of squared differences over the m columns
known in both).  Donors are indexed by what they know: the most frequent patterns of known columns are
the bases, a donor belongs to the widest base that it knows all columns of, and to one cell of a tree that
cuts the base's donors along their columns.  The box around a cell's donors bounds the distance of any row
to them from below, over the columns that the row shares with all of them.  So a row first searches, for
each column it lacks, the nearest cell that has the column, and then only the cells that could hold
something nearer than what it found, also where no column is known everywhere.  Within a cell the same
boxes around every ``LEAF`` donors pass over most of them.  Equal rows are searched once and equal donors
carry a count.  Cells are cut into blocks of bounded size, so no task holds an unbounded group, whatever
share of the rows falls into one cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

BLOCK_ROWS = 20_000
MAX_PIVOTS = 4096
MAX_BASES = 64
LEAF = 64               # donors of a box within a block
ASKED = 128             # rows that are searched together
MAX_TASKS = 2000
TASK_GROUPS = 16        # small groups that a task searches, up to TASK_PAIRS pairs
TASK_PAIRS = 20_000_000
_MASK = 62              # columns that patterns tell apart
_CHUNK_CELLS = 4_000_000
_NEAR_CELLS = 1 << 14   # distances to boxes that are taken together, so that they stay near the core


def _matrix(series: pd.Series, d: int) -> np.ndarray:
    return np.array(series.tolist(), dtype=float).reshape(len(series), d)


def _block_distances(rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Scaled distances, NaN where no column is known in both."""
    total = np.zeros((len(rows), len(donors)))
    shared = np.zeros_like(total)
    for c in range(rows.shape[1]):
        left, right = rows[:, c], donors[:, c]
        if np.isnan(left).all() or np.isnan(right).all():
            continue
        diff = left[:, None] - right[None, :]
        if np.isfinite(left).all() and np.isfinite(right).all():
            shared += 1
        else:
            known = ~np.isnan(diff)
            shared += known
            diff[~known] = 0.0
        diff *= diff
        total += diff
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(total * (rows.shape[1] / np.where(shared > 0, shared, np.nan)))


def _pair_distances(rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """What :func:`_block_distances` gives, of pairs: row i with donor i."""
    total, shared = np.zeros(len(rows)), np.zeros(len(rows))
    for c in range(rows.shape[1]):
        diff = rows[:, c] - donors[:, c]
        known = ~np.isnan(diff)
        shared += known
        diff[~known] = 0.0
        diff *= diff
        total += diff
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(total * (rows.shape[1] / np.where(shared > 0, shared, np.nan)))


class _Squares:
    """Squares of distances by products of matrices: quick, and off by ``SLACK`` times the donor's and the row's
    squares at most.  That is little where cells are finite and not far from 0 in terms of their spread."""

    FAR = 1e3
    SLACK = 1e-12

    def __init__(self, donors: np.ndarray):
        self.known, flat = self._flat(donors)
        self.square = (flat ** 2).sum(1)
        self.sides = np.hstack([self.known, flat ** 2, flat])

    @staticmethod
    def _flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(rows)
        return known.astype(float), np.where(known, rows, 0.0)

    @classmethod
    def fit(cls, rows: np.ndarray, donors: np.ndarray) -> bool:
        top = max(np.nanmax(np.abs(side), initial=0.0) for side in (rows, donors))
        if not top < 1e100:
            return False
        known, flat = cls._flat(donors)
        count = np.maximum(known.sum(0), 1.0)
        spread = (flat ** 2).sum(0) / count - (flat.sum(0) / count) ** 2
        return bool(top ** 2 <= cls.FAR ** 2 * spread.max(initial=0.0))

    def to(self, rows: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the rows' distances to the donors at ``spots``, NaN where no column is known in both, and by how
        much those of each row can be off."""
        known, flat = self._flat(rows)
        d = rows.shape[1]
        total = np.hstack([flat ** 2, known, -2 * flat]) @ self.sides[spots].T
        shared = known @ self.known[spots].T
        if shared.min(initial=1) < 1:
            shared[shared < 1] = np.nan
        total /= shared
        total *= d
        return total, self.SLACK * d * ((flat ** 2).sum(1) + self.square[spots].max(initial=0.0))


def _widest(rows: np.ndarray, shares: np.ndarray | None = None) -> int | None:
    """The column with the largest standard deviation (times its share), if any varies."""
    with np.errstate(invalid="ignore"):
        spread = np.nan_to_num(rows.std(axis=0)) * (1.0 if shares is None else shares)
    return int(spread.argmax()) if spread.max(initial=0.0) > 0 else None


def _leaves(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows in groups of up to ``size`` that know the same columns, as far as there are enough
    of them, and lie close together."""
    known = np.packbits(~np.isnan(rows), axis=1)
    _, kind = np.unique(known, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    out, few = [], []
    for same in np.split(order, np.flatnonzero(np.diff(kind.ravel()[order])) + 1):
        if len(same) < size:
            few.append(same)
            continue
        left = [same]
        while left:
            part = left.pop()
            column = _widest(rows[part]) if len(part) > size else None
            if column is None:
                out.extend(np.array_split(part, math.ceil(len(part) / size)))
            else:
                part = part[np.argpartition(rows[part, column], len(part) // 2)]
                left += [part[len(part) // 2:], part[:len(part) // 2]]
    if few:
        rest = np.concatenate(few)
        out.extend(np.array_split(rest, math.ceil(len(rest) / size)))
    return [part for part in out if len(part)]


@dataclass(frozen=True)
class Boxes:
    """Limits of groups of donors, and whether some or all of a group know a column."""

    low: np.ndarray
    high: np.ndarray
    some: np.ndarray
    every: np.ndarray

    @staticmethod
    def around(donors: np.ndarray, starts: np.ndarray) -> Boxes:
        known = ~np.isnan(donors)
        return Boxes(np.minimum.reduceat(donors, starts), np.maximum.reduceat(donors, starts),
                     np.logical_or.reduceat(known, starts), np.logical_and.reduceat(known, starts))

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """What the distance of rows to any donor of each group is at least; NaN where none shares a column."""
        low, high = np.where(self.every, self.low, -np.inf), np.where(self.every, self.high, np.inf)
        total = np.zeros((len(rows), len(low)))
        step = max(1, _NEAR_CELLS // len(low))
        with np.errstate(invalid="ignore"):
            for c in np.flatnonzero(self.every.any(0)):
                least, most = np.ascontiguousarray(low[:, c])[None, :], np.ascontiguousarray(high[:, c])[None, :]
                for start in range(0, len(rows), step):
                    own = rows[start:start + step, c][:, None]
                    away = least - own
                    np.maximum(away, own - most, out=away)
                    np.fmax(away, 0.0, out=away)
                    away *= away
                    total[start:start + step] += away
        shared = (~np.isnan(rows)).astype(float) @ self.some.T.astype(float)
        return np.sqrt(total * (rows.shape[1] / np.where(shared > 0, shared, np.nan)))

    def first(self, rows: np.ndarray, bound: np.ndarray, open_cells: np.ndarray) -> np.ndarray:
        """Which groups each row searches first: for each open column the nearest group with that column; among
        equally near ones that with the nearest middle."""
        with np.errstate(invalid="ignore"):
            middle = np.where(self.every, (self.low + self.high) / 2, np.nan)
        pick = np.zeros(bound.shape, dtype=bool)
        for c in np.flatnonzero(open_cells.any(0)):
            mine = np.flatnonzero(open_cells[:, c])
            near = np.where(self.some[:, c], bound[mine], np.nan)
            mine, near = mine[~np.isnan(near).all(1)], near[~np.isnan(near).all(1)]
            if not len(mine):
                continue
            least = np.nanmin(near, axis=1)
            row, group = np.nonzero(near == least[:, None])
            with np.errstate(invalid="ignore"):
                away = np.nansum((rows[mine][row] - middle[group]) ** 2, axis=1)
            order = np.lexsort((group, away, row))
            row, group = row[order], group[order]
            ahead = np.flatnonzero(np.diff(row, prepend=-1))
            pick[mine[row[ahead]], group[ahead]] = True
        return pick

    def within(self, bound: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which groups could hold something as near as ``limit`` says for a column that they know."""
        # a hair of slack keeps ties that rounding would cut off
        least = bound * (1 - 1e-9) - 1e-12
        pick = np.zeros(bound.shape, dtype=bool)
        with np.errstate(invalid="ignore"):
            for c in np.flatnonzero((limit >= 0).any(0)):
                pick |= (least <= limit[:, c][:, None]) & self.some[:, c][None, :]
        return pick


def _merged(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of candidates (row, d, x, n) the nearest of each row until their counts reach k."""
    row, d, x, n = (np.concatenate(side) for side in zip(*parts))
    order = np.lexsort((x, d, row))
    row, d, x, n = row[order], d[order], x[order], n[order]
    if len(row):
        ahead = np.cumsum(n) - n
        start = np.flatnonzero(np.diff(row, prepend=-1))
        ahead -= np.repeat(ahead[start], np.diff(np.append(start, len(row))))
        kept = ahead < k
        row, d, x, n = row[kept], d[kept], x[kept], np.minimum(n, k - ahead)[kept]
    return row, d, x, n


def _nearest(rows: np.ndarray, donors: np.ndarray, count: np.ndarray, k: int, reach: np.ndarray
             ) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row and unknown column the nearest donors within its ``reach``, until their counts reach k,
    as arrays (row, column, distance, value, count)."""
    leaves = _leaves(donors, LEAF)
    order = np.concatenate(leaves)
    ends = np.cumsum([len(leaf) for leaf in leaves])
    starts = ends - [len(leaf) for leaf in leaves]
    donors, count = donors[order], count[order]
    known, boxes = ~np.isnan(donors), Boxes.around(donors, starts)
    squares = _Squares(donors) if _Squares.fit(rows, donors) else None
    for chunk in _leaves(rows, ASKED):
        asked = rows[chunk]
        limit = np.where(np.isnan(asked), reach[chunk], -1.0)
        bound = boxes.bounds(asked)
        found: dict[int, tuple[np.ndarray, ...]] = {}
        done = np.zeros(len(leaves), dtype=bool)
        for start in (True, False):
            pick = boxes.first(asked, bound, np.isinf(limit)) if start else boxes.within(bound, limit)
            turn = np.flatnonzero(pick.any(0) & ~done)
            done[turn] = True
            if not len(turn):
                continue
            spots = np.concatenate([np.arange(starts[i], ends[i]) for i in turn])
            if squares is not None:
                dist, off = squares.to(asked, spots)
            else:
                dist, off = _block_distances(asked, donors[spots]) ** 2, np.zeros(len(asked))
            for c in np.flatnonzero((limit >= 0).any(0)):
                mine, has = np.flatnonzero(limit[:, c] >= 0), np.flatnonzero(known[spots, c])
                if not len(has):
                    continue
                near = dist[np.ix_(mine, has)] if len(has) < len(spots) or len(mine) < len(asked) else dist
                most = (limit[mine, c] * (1 + 1e-9)) ** 2
                # what could be near enough by the quick squares is measured again, column by column
                with np.errstate(invalid="ignore"):
                    could = near <= (most + 2 * off[mine])[:, None]
                    if len(has) > 4 * k and np.count_nonzero(could) > 4 * k * len(mine):
                        # no more than the k nearest and their ties, also where the limit lets many through
                        most = np.fmin(most, np.partition(near, k - 1, axis=1)[:, k - 1] * (1 + 1e-9))
                        could = near <= (most + 2 * off[mine])[:, None]
                    row, spot = np.nonzero(could)
                at = spots[has[spot]]
                gap = _pair_distances(asked[mine[row]], donors[at])
                close = gap <= (limit[mine, c] * (1 + 1e-9))[row]
                row, at, gap = row[close], at[close], gap[close]
                new = (mine[row], gap, donors[at, c], count[at])
                row, d, x, n = found[c] = _merged([found[c], new] if c in found else [new], k)
                full = np.bincount(row, weights=n, minlength=len(asked)) >= k
                last = np.flatnonzero(np.diff(row, append=-1))
                last = last[full[row[last]]]
                limit[row[last], c] = np.minimum(limit[row[last], c], d[last])
        for c, (row, d, x, n) in found.items():
            yield chunk[row], np.full(len(row), c), d, x, n


_CAND = "qid long, col int, d double, x double, n long"


def _search(queries: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, col, d, x, n) from every (cell, block, part) that both sides share."""
    keys = ["cell", "block", "part"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            d = len(left["v"].iloc[0])
            ids, reach = left["qid"].to_numpy(), _matrix(left["reach"], d)
            for row, col, dist, x, n in _nearest(_matrix(left["v"], d), _matrix(right["v"], d),
                                                 right["n"].to_numpy(), k, reach):
                out.append(pd.DataFrame({"qid": ids[row], "col": col, "d": dist, "x": x, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "col": [], "d": [], "x": [], "n": []})

    return queries.groupBy(*keys).cogroup(donors.groupBy(*keys)).applyInPandas(run, _CAND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge candidates: the nearest until their counts reach k, as (qid, col, cands)."""
    merged = found.groupBy("qid", "col").agg(F.array_sort(F.collect_list(F.struct("d", "x", "n"))).alias("cands"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"),
                     F.array().cast("array<struct<d:double,x:double,n:bigint>>").alias("kept"))
    trimmed = F.aggregate("cands", empty, lambda acc, c: F.when(acc["used"] >= k, acc).otherwise(
        F.struct((acc["used"] + c["n"]).alias("used"), F.concat(acc["kept"], F.array(F.struct(
            c["d"].alias("d"), c["x"].alias("x"),
            F.least(c["n"], k - acc["used"]).alias("n")))).alias("kept"))))
    return merged.select("qid", "col", trimmed["kept"].alias("cands"))


def _spread(df: DataFrame, tiles: DataFrame, own: str, other: str) -> DataFrame:
    """Number the row's own piece of its cell, and copy it to each piece of the other side."""
    return (df.join(F.broadcast(tiles), "cell")
            .withColumn(own, F.pmod(F.xxhash64("v"), F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .drop("parts", "blocks"))


@dataclass(frozen=True)
class Cells:
    """Trees of all bases: ``columns[b]`` of base b; ``trees[b]`` its cuts ``(column, value, below, above)``, where
    a child under zero is the cell ``-1 - child`` of the base; the last cell has what fits none."""

    d: int
    columns: list[np.ndarray]
    trees: list[list[tuple[int, float, int, int]]]

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0] + [len(tree) + 1 for tree in self.trees])

    def home(self, rows: np.ndarray) -> np.ndarray:
        """Cell of each donor."""
        cell = np.full(len(rows), self.offsets[-1])
        left = np.ones(len(rows), dtype=bool)
        for columns, tree, offset in zip(self.columns, self.trees, self.offsets):
            mine = np.flatnonzero(left & ~np.isnan(rows[:, columns]).any(1))
            left[mine] = False
            open_nodes = [(0 if tree else -1, mine)]
            while open_nodes:
                node, part = open_nodes.pop()
                if node < 0:
                    cell[part] = offset - 1 - node
                    continue
                column, value, below, above = tree[node]
                low = rows[part, column] <= value
                open_nodes += [(below, part[low]), (above, part[~low])]
        return cell


def _tree(points: np.ndarray, columns: np.ndarray, cells: int, shares: np.ndarray) -> list[tuple[int, float, int, int]]:
    """Cuts of the points into up to ``cells`` cells, the largest cell first, along the column that varies most,
    times the share of asked rows that know it."""
    tree: list[list] = []
    leaves = [(points, None, 0)]            # points, the cut above and the side of it
    closed = []
    while leaves and len(leaves) + len(closed) < cells:
        at = max(range(len(leaves)), key=lambda i: len(leaves[i][0]))
        part, above, side = leaves.pop(at)
        place = _widest(part[:, columns], shares[columns]) if len(part) > 1 else None
        if place is None:
            closed.append((part, above, side))
            continue
        column = int(columns[place])
        values = np.sort(part[:, column])
        value = values[(len(values) - 1) // 2]
        if value == values[-1]:
            value = values[values < value][-1]
        if above is not None:
            tree[above][side] = len(tree)
        low = part[:, column] <= value
        leaves += [(part[low], len(tree), 2), (part[~low], len(tree), 3)]
        tree.append([column, float(value), 0, 0])
    for i, (_, above, side) in enumerate(leaves + closed):
        if above is not None:
            tree[above][side] = -1 - i
    return [tuple(cut) for cut in tree]


def _mask_of(d: int) -> Column:
    return sum((F.when(F.col("v")[i].isNotNull(), F.lit(1 << i)).otherwise(0).cast("long")
                for i in range(1, min(d, _MASK))), F.when(F.col("v")[0].isNotNull(), F.lit(1)).otherwise(0).cast("long"))


def _cells(pool: DataFrame, d: int, pivots: int, shares: np.ndarray) -> Cells:
    """Bases and trees for ``pool (v, n)``: two bounded lists come to the driver.

    Cells are dealt to bases by their share of the donors, and cut at vectors drawn by a hash."""
    marked = pool.withColumn("mask", _mask_of(d))
    counted = marked.groupBy("mask").count().where("mask <> 0").orderBy(F.desc("count"), "mask").limit(MAX_BASES).collect()
    sizes = {r["mask"]: r["count"] for r in counted}
    total = max(1, sum(sizes.values()))
    drawn: dict[int, list] = {}
    rows = marked.where(F.col("mask").isin(list(sizes))).orderBy(F.xxhash64("v"), "v").limit(8 * pivots).collect() \
        if sizes else []
    for r in rows:
        drawn.setdefault(r["mask"], []).append(r["v"])
    columns, trees = [], []
    for mask in sorted(drawn, key=lambda m: (-m.bit_count(), -sizes[m], m)):
        places = np.array([i for i in range(min(d, _MASK)) if mask >> i & 1])
        points = np.array(drawn[mask], dtype=float)
        points = points[~np.isnan(points[:, places]).any(1)]
        columns.append(places)
        trees.append(_tree(points, places, max(1, round(pivots * sizes[mask] / total)), shares))
    return Cells(d, columns, trees)


def knn_impute(df: DataFrame, donors: DataFrame, columns: list[str], k: int = 5,
               block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """Fill each unknown cell with the mean of the k nearest donors that know the column.

    Where no donor shares a known column with the row, the donors' column mean is used.  There are ``pivots``
    cells at least, and more where these would hold over ``block_rows`` donors on average.
    """
    spark, d = df.sparkSession, len(columns)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    gap = F.exists("v", lambda x: x.isNull())
    pool = cut_lineage(donors.select(vector.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    asked = cut_lineage(df.select(vector.alias("v")).filter(gap).distinct())

    facts = pool.agg(F.count(F.lit(1)), *[F.try_divide(
        F.sum(F.col("v")[i] * F.col("n")), F.sum(F.when(F.col("v")[i].isNotNull(), F.col("n"))))
        for i in range(d)]).first()
    means = facts[1:d + 1]
    told = asked.agg(F.count(F.lit(1)), *[F.count(F.col("v")[i]) for i in range(d)]).first()
    n_pool, n_asked = facts[0], told[0]
    if not n_asked or not n_pool:
        return df
    pivots = min(MAX_PIVOTS, max(pivots or 1, n_pool // block_rows))
    shares = np.array(told[1:], dtype=float) / n_asked
    index = _cells(pool, d, pivots, shares) if pivots > 1 else Cells(d, [], [])

    def place(batches):
        for batch in batches:
            batch["cell"] = index.home(_matrix(batch["v"], d))
            yield batch

    pool = cut_lineage(pool.mapInPandas(place, "v array<double>, n bigint, cell int"))
    asked = cut_lineage(asked.withColumn("qid", F.monotonically_increasing_id()))
    value = [F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]) for i in range(d)]
    cells = pool.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *[f(x) for f in (F.min, F.max, F.count)
                                                                        for x in value]).collect()
    size = {r["cell"]: r["rows"] for r in cells}
    blocks = {c: math.ceil(n / block_rows) for c, n in size.items()}
    low, high = (np.full((index.offsets[-1] + 1, d), np.nan) for _ in range(2))
    some, every = (np.zeros((index.offsets[-1] + 1, d), dtype=bool) for _ in range(2))
    for r in cells:
        low[r["cell"]], high[r["cell"]] = (np.array(r[2 + s * d:2 + (s + 1) * d], dtype=float) for s in (0, 1))
        known = np.array(r[2 + 2 * d:2 + 3 * d])
        some[r["cell"]], every[r["cell"]] = known > 0, known == r["rows"]
    boxes = Boxes(low, high, some, every)
    step = max(1, _CHUNK_CELLS // len(low))

    def picked(batches, later: bool):
        """Rows with the cells that they search first, or with all others that could hold something nearer."""
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                rows = _matrix(part["v"], d)
                bound = boxes.bounds(rows)
                pick = boxes.first(rows, bound, np.isnan(rows))
                if later:
                    limit = np.where(np.isnan(rows), _matrix(part["reach"], d), -1.0)
                    pick = boxes.within(bound, limit) & ~pick
                row, cell = np.nonzero(pick)
                yield part.iloc[row].assign(cell=cell)

    def search(queries: DataFrame) -> DataFrame:
        counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect() if r["cell"] in blocks}
        shared = [(c, math.ceil(n / block_rows), blocks[c]) for c, n in counts.items()]
        tiles = spark.createDataFrame(shared, "cell int, parts int, blocks int")
        # a task's work is not told by its bytes, so tasks are not put together by them but by groups and pairs
        groups, pairs = sum(p * b for _, p, b in shared), sum(n * size[c] for c, n in counts.items())
        tasks = max(1, min(MAX_TASKS, 2 * groups, max(groups // TASK_GROUPS, pairs // TASK_PAIRS)))
        return _search(*[_spread(side, tiles, own, other).repartition(tasks, "cell", "block", "part")
                         for side, own, other in ((queries, "part", "block"), (pool, "block", "part"))], k)

    schema = "qid long, v array<double>, reach array<double>, cell int"
    anywhere = asked.select("qid", "v", F.array_repeat(F.lit(float("inf")), d).alias("reach"))
    found = cut_lineage(search(cut_lineage(anywhere.mapInPandas(lambda b: picked(b, False), schema))))
    if index.trees:
        # how far a row must look: its k-th distance, or anywhere if a column has fewer than k
        far = _best(found, k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("col", F.when(
            F.aggregate("cands", F.lit(0).cast("bigint"), lambda a, c: a + c["n"]) >= k,
            F.element_at("cands", -1)["d"])))).alias("far"))
        reach = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                            lambda i: F.coalesce(F.col("far")[i], F.lit(float("inf"))))
        wide = asked.join(far, on="qid", how="left").select("qid", "v", reach.alias("reach"))
        more = cut_lineage(wide.mapInPandas(lambda b: picked(b, True), schema))
        found = found.unionByName(search(more))

    total = F.aggregate("cands", F.lit(0.0), lambda a, c: a + c["x"] * c["n"])
    held = F.aggregate("cands", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    filled = asked.join(_best(found, k).groupBy("qid").agg(F.map_from_entries(F.collect_list(
        F.struct("col", (total / held).alias("mean")))).alias("fill")), "qid").select("v", "fill")
    out = lookup(df.withColumn("_v", F.when(F.exists(vector, lambda x: x.isNull()), vector)),
                 filled, {"_v": "v"}, ["fill"])
    return out.select(*[
        F.coalesce(F.col(c).cast("double"), F.col("fill")[columns.index(c)],
                   F.lit(means[columns.index(c)])).alias(c) if c in columns else F.col(c)
        for c in df.columns])
