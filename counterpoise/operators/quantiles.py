"""Exact quantiles with linear interpolation by narrowing.

Spark's exact ``percentile`` holds every distinct value in one buffer.  Here quantile estimates cut
the range, one scan counts the rows per cut, and only the stretch that holds the wanted rank is looked
at again, until it is small enough to be ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from counterpoise.operators.prefix import count_at_most, double_array, padded

SMALL = 1_000_000
CUTS = 256


@dataclass
class _Stretch:
    """Open interval (low, high) of one column with ``below`` rows under it."""

    column: int
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: list[int]

    def holds(self) -> Column:
        x = F.col(f"c{self.column}")
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > self.low)
        if self.high is not None:
            cond = cond & (x < self.high)
        return cond


def _narrow(base: DataFrame, stretches: list[_Stretch],
            known: dict[tuple[int, int], float]) -> list[_Stretch]:
    at = double_array([i / CUTS for i in range(CUTS + 1)])
    row = base.agg(*[F.percentile_approx(F.when(s.holds(), F.col(f"c{s.column}")), at, 10_000)
                     .alias(f"q{i}") for i, s in enumerate(stretches)]).first()
    cuts = [sorted(set(q)) for q in row]
    # slot 2j: strictly between cut j-1 and cut j; slot 2j+1: equal to cut j
    cells = []
    for i, s in enumerate(stretches):
        x = F.col(f"c{s.column}")
        limits = double_array(padded(cuts[i]))
        at_most = count_at_most(limits, x, len(cuts[i]))
        slot = 2 * at_most - F.when(at_most > 0, (F.element_at(limits, at_most) == x).cast("int")
                                    ).otherwise(0)
        cells.append(F.when(s.holds(), F.struct(F.lit(i).alias("i"), slot.alias("slot"))))
    counts: dict[int, dict[int, int]] = {}
    for r in (base.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
              .groupBy("c.i", "c.slot").count().collect()):
        counts.setdefault(r["i"], {})[r["slot"]] = r["count"]
    out = []
    for i, s in enumerate(stretches):
        below = s.below
        for slot in sorted(counts.get(i, {})):
            n = counts[i][slot]
            inside = [r for r in s.ranks if below <= r < below + n]
            if inside and slot % 2:
                for r in inside:
                    known[s.column, r] = cuts[i][slot // 2]
            elif inside:
                j = slot // 2
                low = cuts[i][j - 1] if j > 0 else s.low
                high = cuts[i][j] if j < len(cuts[i]) else s.high
                out.append(_Stretch(s.column, low, high, below, n, inside))
            below += n
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    small: int = SMALL) -> dict[str, list[float | None]]:
    """Quantiles per column (null where a column has no values); nulls and NaN are left out."""
    base = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
                       .alias(f"c{i}") for i, c in enumerate(columns)])
    counts = list(base.agg(*[F.count(f"c{i}") for i in range(len(columns))]).first())
    wanted, pending = {}, []
    result: dict[str, list[float | None]] = {}
    direct = [i for i, n in enumerate(counts) if n <= small]
    if direct:                                  # a buffer of at most ``small`` values per column
        at = F.array(*[F.lit(float(p)) for p in probs])
        row = base.agg(*[F.percentile(f"c{i}", at) for i in direct]).first()
        result = {columns[i]: list(q) if q is not None else [None] * len(probs)
                  for i, q in zip(direct, row)}
    for i, n in enumerate(counts):
        if i in direct:
            continue
        spots = [(n - 1) * p for p in probs]
        wanted[i] = spots
        ranks = sorted({r for h in spots for r in (int(h), min(int(h) + 1, n - 1))})
        pending.append(_Stretch(i, None, None, 0, n, ranks))
    known: dict[tuple[int, int], float] = {}
    while any(s.rows > small for s in pending):
        large = [s for s in pending if s.rows > small]
        pending = [s for s in pending if s.rows <= small] + _narrow(base, large, known)
    if pending:
        cells = [F.when(s.holds(), F.struct(F.lit(i).alias("i"), F.col(f"c{s.column}").alias("v")))
                 for i, s in enumerate(pending)]
        ranks = F.array(*[F.array(*[F.lit(r - s.below).cast("long") for r in s.ranks])
                          for s in pending])
        w = Window.partitionBy("i").orderBy("v")
        found = (base.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
                 .groupBy("c.i", "c.v").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .select("i", "v", F.explode(F.filter(
                     F.element_at(ranks, F.col("i") + 1),
                     lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
                 ).alias("r")).collect())
        for row in found:                       # at most two ranks per column and probability
            s = pending[row["i"]]
            known[s.column, row["r"] + s.below] = row["v"]
    for i, c in enumerate(columns):
        if i not in wanted:
            continue
        last = counts[i] - 1
        values = []
        for h in wanted[i]:
            a, b = known[i, int(h)], known[i, min(int(h) + 1, last)]
            values.append(a + (b - a) * (h - int(h)))
        result[c] = values
    return {c: result[c] for c in columns}


def quantile_table(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """The same as rows (feature, prob, value)."""
    found = exact_quantiles(df, columns, probs)
    return df.sparkSession.createDataFrame(
        [(c, float(p), v) for c, values in found.items() for p, v in zip(probs, values)],
        "feature string, prob double, value double")
