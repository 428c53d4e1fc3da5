"""Mixing sources to target weights by hash thresholds, without a sort of the documents.

Every document has a hash; a source's extra copies go to the documents whose hash is below a threshold.
Word counts are summed by source and the leading bits of the hash; a running sum over that histogram
finds the bucket in which the budget ends, and only this bucket's documents are looked at with the
next bits, until the threshold falls between two hashes.  Thresholds are nested: a larger budget keeps
every document of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

WEIGHTS = (5, 2, 1)
HASH_BITS = 60
STEP_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column | str) -> Column:
    """Words in a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(*columns: str) -> Column:
    """60 bits of an MD5 over the columns, the same on every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0
                   ) -> DataFrame:
    """Targets for ``sizes (source, source_size)``: ``share`` of all words, dealt by weight.

    Sources take the weights in turn in code point order, null last.  A target stops at ``most`` times
    its source's size; the excess is dealt to the others by weight until none is above.  Only sums come
    to the driver.  A table without words has targets of 0.
    """
    spread = (sizes.withColumn("_null", F.col("source").isNull().cast("int"))
              .repartitionByRange(64, "_null", "source")
              .withColumn("_part", F.spark_partition_id()))
    spread = cut_lineage(spread)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # 64 rows
    offsets = spread.groupBy("_part").count().withColumn(
        "_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("_part").orderBy("_null", "source")
    place = F.col("_offset") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(spread.join(F.broadcast(offsets), "_part").select(
        "source", "source_size", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        stops = most * F.col("source_size")
        full = F.lit(False) if level is None else F.col("weight") * level > stops
        row = ranked.agg(F.sum(F.when(full, stops)).alias("used"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open"),
                         F.count(F.when(full, 1)).alias("n")).first()
        if not row["open"] or row["n"] == capped:
            break
        capped = row["n"]
        level = (share * total - (row["used"] or 0.0)) / row["open"]
    level = 0.0 if level is None else level
    target = F.least(F.col("weight") * level, most * F.col("source_size").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows ``(source, below)``: documents of ``sized (source, size, h)`` with ``h < below`` hold about
    ``budget`` words of ``budgets (source, budget)``.

    The threshold lies before or after the document in which the budget ends, whichever is nearer.
    Documents with equal hashes stay together.
    """
    live = sized.where("size > 0")
    found = budgets.select("source", F.col("budget").alias("left"))
    done = None
    shift = HASH_BITS
    while True:
        shift -= STEP_BITS
        step = F.shiftright("h", shift)
        tops = found.select("source", "left")
        cells = live.groupBy("source", step.alias("cell")).agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells = cells.join(tops.withColumnRenamed("source", "_s"),
                           F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        # at most 2**STEP_BITS cells of one source
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        edge = (cells.withColumn("upto", upto)
                .where("upto > left and upto - words <= left")
                .select("source", "cell", "words", (F.col("left") - F.col("upto") + F.col("words")).alias("left"),
                        "lo", "hi"))
        edge = cut_lineage(edge)
        # one hash left: take it if that is nearer to the budget
        ended = edge.where("lo = hi").select(
            "source", F.when(F.col("left") * 2 >= F.col("words"), F.col("hi") + 1)
            .otherwise(F.col("lo")).alias("below"))
        done = ended if done is None else done.union(ended)
        found = edge.where("lo < hi").select("source", "cell", "left")
        if found.isEmpty():
            return done
        live = cut_lineage(
            lookup(live, found, ["source"], ["cell"], null_safe=True).where(step == F.col("cell")).drop("cell"))


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``sized (source, size, h)``: source_size, target, ``whole`` (copies of every
    document) and ``below`` (documents with ``h < below`` get one copy more).

    A null source is a source of its own; sources without words get no copies.
    """
    sizes = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut_lineage(targets.withColumn("whole", whole.cast("long")).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")))
    below = thresholds(sized, plan.where("source_size > 0").select("source", "budget"))
    return lookup(plan, below, ["source"], ["below"], null_safe=True, unique_left=True).select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    Rows that agree in doc_id and text stay together.  Null texts have size 0; their copies add nothing.
    Only sums by source are joined back, so texts are not moved.  Other columns pass through.
    """
    sized = cut_lineage(docs.select("source", size_of("text").alias("size"), hash_of("doc_id", "text").alias("h")))
    plan = cut_lineage(plan_mix(sized, weights, share, most))
    rows = docs.withColumn("size", size_of("text")).withColumn("_h", hash_of("doc_id", "text"))
    placed = lookup(rows, plan, ["source"], ["source_size", "target", "whole", "below"], null_safe=True, stored=True)
    return placed.withColumn("copies", F.col("whole") + (F.col("_h") < F.col("below")).cast("long")).drop(
        "whole", "below", "_h")


def report(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes."""
    slim = cut_lineage(docs.select("doc_id", "source", size_of("text").alias("size"),
                                   hash_of("doc_id", "text").alias("h")))
    plan = plan_mix(slim)
    placed = lookup(slim, plan, ["source"], ["source_size", "target", "whole", "below"], null_safe=True)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * (
        F.col("whole") + (F.col("h") < F.col("below")).cast("long"))).alias("taken"))


REPORT_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from sources),
ordered as (
  select *, sum(source_size) over () * 1.5::double as total,
         coalesce(sum(2.0::double * source_size) over (order by source_size / weight, source
           rows between unbounded preceding and 1 preceding), 0)::double as used_before,
         sum(weight) over (order by source_size / weight desc, source desc) as open_from
  from weighted),
level as (
  select coalesce(max((total - used_before) / open_from), 0) as lv from ordered
  where 2.0::double * source_size / weight >= (total - used_before) / open_from),
targets as (
  select o.source, o.source_size, least(o.weight * lv, 2.0::double * o.source_size) as target
  from ordered o, level),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as budget
  from targets),
runs as (
  select source, h, words, sum(words) over (partition by source order by h) as upto
  from (select source, h, sum(size) as words from sized where size > 0 group by source, h)),
cuts as (
  select b.source, case when (b.budget - (r.upto - r.words)) * 2 >= r.words then r.h + 1 else r.h end as below
  from budgets b join runs r on r.source is not distinct from b.source
  where r.upto > b.budget and r.upto - r.words <= b.budget)
select s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.whole + case when s.h < coalesce(c.below, 0) then 1 else 0 end))::bigint as taken
from sized s
join budgets b on b.source is not distinct from s.source
left join cuts c on c.source is not distinct from s.source
"""
