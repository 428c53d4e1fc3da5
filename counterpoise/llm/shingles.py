"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  In each run a set picks the shingles whose hash is
below ``CHOICE`` over its size, so two sets of Jaccard similarity 0.8 or more are expected to share
``0.8 * CHOICE`` picks or more; sets that share a pick meet in that pick's bucket.  Buckets with more than
``SMALL`` open pairs a set are split again by a second and third min-hash, one row a set, so what only shares a
frequent passage comes apart; pairs within a group that is known already are not open, so a group of any size
with a few strangers is not split, but met by the strangers.  Runs repeat until the chance that a pair at the threshold never meets is below
the wanted miss rate.  What stays in a bucket is compared by brute force: sketches first, which gives
groups of possibly similar sets, then the full sets of each group, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from counterpoise.llm.components import connected
from counterpoise.llm.shared import Forest, by_tile, factors, mix, set_aside, tiled, whole_groups, word_hashes
from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
CHOICE = 2.0            # expected picks of a set per run
LEVELS = 3
MISS = 1e-4             # wanted chance to miss a pair at the threshold, were it to go through all levels
SMALL = 200             # open pairs a set up to which a bucket is compared without a further split
WAVE = 2                # runs of the first wave
KEYED_ROWS = 50_000     # rows of a few numbers that may be broadcast, 5 MB
BLOCK = 256             # sets per block of a tile
SKETCH = 64             # one-byte min-hashes per set
SKETCH_LEAST = 0.55     # share of equal min-hashes from which sets are compared in full; 0.8 is 5 sd away
_U = np.uint64


def runs_for(miss: float = MISS, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs needed: a run misses a pair unless it shares a pick, and the min-hash of every further level."""
    once = (1 - math.exp(-threshold * CHOICE)) * threshold ** (levels - 1)
    return math.ceil(math.log(miss) / math.log(1 - once))


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``n`` lower-case words; of all words if fewer."""
    words, bounds = word_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    weights = factors(n, 1)
    runs = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n):
        runs += words[i:len(runs) + i] * weights[i]
    runs = mix(runs)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= n:
            found = np.sort(runs[low:high - n + 1])
            new = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        else:                                            # none or one
            out.append(mix((words[low:high] * weights[:high - low]).sum(keepdims=True))[:high - low])
    return out


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts).astype(np.int64)


def describe_sets(sets: list[np.ndarray], runs: int, levels: int) -> pd.DataFrame:
    """Digest, size, sketch, picks and min-hashes of sets.

    ``l0`` are picks, tokens with the run in their last five bits; ``l1`` and so on have a min-hash for each run.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = pd.DataFrame({"d1": np.zeros(len(sets), np.int64), "d2": np.zeros(len(sets), np.int64), "n": sizes})
    sketches = [b""] * len(sets)
    empty = np.empty(0, np.int64)
    picks = [[empty] * len(sets) for _ in range(levels)]
    full = np.flatnonzero(sizes)
    if len(full):
        tokens = np.concatenate([sets[i] for i in full])
        ends = np.cumsum(sizes[full])
        starts = np.r_[0, ends[:-1]]
        out.loc[full, "d1"] = _sums(mix(tokens + _U(5)), starts)
        out.loc[full, "d2"] = _sums(mix(tokens + _U(6)), starts)
        marks = np.empty((len(full), SKETCH), dtype=np.uint8)
        for k, factor in enumerate(factors(SKETCH, 2)):
            marks[:, k] = mix(np.minimum.reduceat(tokens * factor, starts)) & _U(255)
        for at, i in enumerate(full):
            sketches[i] = marks[at].tobytes()
        limit = np.minimum(1.0, CHOICE / sizes[full])
        top = np.where(limit >= 1.0, _U(2 ** 64 - 1), (limit * 2.0 ** 63).astype(np.uint64) * _U(2))
        top = np.repeat(top, sizes[full])
        where, found = [], []
        for run, factor in enumerate(factors(runs, 10)):
            hit = np.flatnonzero(tokens * factor <= top)
            where.append(hit)
            found.append((tokens[hit] & ~_U(31)) | _U(run))
        where, found = np.concatenate(where), np.concatenate(found).astype(np.int64)
        order = np.argsort(where, kind="stable")
        found = found[order]
        cuts = np.searchsorted(where[order], np.r_[0, ends])
        for at, i in enumerate(full):
            picks[0][i] = found[cuts[at]:cuts[at + 1]]
        # the others only tell sets of one bucket apart: 32 bits do
        for level in range(1, levels):
            least = np.stack([mix(np.minimum.reduceat(tokens * factor, starts)).astype(np.uint32).view(np.int32)
                              for factor in factors(runs, 10 + level)], axis=1)
            for at, i in enumerate(full):
                picks[level][i] = least[at]
    out["sketch"] = sketches
    for level in range(levels):
        out[f"l{level}"] = picks[level]
    return out


def described(docs: DataFrame, runs: int, levels: int, columns: list[str]) -> DataFrame:
    """``columns`` of each row with what :func:`describe_sets` says of its text."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields]
                       + ["d1 long", "d2 long", "n int", "sketch binary"]
                       + [f"l{level} array<{'int' if level else 'long'}>" for level in range(levels)])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256].reset_index(drop=True)
                told = describe_sets(shingle_sets(list(part["text"])), runs, levels)
                yield pd.concat([part[columns], told], axis=1)

    return docs.select(*columns, "text").mapInPandas(rows, schema)


def classes_of(told: DataFrame) -> DataFrame:
    """One row per distinct shingle set: cid, first document, number of documents, size, sketch, picks."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"),
                           F.col("th").alias("th")))
    merged = told.groupBy("d1", "d2", "n").agg(least.alias("first"), F.count(F.lit(1)).alias("copies"))
    return cut_lineage(merged.select("d1", "d2", "n", F.col("first.doc_id").alias("first_doc"),
                                     F.col("first.th").alias("first_th"), "copies")
                       .withColumn("cid", F.monotonically_increasing_id()))


def candidates(picked: DataFrame, known: DataFrame | None, runs: list[int], levels: int, small: int = SMALL
               ) -> DataFrame:
    """Rows ``(key, size, main, main_size, cid, group)`` of the buckets of ``runs`` with sets of two groups or more.

    ``picked`` has cid, l0, l1, ...; ``known (node, component)`` are the groups found so far.  A bucket whose
    sets are all in one group is left out, as they will be compared in full anyway.  ``main`` is the bucket's
    largest group, ``main_size`` how many of the bucket's sets are in it.
    """
    rows = picked.select("cid", F.explode("l0").alias("key")).withColumn(
        "run", F.col("key").bitwiseAND(31).cast("int")).where(F.col("run").isin(runs))
    if known is not None:
        # a set has few picks, so no cid is hot
        rows = lookup(rows, known, {"cid": "node"}, ["component"], stored=True, unique_left=True,
                      broadcast_rows=KEYED_ROWS)
        rows = rows.withColumn("group", F.coalesce("component", "cid")).drop("component")
    else:
        rows = rows.withColumn("group", F.col("cid"))
    told = ["size", "easy", "main", "main_size"]
    out = None
    for level in range(levels):
        slim = cut_lineage(rows)
        if known is None:
            sizes = slim.groupBy("key").agg(
                F.count(F.lit(1)).alias("size"), F.min("group").alias("low"), F.max("group").alias("high")).select(
                "*", (F.col("size") <= small).alias("easy"), F.col("low").alias("main"),
                F.lit(1).cast("long").alias("main_size"))
        else:
            top = F.max(F.struct("n", "group"))
            sizes = slim.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
                F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n").cast("double")).alias("closed"),
                F.min("group").alias("low"), F.max("group").alias("high"), top.alias("top")).select(
                "*", (F.col("size") * F.col("size").cast("double") - F.col("closed") <= F.col("size") * small).alias("easy"),
                F.col("top.group").alias("main"), F.col("top.n").alias("main_size"))
        sizes = cut_lineage(sizes.where("low < high").select("key", *told))
        live = lookup(slim, sizes, ["key"], told, count="size", stored=True, broadcast_rows=KEYED_ROWS).where(
            "size is not null")
        last = level == levels - 1
        kept = (live if last else live.where("easy")).select("key", "size", "main", "main_size", "cid", "group")
        out = kept if out is None else out.unionByName(kept)
        if last or sizes.where("not easy").isEmpty():
            return out
        rows = (live.where("not easy").select("cid", "run", "key", "group")
                .join(picked.select("cid", f"l{level + 1}"), "cid")
                .select("cid", F.xxhash64("key", F.get(f"l{level + 1}", "run")).alias("key"), "run", "group"))
    return out


def dealt(buckets: DataFrame, block: int = 4 * BLOCK) -> DataFrame:
    """Deal the rows of :func:`candidates` to tiles, so that every open pair meets in one tile.

    As :func:`tiled` does, but the sets of a main group over ``block`` sets don't meet each other: each is in one block
    alone (``tile_j`` -1), and copies of the strangers go to each such block.  So the copies grow with the strangers,
    not with the square of the group.
    """
    large = F.col("main_size") > block
    inside = large & (F.col("group") == F.col("main"))
    count = lambda c: F.ceil(c / F.lit(block)).cast("int")                             # noqa: E731
    others = count(F.when(large, F.col("size") - F.col("main_size")).otherwise(F.col("size")))
    place = lambda n: F.pmod(F.xxhash64(F.lit(17), "cid"), n).cast("int")               # noqa: E731
    tile = lambda i, j: F.struct(i.alias("tile_i"), j.alias("tile_j"))                  # noqa: E731
    alone = F.lit(-1)
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: tile(
        F.least(F.col("part"), o), F.greatest(F.col("part"), o)))
    across = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: tile(b, alone))
    return (buckets.withColumns({"inside": inside, "mains": F.when(large, count(F.col("main_size"))).otherwise(0),
                                 "others": others})
            .withColumn("part", F.when(F.col("inside"), place(F.col("mains"))).otherwise(place(F.col("others"))))
            .withColumn("tile", F.explode(F.when(F.col("inside"), F.array(tile(F.col("part"), alone)))
                                          .when(F.col("mains") > 0, F.concat(among, across)).otherwise(among)))
            .select("key", "tile.tile_i", "tile.tile_j", "cid", "group", "inside"))


def possible_groups(picked: DataFrame, runs: int, levels: int) -> DataFrame:
    """Rows ``(node, component)``: classes put together by sketches in shared buckets.

    Runs go in waves; after each, buckets that would only confirm a group are left out.
    """
    groups, edges = None, None
    for wave in [list(range(WAVE)), list(range(WAVE, runs))]:
        rows = dealt(candidates(picked, groups, wave, levels)).join(picked.select("cid", "sketch"), "cid")
        found = by_tile(rows, "key").select(
            "key", "tile_i", "tile_j", "group", "inside", "sketch").mapInPandas(_alike, "a long, b long")
        edges = cut_lineage(found if edges is None else
                            found.union(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        groups = cut_lineage(connected(edges))
    return groups


def _alike(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between the groups that the sketches of a tile put together; within a group none are compared,
    and in a tile of a large group only its sets with strangers.
    """
    need = int(SKETCH * SKETCH_LEAST)
    for frame, starts, ends in whole_groups(frames, ["key", "tile_i", "tile_j"]):
        left, right = [], []
        groups, inside, tile_j = (frame[c].to_numpy() for c in ("group", "inside", "tile_j"))
        for start, end in zip(starts, ends):
            if end - start < 2:
                continue
            side = inside[start:end] if tile_j[start] < 0 else None
            marks = np.frombuffer(b"".join(frame["sketch"].iloc[start:end]), np.uint8).reshape(-1, SKETCH)
            own = groups[start:end]
            _, first, place = np.unique(own, return_index=True, return_inverse=True)
            if len(first) < 2:
                continue
            roots = first[place]
            for i in range(len(marks) - 1):
                apart = i + 1 + np.flatnonzero((roots[i + 1:] != roots[i])
                                               & (True if side is None else side[i + 1:] != side[i]))
                if len(apart):
                    hit = apart[(marks[apart] == marks[i]).sum(axis=1) >= need]
                    for root in np.unique(roots[hit]):
                        low, high = sorted((root, roots[i]))
                        roots[roots == high] = low
            tied = first[roots[first] != first]
            left.append(own[roots[tied]])
            right.append(own[tied])
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def _similar(sets: list[np.ndarray], threshold: float, cross: np.ndarray | None) -> np.ndarray:
    """Boolean matrix of the pairs of sets with Jaccard similarity of ``threshold`` or more."""
    sizes = np.array([len(s) for s in sets])
    tokens, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    names, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[place]
    column, row = rank[place[keep]], where[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)       # counts under 2**24 are exact
    step = 8192
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        flags = np.zeros((len(sets), step), dtype=np.float32)
        flags[row[a:b], column[a:b] - low] = 1
        both += flags @ flags.T
    union = sizes[:, None] + sizes[None, :] - both
    hit = both >= threshold * union - 1e-9
    np.fill_diagonal(hit, False)
    if cross is not None:
        hit &= cross[:, None] != cross[None, :]
    return hit


def _verified(threshold: float):
    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_groups(frames, ["component", "tile_i", "tile_j"]):
            for start, end in zip(starts, ends):
                if end - start < 2:
                    continue
                part = frame.iloc[start:end]
                sets = [np.frombuffer(s, dtype=np.uint64) for s in part["tokens"]]
                mixed = part["tile_i"].iloc[0] != part["tile_j"].iloc[0]
                hit = _similar(sets, threshold, part["part"].to_numpy() if mixed else None)
                copies = part["copies"].to_numpy()
                links = hit @ copies
                forest = Forest(len(sets))
                for i, j in zip(*np.nonzero(np.triu(hit))):
                    forest.join(int(i), int(j))
                ids = part["cid"].to_numpy()
                told = np.flatnonzero(links > 0)
                yield pd.DataFrame({"a": ids[forest.roots()[told]], "b": ids[told], "links": links[told]})

    return rows


def linked(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their set's class, and the classes with their groups.

    First table: doc_id, th (a hash of the text) and cid.  Second: cid, copies, first_doc, links (documents of
    other classes that are linked directly), group_first (smallest doc_id of the group) and group_cid, one
    row per class.
    """
    levels = LEVELS
    runs = runs_for(miss, threshold, levels)
    told = cut_lineage(described(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), runs, levels,
                                 ["doc_id", "th"]))
    classes = classes_of(told.select("doc_id", "th", "d1", "d2", "n"))
    rows = lookup(told.select("doc_id", "th", "d1", "d2", "n"), classes, ["d1", "d2", "n"], ["cid"], count="copies",
                  stored=True, broadcast_rows=KEYED_ROWS)
    # picks and sketch from the row that stands for the class; repeated rows have the same ones
    heads = classes.where("n > 0").select("cid", F.col("first_doc").alias("_doc"), F.col("first_th").alias("_th"))
    picked = told.join(heads, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("th").eqNullSafe(F.col("_th"))).select(
        "cid", "sketch", *[f"l{level}" for level in range(levels)])
    picked = cut_lineage(picked)
    if picked.count() > heads.count():
        picked = cut_lineage(picked.dropDuplicates(["cid"]))
    coarse = possible_groups(picked, runs, levels)
    # full sets of the classes that have a possible partner
    wanted = cut_lineage(coarse.join(classes.select(F.col("cid").alias("node"), "copies", F.col("first_doc").alias("_doc"),
                                                    F.col("first_th").alias("_th")), "node"))
    sets = with_sets(docs, wanted)
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    met = tiled(lookup(sets, sizes, ["component"], ["size"], count="size"), "component", "size", "cid", BLOCK)
    pairs = cut_lineage(by_tile(met, "component").mapInPandas(_verified(threshold), "a long, b long, links long"))
    groups = connected(pairs.select("a", "b"))
    links = pairs.groupBy(F.col("b").alias("cid")).agg(F.sum("links").alias("links"))
    full = (classes.join(links, "cid", "left")
            .join(groups.select(F.col("node").alias("cid"), F.col("component").alias("_g")), "cid", "left")
            .select("cid", "copies", "first_doc", "first_th", F.coalesce("links", F.lit(0)).alias("links"),
                    F.coalesce("_g", "cid").alias("group_cid")))
    full = cut_lineage(full)
    order = F.struct(F.col("first_doc").isNull().alias("none"), F.col("first_doc").alias("doc"), F.col("first_th").alias("th"))
    least = full.groupBy("group_cid").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("classes"))
    named = lookup(full, least, ["group_cid"], ["least"], count="classes", broadcast_rows=KEYED_ROWS).select(
        "cid", "copies", "first_doc", "links", "group_cid", F.col("least.doc").alias("group_first"),
        F.col("least.th").alias("group_th"))
    return rows, cut_lineage(named)


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid``, ``component``, ``copies`` and the packed set of each class of ``wanted``."""
    rows = lookup(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), wanted,
                  {"doc_id": "_doc", "th": "_th"}, ["node", "component", "copies"], null_safe=True, stored=True)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                yield pd.DataFrame({"cid": part["node"].astype("int64"), "component": part["component"].astype("int64"),
                                    "copies": part["copies"].astype("int64"),
                                    "tokens": [s.tobytes() for s in shingle_sets(list(part["text"]))]})

    schema = "cid long, component long, copies long, tokens binary"
    return cut_lineage(rows.where("node is not null").mapInPandas(pack, schema).dropDuplicates(["cid"]))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: class_id (smallest doc_id reachable by links), n_links (other documents linked
    directly) and kept (whether it is its class's one document).

    Texts with equal shingle sets are copies and link to each other; texts without words (null, empty) are
    copies of each other.  Texts of fewer than five words have one shingle.  Null doc_ids come last in the order;
    among rows equal in doc_id and text all are kept or none.
    """
    rows, classes = linked(docs, threshold)
    out = lookup(rows, classes, ["cid"], ["copies", "links", "group_first", "group_th"], count="copies",
                 stored=True, broadcast_rows=KEYED_ROWS)
    kept = F.col("doc_id").eqNullSafe(F.col("group_first")) & F.col("th").eqNullSafe(F.col("group_th"))
    return out.select("doc_id", F.col("group_first").alias("class_id"),
                      (F.col("copies") - 1 + F.col("links")).alias("n_links"), kept.alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id (then hash of the text).

    Rows that agree in doc_id and text are reduced to one.  Other columns pass through, whatever their names.
    """
    rows, classes = linked(docs, threshold)
    docs, back = set_aside(docs)
    stays = classes.where(F.col("cid") == F.col("group_cid")).select(
        F.col("group_first").alias("_doc"), F.col("group_th").alias("_th"), F.lit(True).alias("_stays"))
    marked = docs.withColumn("_h", F.xxhash64("text"))
    kept = lookup(marked, stays, {"doc_id": "_doc", "_h": "_th"}, ["_stays"], null_safe=True).where("_stays")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_h"])        # texts are moved only where rows repeat
    return kept.drop("_h", "_stays").withColumnsRenamed(back)
