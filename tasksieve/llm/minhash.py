"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. A task sketches each text's shingle set: in round i every element is thrown by a fresh hash into one of t bins and a bin
   keeps the least value of the first round that reached it; round t + j throws into bin j alone, so every coordinate fills
   after at most 2 t rounds, and large sets need one or two. Two sketches agree in a coordinate with a chance equal to the
   Jaccard similarity, with the concentration of independent hashes.
2. Documents with equal sets are one class, represented by the smallest doc_id.
3. Representatives that agree in a whole band of coordinates share a bucket. In a bucket all are compared with the smallest
   one (its pivot), a star instead of all pairs; links are confirmed on the full sets and give first components.
4. What a star cannot decide are two members of different components. With D(x) the difference of x's set and the pivot's,
   |x ^ y| = |D(x) ^ D(y)|, and a link between y and an x not linked to the pivot needs D(x) and D(y) to share more than half of
   D(y) (less a correction by size). A prefix of D(y) in a fixed order, elements foreign to the pivot first, must therefore
   meet D(x), and where they first meet enough of both must be left: an equi-join on (pivot, element) finds every such pair
   without comparing all. Those pairs are confirmed on the full sets as well. No bucket is capped and no partner dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tasksieve.llm.components import connected_components
from tasksieve.llm.idfilter import id_filter, passes, place
from tasksieve.llm.stored import small_batches, stored, tidy
from tasksieve.llm.words import find_words, mix, shingle_sets

_U = np.uint64
_SKETCH = "doc_id bigint, n_shingles bigint, set_sum bigint, set_xor bigint, bands array<bigint>"


@dataclass(frozen=True)
class NearDedup:
    """shingle: words a shingle; percent: least similarity in percent; bands of rows coordinates each.

    The defaults of 25 bands of 5 miss a pair at similarity 0.85 with a chance of 4e-7.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 25
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


def fast_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t values of the fast similarity sketch of a non-empty set of 64-bit hashes."""
    values, filled = np.full(t, np.iinfo(_U).max, _U), np.zeros(t, bool)
    for i in range(2 * t):
        thrown = mix(elements + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            bins = ((thrown >> _U(40)) * _U(t) >> _U(24)).astype(np.int64)
            thrown = mix(thrown)
            if i:
                open_bins = ~filled[bins]
                bins, thrown = bins[open_bins], thrown[open_bins]
            np.minimum.at(values, bins, thrown)
            filled[bins] = True
        elif not filled[i - t]:
            values[i - t] = mix(thrown).min()
            filled[i - t] = True
        if filled.all():
            break
    return values


def _sketches(op: NearDedup):
    seeds = mix(np.arange(1, op.size + 1, dtype=_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(find_words(batch.column("text")), op.shingle)
            bands = np.zeros((len(sets), op.bands), _U)
            sums, xors = np.zeros(len(sets), _U), np.zeros(len(sets), _U)
            for i, own in enumerate(sets):
                if len(own):
                    drawn = mix(fast_sketch(own, op.size) ^ seeds).reshape(op.bands, op.rows)
                    bands[i] = mix(np.add.reduce(drawn * seeds[: op.rows], axis=1) + seeds[: op.bands])
                    sums[i], xors[i] = np.add.reduce(mix(own)), np.bitwise_xor.reduce(mix(own ^ seeds[0]))
            full = np.array([len(x) > 0 for x in sets], bool)
            offsets = np.append(0, np.cumsum(np.where(full, op.bands, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sums.view(np.int64)),
                pa.array(xors.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(bands[full].reshape(-1).view(np.int64))),
            ], ["doc_id", "n_shingles", "set_sum", "set_xor", "bands"])

    return run


def _sets(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column("place").to_numpy())))
            sets = shingle_sets(find_words(batch.column("text")), shingle)
            offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "elements"])

    return run


def _linked(op: NearDedup) -> Column:
    shared = F.size(F.array_intersect("x_set", "y_set")).cast("bigint")
    total = F.size("x_set").cast("bigint") + F.size("y_set").cast("bigint")
    return 100 * shared >= op.percent * (total - shared)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y, ...) with both full sets, joined by id so that a partner of a third of all pairs can be split.

    A doc_id that several rows share gives each of its sets; the callers' results are distinct.
    """
    return pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("elements").alias("x_set")), "x").join(
        sets.select(F.col("doc_id").alias("y"), F.col("elements").alias("y_set")), "y"
    )


def _full_sets(rows: DataFrame, pairs: DataFrame, op: NearDedup) -> DataFrame:
    """Sets of the documents in pairs, and of a few more; one for each doc_id."""
    wanted = id_filter(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))), "doc_id")
    placed = rows.where("doc_id IS NOT NULL").select("doc_id", "text", place("doc_id").alias("place"))
    return stored(placed.mapInArrow(tidy(_sets(op.shingle, wanted)), "doc_id bigint, elements array<bigint>"), "sets")


def _possible(op: NearDedup) -> Column:
    """Sizes alone allow the similarity."""
    return 100 * F.least("x_n", "y_n") >= op.percent * F.greatest("x_n", "y_n")


def _undecided(stars: DataFrame, parts: DataFrame, sets: DataFrame, sizes: DataFrame, op: NearDedup) -> DataFrame:
    """Pairs (x, y) of different components under one pivot that the delta prefixes leave as possible links."""
    part = parts.select("id", "component")
    named = stars.join(part.withColumnRenamed("id", "y").withColumnRenamed("component", "y_part"), "y", "left").join(
        part.withColumnRenamed("id", "x").withColumnRenamed("component", "x_part"), "x", "left"
    ).select("x", "y", F.coalesce("x_part", "x").alias("x_part"), F.coalesce("y_part", "y").alias("y_part"))
    mixed = named.groupBy("x").agg(F.max(F.col("x_part") != F.col("y_part")).alias("mixed")).where("mixed").select("x")
    # With s the sizes, a pair with difference d is a link iff (100 + p) d <= (100 - p) (s_x + s_y).
    over, under = 100 - op.percent, 100 + op.percent
    pivots = stars.groupBy("y").agg(F.collect_set("x").alias("pivots"))  # one per band at most
    deltas = _with_sets(named.join(mixed, "x", "left_semi").join(pivots, "y"), sets).select(
        F.col("x").alias("pivot"), "y", "y_part", "pivots",
        F.array_sort(F.array_except("y_set", "x_set")).alias("added"), F.array_sort(F.array_except("x_set", "y_set")).alias("lost"),
        F.size("x_set").cast("bigint").alias("pivot_n"), F.size("y_set").cast("bigint").alias("n"),
    ).dropDuplicates(["pivot", "y"]).withColumn("delta", F.concat("added", "lost")).withColumn("d", F.size("delta").cast("bigint"))
    outlier = under * F.col("d") > over * (F.col("pivot_n") + F.col("n"))
    spare = F.floor((F.col("d") * under - over * (F.col("pivot_n") - F.col("n"))) / F.lit(2 * under)).cast("int")
    deltas = stored(deltas.select(
        "pivot", F.col("y").alias("id"), F.col("y_part").alias("part"), "n", "d", "delta", "pivots", outlier.alias("outlier"),
        F.greatest(F.lit(0), F.least(F.col("d").cast("int"), spare + 1)).alias("prefix"),
    ), "deltas")
    left = deltas.where("outlier").select("pivot", F.col("id").alias("x"), F.col("part").alias("x_part"), F.col("n").alias("x_n"), F.col("d").alias("x_d"), F.col("pivots").alias("x_pivots"), F.posexplode("delta").alias("i", "element"))
    right = deltas.select("pivot", F.col("id").alias("y"), F.col("part").alias("y_part"), F.col("n").alias("y_n"), F.col("d").alias("y_d"), F.col("pivots").alias("y_pivots"), F.posexplode(F.slice("delta", F.lit(1), F.col("prefix"))).alias("j", "element"))
    # A link needs 2 |D(x) & D(y)| >= d_x + d_y - d; both deltas are in one order, so from their first common element on as many must follow.
    left_over = F.least(F.col("x_d") - F.col("i"), F.col("y_d") - F.col("j"))
    enough = 2 * under * left_over >= under * (F.col("x_d") + F.col("y_d")) - over * (F.col("x_n") + F.col("y_n"))
    # Any shared pivot decides a pair: the smallest does. A pair with a pivot in it was compared in its star.
    once = F.col("pivot") == F.array_min(F.array_intersect("x_pivots", "y_pivots"))
    star = F.array_contains("x_pivots", F.col("y")) | F.array_contains("y_pivots", F.col("x"))
    several = _of_several_parts(left, right)
    met = left.join(several, ["pivot", "element"]).join(right, ["pivot", "element"]).where((F.col("x_part") != F.col("y_part")) & _possible(op) & enough & once & ~star)
    return met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _of_several_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pivot, element) that members of two components hold: a group of one component has nothing to decide, however much its members share."""
    held = left.select("pivot", "element", F.col("x_part").alias("part")).unionByName(right.select("pivot", "element", F.col("y_part").alias("part")))
    return held.groupBy("pivot", "element").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("pivot", "element")


def near_duplicates(documents: DataFrame, op: NearDedup = NearDedup()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``documents`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. Equal texts are linked, repeated doc_ids give
    repeated rows; rows with a null doc_id stay alone, kept, with a null component. Rows that share a doc_id but not the text are judged
    each by its text, and the links of all of them are links of that doc_id. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored(rows.mapInArrow(tidy(_sketches(op)), _SKETCH), "sketches")
    identity = ["n_shingles", "set_sum", "set_xor"]
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy(*identity).agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", *identity])
    buckets = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("doc_id").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "x")
    stars = stored(
        buckets.withColumnRenamed("doc_id", "y").join(pivots, "bucket").where("x <> y").select("x", "y", F.col("n_shingles").alias("y_n")).distinct(), "stars"
    )
    sizes = classes.select(F.col("rep").alias("x"), F.col("n_shingles").alias("x_n"))
    sets = _full_sets(rows, stars, op)
    links = stored(_with_sets(stars.join(sizes, "x").where(_possible(op)), sets).where(_linked(op)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    parts = stored(connected_components(links), "parts")
    more = stored(_undecided(stars.select("x", "y"), parts, sets, sizes, op), "undecided")
    late = stored(_with_sets(more, sets).where(_linked(op)).select(F.col("x").alias("a"), F.col("y").alias("b")), "late-links")
    if late.head(1):
        # The first components are already stars: their edges and the late links are the whole graph.
        star_edges = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        parts = connected_components(star_edges.unionByName(late))
    named = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(*identity, F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sketches.select("doc_id", *identity).join(named, identity, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
