"""Near-duplicate embeddings by an epsilon grid order join.

For unit vectors a cosine of c is a distance of sqrt(2 - 2 c) =: eps. Vectors are rotated so that a few principal directions lead,
put on a grid of width eps over these, sorted by their cells in lexicographic order and cut into blocks of ``block`` vectors. Two
blocks are joined unless the boxes of their leading coordinates and the ranges of their remaining norms prove them further apart
than eps; a joined pair is split recursively into shorter sequence intervals, each tested the same way, down to ``leaf``
vectors, which are compared in double precision (single precision only decides what is far from the threshold).

The rotation decides nothing but which blocks are skipped. Equal vectors are one class of which one takes part. A pair
of blocks returns a count per vector and a spanning forest of its links, never the links themselves, so a dense group costs
rows in proportion to its vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tasksieve.llm.components import connected_components
from tasksieve.llm.stored import small_batches, stored

_BLOCK = "block bigint, dim int, ids array<bigint>, copies array<bigint>, vectors binary, low array<double>, high array<double>, cell_low int, cell_high int"


@dataclass(frozen=True)
class EgoJoin:
    """cosine: least similarity of a link; leading: principal directions of the grid."""

    cosine: float = 0.9
    leading: int = 8
    block: int = 4096
    leaf: int = 512

    @property
    def eps(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine))


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles, or None where it cannot be compared: null, empty, with a null or non-finite component, or zero."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = column.values.is_null().to_numpy(zero_copy_only=False) if column.values.null_count else None
    found = []
    for valid, a, b in zip(column.is_valid().to_pylist(), column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist()):
        own = flat[a:b]
        good = valid and b > a and np.isfinite(own).all() and own.any() and (holes is None or not holes[a:b].any())
        found.append(own if good else None)
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that neither tiny nor huge vectors lose their norm."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _lists(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id"), pa.array([None if v is None else len(v) for v in found], pa.int32()),
            pa.array([None if v is None else hashlib.sha256((v + 0.0).tobytes()).hexdigest() for v in found], pa.string()),
            pa.array([None if v is None else v.tobytes() for v in found], pa.binary()),
        ], ["vec_id", "dim", "digest", "vector"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    vectors = batch.column("vector").to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), dim)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in _by_dim(batch):
            unit = _unit(x)
            sums[dim] = sums.get(dim, 0) + unit.T @ unit
    for dim, total in sums.items():
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["dim", "i", "j", "s"]
        )


def _rotations(reps: DataFrame, op: EgoJoin) -> dict[int, np.ndarray]:
    """Leading principal directions by dimension, from sums of dim**2 / 2 products over all vectors."""
    sums = reps.select("dim", "vector").mapInArrow(_moments, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()
    matrices: dict[int, np.ndarray] = {}
    for dim, i, j, s in sums:
        matrix = matrices.setdefault(dim, np.zeros((dim, dim)))
        matrix[i, j] = matrix[j, i] = s
    return {dim: np.linalg.eigh(m)[1][:, ::-1][:, : op.leading] for dim, m in matrices.items()}


def _coordinates(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Leading coordinates and, last, the norm of the rest: distances between these rows never exceed those of the vectors."""
    lead = unit @ rotation
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", lead, lead)))
    return np.column_stack([lead, rest])


def _cells(rotations: dict[int, np.ndarray], op: EgoJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [None] * batch.num_rows
            for dim, at, x in _by_dim(batch):
                found = np.floor(_coordinates(_unit(x), rotations[dim]) / op.eps).astype(int)
                for i, row in zip(at, found):
                    cells[i] = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "dim", "copies", "vector")), pa.array(cells, pa.list_(pa.int32()))],
                ["vec_id", "dim", "copies", "vector", "cells"],
            )

    return run


def _cutter(rotations: dict[int, np.ndarray], op: EgoJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block():
            dim = held[0][1]
            x = np.frombuffer(b"".join(r[3] for r in held), np.float64).reshape(len(held), dim)
            y = _coordinates(_unit(x), rotations[dim])
            exact = x.astype(np.float32).astype(np.float64)
            payload = (x.astype(np.float32) if np.array_equal(exact, x) else x).tobytes()
            leads = [r[4][0] for r in held]
            key = int.from_bytes(hashlib.sha256(np.array([r[0] for r in held], np.int64).tobytes()).digest()[:8], "little", signed=True)
            row = [key, dim, [r[0] for r in held], [r[2] for r in held], payload, y.min(0).tolist(), y.max(0).tolist(), min(leads), max(leads)]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "copies", "vector", "cells"))):
                if held and (len(held) == op.block or held[0][1] != row[1]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return run


def _far(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """The boxes of two sets of coordinates are more than eps apart (with a little room for rounding)."""
    gap = np.maximum(0.0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > eps * eps + 1e-9


class _Links:
    """Counts and components of the links within one pair of blocks."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.counts, self.root = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts, i, self.copies[j])
        np.add.at(self.counts, j, self.copies[i])
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            parent = np.arange(len(self.root))
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.root = parent[self.root]


def _join(x: np.ndarray, y: np.ndarray, a: tuple[int, int], b: tuple[int, int], op: EgoJoin, links: _Links, single: np.ndarray) -> None:
    """Links between the intervals a and b of the vectors x with coordinates y; a == b compares an interval with itself."""
    if a != b and _far(y[a[0] : a[1]], y[b[0] : b[1]], op.eps):
        return
    if max(a[1] - a[0], b[1] - b[0]) > op.leaf:
        halves = lambda s: [s] if s[1] - s[0] <= op.leaf else [(s[0], (s[0] + s[1]) // 2), ((s[0] + s[1]) // 2, s[1])]
        for p, left in enumerate(halves(a)):
            for q, right in enumerate(halves(b)):
                if a != b or p <= q:
                    _join(x, y, left, right, op, links, single)
        return
    near = single[a[0] : a[1]] @ single[b[0] : b[1]].T
    i, j = np.nonzero(near >= op.cosine - 1e-4)
    close = near[i, j] < op.cosine + 1e-4
    i, j = i + a[0], j + b[0]
    if a == b:
        keep = i < j
        i, j, close = i[keep], j[keep], close[keep]
    if close.any():
        exact = np.ones(len(i), bool)
        exact[close] = np.einsum("ij,ij->i", x[i[close]], x[j[close]]) >= op.cosine
        i, j = i[exact], j[exact]
    if len(i):
        links.add(i, j)


def _joiner(rotations: dict[int, np.ndarray], op: EgoJoin):
    def vectors(payload: bytes, n: int, dim: int) -> np.ndarray:
        return np.frombuffer(payload, np.float64 if len(payload) == 8 * n * dim else np.float32).reshape(n, dim).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                dim, ids, copies = row["dim"], row["ids"], row["copies"]
                x = vectors(row["vectors"], len(ids), dim)
                n = len(ids)
                if row["other"] != row["block"]:
                    x = np.concatenate([x, vectors(row["other_vectors"], len(row["other_ids"]), dim)])
                    ids, copies = ids + row["other_ids"], copies + row["other_copies"]
                unit = _unit(x)
                y, links = _coordinates(unit, rotations[dim]), _Links(np.array(copies, np.int64))
                b = (n, len(ids)) if row["other"] != row["block"] else (0, n)
                _join(unit, y, (0, n), b, op, links, unit.astype(np.float32))
                names = np.array(ids, np.int64)
                linked = np.flatnonzero(links.counts)
                # The smallest id of each local component is the other end of its members' edges.
                least = np.full(len(names), np.iinfo(np.int64).max)
                np.minimum.at(least, links.root, names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[linked]), pa.array(links.counts[linked]), pa.array(least[links.root[linked]])], ["vec_id", "links", "least"]
                )

    return run


def _block_pairs(blocks: DataFrame, op: EgoJoin) -> DataFrame:
    """Pairs (block, other) that can hold a link: neighbours on the first grid dimension whose boxes are not too far apart."""
    box = blocks.select("block", "dim", "low", "high", "cell_low", "cell_high")
    left = box.withColumn("cell", F.explode(F.sequence("cell_low", F.col("cell_high") + 1)))
    right = box.select(
        F.col("block").alias("other"), "dim", F.col("low").alias("other_low"), F.col("high").alias("other_high"), F.explode(F.sequence(F.col("cell_low"), F.col("cell_high") + 1)).alias("cell")
    )
    gaps = F.zip_with(
        F.zip_with("low", "other_high", lambda a, b: a - b), F.zip_with("other_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b)
    )
    distance = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    return left.join(right, ["dim", "cell"]).where("block <= other").where(distance <= op.eps**2 + 1e-9).select("block", "other").distinct()


def near_duplicate_vectors(embeddings: DataFrame, op: EgoJoin = EgoJoin()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``embeddings`` (vec_id, embedding array<float or double>).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different
    lengths with each other. Repeated rows are vectors of their own for the count; rows with a null vec_id stay alone, kept,
    with a null component. Other columns are not read.
    """
    spark: SparkSession = small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    read = stored(rows.mapInArrow(_read, "vec_id bigint, dim int, digest string, vector binary"), "vectors")
    usable = read.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = stored(usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    reps = usable.join(classes.select(F.col("rep").alias("vec_id"), "digest", "copies"), ["vec_id", "digest"]).dropDuplicates(["vec_id", "digest"])
    reps = stored(reps.select("vec_id", "dim", "copies", "vector"), "vector-reps")
    rotations = _rotations(reps, op)
    celled = reps.mapInArrow(_cells(rotations, op), "vec_id bigint, dim int, copies bigint, vector binary, cells array<int>")
    ordered = celled.repartitionByRange("dim", "cells", "vec_id").sortWithinPartitions("dim", "cells", "vec_id")
    blocks = stored(ordered.mapInArrow(_cutter(rotations, op), _BLOCK), "blocks")
    pairs = _block_pairs(blocks, op)
    payload = blocks.select("block", "dim", "ids", "copies", "vectors")
    others = payload.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("copies").alias("other_copies"), F.col("vectors").alias("other_vectors"))
    joined = pairs.join(payload, "block").join(others, "other").repartition(F.col("block"), F.col("other"))
    found = stored(joined.mapInArrow(_joiner(rotations, op), "vec_id bigint, links bigint, least bigint"), "vector-links")
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    named = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    usable_id = F.col("vec_id").isNotNull()
    component = F.when(usable_id, F.coalesce("component", "vec_id"))
    return read.select("vec_id", "digest").join(named, "digest", "left").select(
        "vec_id", F.when(usable_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
