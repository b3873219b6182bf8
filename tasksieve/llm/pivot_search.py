"""Exact top-k search by inner product with a table of distances to pivots.

For vectors q and x the inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2, and every pivot p gives d(q, x) >= |d(q, p) - d(x, p)|. The
largest of these lower bounds therefore bounds the product from above. Distances to all pivots (and to the origin, which
stands for the norm) are computed once and kept with the vectors.

Equal vectors are one class with the ``k + 1`` first of its rows, all that can ever be asked for. Classes lie in tiles (nearest
pivot, then range of the distance to it), sorted, cut into blocks with the least and largest distance to each pivot. Three steps:

1. Each block answers its own queries from its own vectors; the (k+1)-th best product found is a query's threshold.
2. Boxes of tiles, a bounded number, tell to which tiles a query must travel at all; queries travel in batches, the
   candidates stay in their blocks until a batch meets them.
3. Where a batch meets a block, the bounds of the block's box are tried first, then those of each vector; vectors are
   evaluated in the order of their bounds until no query's threshold can be reached any more.

A bound is rounded in the safe direction; a candidate is skipped only if its bound lies below the threshold, or at it with a larger id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tasksieve.llm.stored import stored
from tasksieve.llm.whole_vectors import by_dim, unpacked, whole_vectors

_LONG = 2**63
#: Stands for a threshold not yet known, and for the place of a null id, which comes last.
_NONE, _LAST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class PivotSearch:
    """k: neighbours; scale: of the entries; pivots: besides the origin; sample: vectors that pivots and tiles are chosen from.

    ``tiles`` bounds the boxes that travel to the queries, ``per_tile`` is the number of classes meant for one; ``block`` and ``batch`` are
    the classes and queries a row holds at most; ``chunk`` vectors are evaluated between two looks at the bounds.
    """

    k: int = 5
    scale: int = 256
    pivots: int = 32
    sample: int = 2048
    tiles: int = 1024
    per_tile: int = 4096
    block: int = 2048
    batch: int = 1024
    chunk: int = 128


# --- pivots and tiles -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Space:
    """Pivots of one length of vectors, and the places (nearest pivot, distance) where tiles begin."""

    pivots: np.ndarray
    starts: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To each pivot, the origin first."""
        wide = x.astype(np.float64)
        square = np.einsum("ij,ij->i", wide, wide)
        apart = np.sqrt(np.maximum(0.0, square[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * (wide @ self.pivots.T)))
        return np.column_stack([np.sqrt(square), apart])

    def places(self, distances: np.ndarray) -> np.ndarray:
        """One number that sorts by nearest pivot, then by the distance to it."""
        if distances.shape[1] == 1:
            return distances[:, 0] / (1 + distances[:, 0])
        nearest = distances[:, 1:].argmin(axis=1)
        near = distances[np.arange(len(distances)), nearest + 1]
        return nearest + near / (1 + near)

    def tile(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right")


def _space(x: np.ndarray, op: PivotSearch, tiles: int) -> Space:
    """Pivots far from each other: each next one is the sampled vector farthest from those chosen."""
    wide = x.astype(np.float64)
    chosen: list[np.ndarray] = []
    nearest = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    while len(chosen) < op.pivots and len(wide) and nearest.max() > 0:
        chosen.append(wide[int(nearest.argmax())])
        nearest = np.minimum(nearest, np.sqrt(((wide - chosen[-1]) ** 2).sum(axis=1)))
    space = Space(np.array(chosen).reshape(len(chosen), x.shape[1]), np.zeros(0))
    places = np.sort(space.places(space.distances(x)))
    cuts = np.unique(places[(np.arange(1, tiles) * len(places)) // tiles]) if tiles > 1 else np.zeros(0)
    return Space(space.pivots, cuts)


def _spaces(classes: DataFrame, op: PivotSearch) -> dict[int, Space]:
    """From a sample of at most ``sample`` classes, those with the smallest hashes; lengths it misses have the origin alone."""
    n = classes.count()
    drawn = classes.select("dim", "x").orderBy(F.xxhash64("x"), "x").limit(op.sample).collect()
    by_length: dict[int, list[bytes]] = {}
    for dim, payload in drawn:
        by_length.setdefault(dim, []).append(payload)
    tiles = max(1, min(op.tiles, n // op.per_tile))
    return {dim: _space(unpacked(rows, dim), op, tiles) for dim, rows in by_length.items()}


def _space_of(spaces: dict[int, Space], dim: int) -> Space:
    return spaces.get(dim) or Space(np.zeros((0, dim)), np.zeros(0))


# --- classes and blocks ---------------------------------------------------------------------------------------------------

def _classes(rows: DataFrame, op: PivotSearch) -> DataFrame:
    """``(dim, x, asks, first array<struct<vec_id, row>>)``: distinct vectors, whether a query has it, its k + 1 first rows.

    The rank is limited before and after the shuffle, so a vector that a third of all rows share costs k + 1 rows a task.
    """
    order = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= op.k + 1)
    asking = rows.where("query").select(F.col("x").alias("asked")).distinct()
    firsts = few.groupBy("x").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list(F.struct("r", "vec_id", "row"))).alias("first"))
    return firsts.join(asking, F.col("x") == F.col("asked"), "left").select(
        "dim", "x", F.col("asked").isNotNull().alias("asks"), F.transform("first", lambda s: F.struct(s["vec_id"].alias("vec_id"), s["row"].alias("row"))).alias("first")
    )


def _placer(spaces: dict[int, Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_dim(batch):
                space = _space_of(spaces, dim)
                distances = space.distances(x)
                places = space.places(distances)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(take) for c in ("dim", "x", "asks", "first")), pa.array(space.tile(places).astype(np.int32)), pa.array(places),
                    pa.array([d.tobytes() for d in distances.astype(np.float32)], pa.binary()),
                ], ["dim", "x", "asks", "first", "tile", "place", "distances"])

    return run


_FIRST = "array<array<struct<vec_id:bigint,row:bigint>>>"
_BLOCK = f"dim int, tile int, x array<binary>, asks array<boolean>, first {_FIRST}, distances binary, low binary, high binary"
_FIRST_ARROW = pa.list_(pa.list_(pa.struct([("vec_id", pa.int64()), ("row", pa.int64())])))


def _cutter(op: PivotSearch):
    def block(held: list[dict]) -> pa.RecordBatch:
        table = np.frombuffer(b"".join(r["distances"] for r in held), np.float32).reshape(len(held), -1)
        row = [
            held[0]["dim"], held[0]["tile"], [r["x"] for r in held], [r["asks"] for r in held], [r["first"] for r in held], table.tobytes(),
            table.min(axis=0).tobytes(), table.max(axis=0).tobytes(),
        ]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.bool_()), _FIRST_ARROW, pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["dim", "tile", "x", "asks", "first", "distances", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == op.block or (held[0]["dim"], held[0]["tile"]) != (row["dim"], row["tile"])):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


# --- bounds and evaluation ------------------------------------------------------------------------------------------------

def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact; those beyond the range of a long are held at its ends."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < _LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _NONE + 1, _LONG - 1).astype(np.int64)


def _most(squares: np.ndarray, lower: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The largest whole product there can be for sums of squared norms and lower bounds of distances; ``top`` is the largest distance in play.

    Distances are kept in single precision, with an error below 1e-7 of their size, and so much is taken off the lower bounds.
    """
    safe = np.maximum(0.0, lower.astype(np.float64) - 5e-7 * top)
    return np.clip(np.floor((squares * (1 + 1e-6) - safe * safe) / 2 + 1e-3), float(_NONE), float(_LONG))


@dataclass
class _Asked:
    """Queries on their way: vectors, distances, and the best found so far (scores falling, ties by id and row)."""

    x: np.ndarray
    distances: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    @classmethod
    def fresh(cls, x: np.ndarray, distances: np.ndarray, k: int) -> "_Asked":
        shape = (len(x), k + 1)
        return cls(x, distances, np.full(shape, _NONE), np.full(shape, _LAST), np.full(shape, _LAST))

    def part(self, at: np.ndarray) -> "_Asked":
        return _Asked(self.x[at], self.distances[at], self.scores[at], self.ids[at], self.rows[at])


@dataclass(frozen=True)
class _Held:
    """Candidates of a block: vectors, distances, and the first rows of each class, null ids as the last."""

    x: np.ndarray
    distances: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, row: dict, k: int) -> "_Held":
        ids, rows = np.full((len(row["x"]), k + 1), _LAST), np.full((len(row["x"]), k + 1), _LAST)
        for i, first in enumerate(row["first"]):
            for j, one in enumerate(first):
                ids[i, j], rows[i, j] = _LAST if one["vec_id"] is None else one["vec_id"], one["row"]
        return cls(unpacked(row["x"], row["dim"]), np.frombuffer(row["distances"], np.float32).reshape(len(row["x"]), -1), ids, rows)


def _merge(asked: _Asked, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Puts candidates, one row of them for each query ``at``, among the best found."""
    keep = asked.scores.shape[1]
    s = np.concatenate([asked.scores[at], scores], axis=1)
    i = np.concatenate([asked.ids[at], ids], axis=1)
    r = np.concatenate([asked.rows[at], rows], axis=1)
    order = np.lexsort((r, i, -np.maximum(s, _NONE + 1)), axis=1)[:, :keep]
    asked.scores[at], asked.ids[at], asked.rows[at] = (np.take_along_axis(v, order, axis=1) for v in (s, i, r))


def _evaluate(asked: _Asked, held: _Held, op: PivotSearch) -> None:
    """Goes through the candidates in the order of their bounds until none can come in for any query."""
    squares = asked.distances[:, :1].astype(np.float64) ** 2 + held.distances[:, 0].astype(np.float64) ** 2
    lower = np.zeros((len(asked.x), len(held.x)), np.float32)
    for p in range(held.distances.shape[1]):
        np.maximum(lower, np.abs(asked.distances[:, p : p + 1] - held.distances[:, p]), out=lower)
    most = _most(squares, lower, np.maximum(asked.distances.max(axis=1)[:, None], held.distances.max(axis=1)))
    left = np.arange(len(held.x))
    while len(left):
        room = most[:, left] - asked.scores[:, -1:].astype(np.float64)
        hope = (room > 0) | ((room == 0) & (held.ids[left, 0] <= asked.ids[:, -1:]))
        best = np.where(hope, room, -np.inf).max(axis=0)
        left = left[np.argsort(-best, kind="stable")]
        live = int(np.isfinite(best).sum())
        if not live:
            return
        chunk, left = left[: min(live, op.chunk)], left[min(live, op.chunk) : live]
        at = np.flatnonzero((most[:, chunk] >= asked.scores[:, -1:].astype(np.float64)).any(axis=1))
        found = _products(asked.x[at], held.x[chunk])
        # Of equal vectors the class comes first that has the smallest row; k + 1 classes hold the k + 1 best rows.
        few = min(op.k + 1, len(chunk))
        first = np.lexsort((np.broadcast_to(held.rows[chunk, 0], found.shape), np.broadcast_to(held.ids[chunk, 0], found.shape), -np.maximum(found, _NONE + 1)), axis=1)[:, :few]
        scores = np.take_along_axis(found, first, axis=1)
        n = held.ids.shape[1]
        ids, rows = held.ids[chunk][first].reshape(len(at), -1), held.rows[chunk][first].reshape(len(at), -1)
        scores = np.where(rows == _LAST, _NONE, np.repeat(scores, n, axis=1))
        _merge(asked, at, scores, ids, rows)


_FOUND = "query bigint, scores array<bigint>, ids array<bigint>, rows array<bigint>"
_HOME = f"{_FOUND}, dim int, x binary, distances binary"


def _named(keys: np.ndarray, asked: _Asked) -> list[pa.Array]:
    listed = [pa.array(list(v), pa.list_(pa.int64())) for v in (asked.scores, asked.ids, asked.rows)]
    return [pa.array(keys), *listed]


def _at_home(op: PivotSearch):
    """Queries of each block against the block itself. A class of queries is named by the first of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = _Held.of(row, op.k)
                at = np.flatnonzero(row["asks"])
                for start in range(0, len(at), op.batch):
                    own = at[start : start + op.batch]
                    asked = _Asked.fresh(held.x[own], held.distances[own], op.k)
                    _evaluate(asked, held, op)
                    yield pa.RecordBatch.from_arrays([
                        *_named(held.rows[own, 0], asked), pa.array([row["dim"]] * len(own), pa.int32()), pa.array([row["x"][i] for i in own], pa.binary()),
                        pa.array([d.tobytes() for d in asked.distances], pa.binary()),
                    ], [c.split()[0] for c in _HOME.split(", ")])

    return run


def _asked_of(batch: pa.RecordBatch, at: np.ndarray, x: np.ndarray, k: int) -> _Asked:
    lists = [np.array(batch.column(c).take(pa.array(at)).to_pylist(), np.int64).reshape(len(at), k + 1) for c in ("scores", "ids", "rows")]
    distances = np.frombuffer(b"".join(batch.column("distances").take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
    return _Asked(x, distances, *lists)


def _boxes(blocks: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Least and largest distances to each pivot by tile; their number is bounded by that of lengths, tiles and pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, tile, low, high in zip(*(batch.column(c).to_pylist() for c in ("dim", "tile", "low", "high"))):
                a, b = np.frombuffer(low, np.float32), np.frombuffer(high, np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(a), pa.int32()), pa.array([tile] * len(a), pa.int32()), pa.array(range(len(a)), pa.int32()), pa.array(a), pa.array(b)],
                    ["dim", "tile", "pivot", "low", "high"],
                )

    rows = blocks.select("dim", "tile", "low", "high").mapInArrow(run, "dim int, tile int, pivot int, low float, high float")
    found: dict[tuple[int, int], tuple[list, list]] = {}
    for dim, tile, _, low, high in rows.groupBy("dim", "tile", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "tile", "pivot").collect():
        box = found.setdefault((dim, tile), ([], []))
        box[0].append(low)
        box[1].append(high)
    return {key: (np.array(a, np.float32), np.array(b, np.float32)) for key, (a, b) in found.items()}


def _reaches(asked: _Asked, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a vector within the box can come in for a query; ties are let through."""
    lower = np.maximum(0.0, np.maximum(low - asked.distances, asked.distances - high)).max(axis=1)
    top = np.maximum(asked.distances.max(axis=1), high.max())
    most = _most(asked.distances[:, 0].astype(np.float64) ** 2 + float(high[0]) ** 2, lower, top)
    return most >= asked.scores[:, -1].astype(np.float64)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_BATCH = f"dim int, tile int, n int, {', '.join(f'{c} binary' for c in ('keys', 'vectors', 'table', 'scores', 'ids', 'rows'))}"


def _traveller(boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], op: PivotSearch):
    """Batches of the queries that a tile may have something for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, op.batch):
            keys = batch.column("query").to_numpy()
            for dim, at, x in by_dim(batch):
                asked = _asked_of(batch, at, x, op.k)
                for (length, tile), box in boxes.items():
                    if length != dim:
                        continue
                    goes = np.flatnonzero(_reaches(asked, *box))
                    for start in range(0, len(goes), op.batch):
                        few = goes[start : start + op.batch]
                        part = asked.part(few)
                        row = [dim, tile, len(few), *(v.tobytes() for v in (keys[at[few]].astype(np.int64), part.x, part.distances, part.scores, part.ids, part.rows))]
                        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _BATCH.split(", ")])

    return run


def _meeting(op: PivotSearch):
    """A batch of queries and a block of candidates; gives what has come in from the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, dim = row["n"], row["dim"]
                lists = [np.frombuffer(row[f"q_{c}"], np.int64).reshape(n, -1) for c in ("scores", "ids", "rows")]
                asked = _Asked(np.frombuffer(row["q_vectors"], np.int64).reshape(n, dim), np.frombuffer(row["q_table"], np.float32).reshape(n, -1), *lists)
                keys = np.frombuffer(row["q_keys"], np.int64)
                goes = np.flatnonzero(_reaches(asked, np.frombuffer(row["low"], np.float32), np.frombuffer(row["high"], np.float32)))
                if not len(goes):
                    continue
                held = _Held.of(row, op.k)
                part = asked.part(goes)
                before = part.rows.copy()
                _evaluate(part, held, op)
                changed = np.flatnonzero((part.rows != before).any(axis=1))
                yield pa.RecordBatch.from_arrays(_named(keys[goes[changed]], part.part(changed)), [c.split()[0] for c in _FOUND.split(", ")])

    return run


def top_products(embeddings: DataFrame, query: str, op: PivotSearch = PivotSearch()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each row for which the SQL condition ``query`` holds,
    with all other rows of ``embeddings`` (vec_id, embedding array<float or double>), ties to the smaller vec_id.

    Entries count as floor(scale * entry). Vectors that are null or hold null or non-finite entries take no part, nor do those with an entry
    of 2**53 / scale or more. Products are formed between vectors of one length only; those beyond the range of a long are held
    at its ends. Repeated rows are rows of their own, so an id can come up twice in an answer, and an id asked for twice has two
    answers. Rows with a null id are candidates, after all others on a tie, and queries only if the condition says so. No queries, no
    rows; fewer than ``k`` others, fewer rows.
    """
    read = whole_vectors(embeddings, op.scale).select("vec_id", "dim", "x", F.expr(f"coalesce({query}, false)").alias("query"))
    rows = stored(read.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    classes = stored(_classes(rows, op), "vector-classes")
    spaces = _spaces(classes, op)
    fields = f"dim int, x binary, asks boolean, first {_FIRST[6:-1]}"
    placed = classes.mapInArrow(_placer(spaces), f"{fields}, tile int, place double, distances binary")
    ordered = placed.repartitionByRange("dim", "tile", "place", "x").sortWithinPartitions("dim", "tile", "place", "x")
    blocks = stored(ordered.mapInArrow(_cutter(op), _BLOCK), "blocks")
    home = stored(blocks.mapInArrow(_at_home(op), _HOME), "home-answers")
    batches = home.mapInArrow(_traveller(_boxes(blocks), op), _BATCH)
    asked = batches.select("dim", "tile", "n", *[F.col(c).alias(f"q_{c}") for c in ("keys", "vectors", "table", "scores", "ids", "rows")])
    # The planner takes a batch for as small as a home answer and would broadcast them all; they outgrow the driver.
    met = blocks.select("dim", "tile", "x", "first", "distances", "low", "high").join(asked.hint("merge"), ["dim", "tile"])
    found = stored(met.mapInArrow(_meeting(op), _FOUND), "answers").unionByName(home.select("query", "scores", "ids", "rows"))
    entries = found.select("query", F.explode(F.arrays_zip("scores", "ids", "rows")).alias("e")).select("query", "e.*").where(F.col("rows") != _LAST).distinct()
    order = Window.partitionBy("query").orderBy(F.col("scores").desc(), "ids", "rows")
    best = entries.withColumn("r", F.row_number().over(order)).where(F.col("r") <= op.k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "scores", "ids", "rows"))).alias("best"))
    # From classes of queries to the rows that ask: each leaves out itself.
    named = classes.where("asks").select("x", F.element_at("first", 1)["row"].alias("query")).join(lists, "query").select("x", "best")
    each = rows.where("query").select("vec_id", "row", "x").join(named, "x").select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda e: e["rows"] != F.col("row")), 1, op.k).alias("best")
    )
    return each.select("query_id", F.posexplode("best").alias("p", "e")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.when(F.col("e.ids") != _LAST, F.col("e.ids")).alias("vec_id"), F.col("e.scores").alias("score")
    )
