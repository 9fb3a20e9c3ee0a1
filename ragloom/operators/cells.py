"""Inverted file for nearest chunks: vectors stored by cell, searched cell by cell.

Centres are trained on a bounded sample by Lloyd rounds, every vector is stored
under its nearest centre together with its angle to it and a code of random
hyperplanes. A search first measures the cells nearest to a query; the distance
of its k-th row there bounds what is worth measuring elsewhere:

- exact: a cell, or a vector in it, whose angles to the centre prove by the
  triangle inequality that it lies beyond the bound is passed over;
- approximate: besides, only the nearest cells that hold a given share of all
  vectors are read, and only vectors are measured whose code differs from the
  query's in no more bits than the bound makes likely.

Vectors stay where they are stored; queries are sent in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.vectors import DISTANCE_PLACES
from ragloom.operators.dense import CELLS, Best, Rows, blocks, lengths_of, matrix, numbered_blocks, ranked, sent_rows, stored_matrix, units_of
from ragloom.params import Params
from ragloom.session import settled, ship, written

SLACK = 1e-6  # radians; more than rounding can move an angle


@dataclass(frozen=True)
class CellIndex:
    """``vectors``: id, embedding, away (angle to the centre), code, stored by ``cell``.

    ``centres`` holds a unit row per cell, at most twice ``max_cells``; ``sizes`` and
    ``reach`` are the number of vectors of each cell and the widest angle among them.
    """

    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray


def id_hash(name: str) -> Column:
    return F.md5(F.col(name).cast("string").cast("binary"))


def unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def similarities(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosines, rounded so that equal centres tie and the first one is taken."""
    return np.round(units @ centres.T, DISTANCE_PLACES)


def nearest_centre(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its cosine; a bounded number of cosines is held at once."""
    step = max(1, CELLS // max(1, len(centres)))
    cell, near = np.zeros(len(units), np.int64), np.zeros(len(units))
    for lo in range(0, len(units), step):
        some = similarities(units[lo : lo + step], centres)
        cell[lo : lo + step] = some.argmax(axis=1)
        near[lo : lo + step] = some.max(axis=1)
    return cell, near


@lru_cache(4)
def planes(bits: int, dim: int) -> np.ndarray:
    """Hyperplanes whose entries are the first 32 bits of md5("plane:axis"), centred."""
    entry = lambda p, d: int(hashlib.md5(f"{p}:{d}".encode()).hexdigest()[:8], 16) - (1 << 31)
    return np.array([[entry(p, d) for d in range(dim)] for p in range(bits)], np.float64)


def codes(m: np.ndarray, bits: int) -> np.ndarray:
    """A row of 64-bit words per vector, one bit a plane (Charikar 2002)."""
    above = (m @ planes(bits, m.shape[1]).T > 0).astype(np.uint8)
    return np.packbits(above, axis=1, bitorder="little").view("<u8")


def code_matrix(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), bits // 64)


# --- training ---------------------------------------------------------------

def _lloyd(sample: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after one round, and how many vectors each one had."""
    sent = sample.sparkSession.sparkContext.broadcast(centres)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.shape)
        n = np.zeros(len(total), np.int64)
        for b in batches:
            if b.num_rows:
                rows = unit(matrix(b.column("embedding")))
                cell, _ = nearest_centre(rows, sent.value)
                np.add.at(total, cell, rows)
                n += np.bincount(cell, minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.float64()))], ["cell", "n", "total"])

    def added(parts: pa.Table) -> pa.Table:
        total = matrix(parts["total"]).sum(axis=0)
        return pa.table({"cell": parts["cell"][:1], "n": [pc.sum(parts["n"]).as_py()], "total": pa.array([total], pa.list_(pa.float64()))})

    kind = "cell long, n long, total array<double>"
    found = sample.mapInArrow(sums, kind).groupBy("cell").applyInArrow(added, kind).collect()  # a row a cell
    out, n = centres.copy(), np.zeros(len(centres), np.int64)
    for r in found:
        n[r["cell"]] = r["n"]
        out[r["cell"]] = np.round(unit(np.array([r["total"]])), 6)[0]
    sent.unpersist()
    return out, n


def _with_cell(df: DataFrame, centres: np.ndarray, bits: int | None) -> DataFrame:
    """id, embedding, cell and, with ``bits``, away and code."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column("embedding")) if b.num_rows else np.zeros((0, sent.value.shape[1]))
            cell, near = nearest_centre(unit(rows), sent.value)
            cols = [b.column("id"), b.column("embedding"), pa.array(cell.astype(np.int32))]
            if bits:
                away = np.arccos(np.clip(near, -1, 1))
                cols += [pa.array(away), pa.array([r.tobytes() for r in codes(rows, bits)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = [df.schema["id"], df.schema["embedding"], T.StructField("cell", T.IntegerType())]
    kind += [T.StructField("away", T.DoubleType()), T.StructField("code", T.BinaryType())] if bits else []
    names = [f.name for f in kind]
    return df.select("id", "embedding").mapInArrow(assign, T.StructType(kind))


def train_centres(chunks: DataFrame, n: int, params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and the share of the sample that each one has.

    The sample is all chunks up to ``cell_train_rows`` a cell, and beyond that
    about as many, taken by a hash of the id. A cell that gets over four times
    the mean is split: vectors of it become further centres and the rounds go on.
    """
    cells = params.cells or min(params.max_cells, max(1, round(math.sqrt(n))))
    part = min(1.0, cells * params.cell_train_rows / max(1, n))
    sample = chunks.select("id", "embedding").filter(F.exists("embedding", lambda x: x != 0))
    if part < 1:
        sample = sample.filter(F.conv(F.substring(id_hash("id"), 1, 8), 16, 10).cast("long") < int(part * (1 << 32)))
    sample = written(sample, "cell-sample")
    first = sample.orderBy(id_hash("id"), "id").limit(cells).collect()
    if not first:
        return np.zeros((1, 1)), np.ones(1)
    centres = np.round(unit(np.array([r["embedding"] for r in first], np.float64)), 6)
    for _ in range(params.cell_rounds):
        centres, sizes = _lloyd(sample, centres)
    mean = sizes.sum() / len(sizes)
    more = {int(c): math.ceil(sizes[c] / mean) - 1 for c in np.flatnonzero(sizes > 4 * mean)}
    if more:
        wanted = sample.sparkSession.createDataFrame(list(more.items()), "cell int, more int")
        place = F.row_number().over(Window.partitionBy("cell").orderBy(id_hash("id"), "id"))
        split = _with_cell(sample, centres, None).join(F.broadcast(wanted), "cell").withColumn("place", place).filter("place <= more")
        # fewer rows than cells
        added = sorted(split.select("cell", "place", "embedding").collect(), key=lambda r: (r["cell"], r["place"]))
        centres = np.concatenate([centres, np.round(unit(np.array([r["embedding"] for r in added], np.float64)), 6)])
        for _ in range(params.cell_rounds):
            centres, sizes = _lloyd(sample, centres)
    return centres, sizes / max(1, sizes.sum())


def build_cells(chunks: DataFrame, params: Params = Params()) -> CellIndex:
    """Train centres and store every vector of ``chunks`` (id, embedding) by cell.

    A cell of over ``slab_rows`` vectors is written by as many tasks as it needs,
    so a cell with a third of all rows is no hot key.
    """
    spark = chunks.sparkSession
    ship(spark)
    n = chunks.count()
    centres, shares = train_centres(chunks, n, params)
    slices = spark.sparkContext.broadcast(np.ceil(shares * n / params.slab_rows).clip(1).astype(int).tolist())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, turn = b.column("cell").to_numpy(), np.arange(b.num_rows)
            yield b.append_column("slice", pa.array((turn % np.array(slices.value)[cell]).astype(np.int32) if b.num_rows else turn.astype(np.int32)))

    rows = _with_cell(chunks, centres, params.code_bits)
    rows = rows.mapInArrow(dealt, T.StructType([*rows.schema.fields, T.StructField("slice", T.IntegerType())]))
    stored = written(rows.repartition("cell", "slice").drop("slice").sortWithinPartitions("cell", "away"), "cells", "cell")
    sizes, reach = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).collect():  # a row a cell
        sizes[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    return CellIndex(stored, centres, sizes, reach)


# --- search -----------------------------------------------------------------

@dataclass(frozen=True)
class Asked:
    """A block of queries as it is sent: where to measure, and from which bound on not."""

    vectors: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    near: np.ndarray | None  # angle to each centre; None: worked out cell by cell
    wanted: np.ndarray  # query, cell: whether to measure
    bound: np.ndarray  # distance
    bits: np.ndarray  # codes that differ in more bits are not measured
    centres: np.ndarray | None = None

    @cached_property
    def units(self) -> np.ndarray:
        return units_of(self.vectors.astype(np.float64), self.lengths)

    def angles(self, which: np.ndarray, cell: int) -> np.ndarray:
        if self.near is not None:
            return self.near[which, cell]
        return np.arccos(np.clip(similarities(unit(self.vectors[which].astype(np.float64)), self.centres[cell : cell + 1])[:, 0], -1, 1))


def _differing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits each code of the one differs from each of the other."""
    out = np.zeros((len(one), len(other)), np.uint16)
    step = max(1, (CELLS >> 5) // max(1, len(other)))  # stays in the cache
    for lo in range(0, len(one), step):
        for word in range(one.shape[1]):
            out[lo : lo + step] += np.bitwise_count(one[lo : lo + step, word, None] ^ other[None, :, word])
    return out


def _measure(asked: Asked, k: int, batch: pa.RecordBatch, best: Best, counted: bool = True) -> int:
    """Offer what a batch holds to ``best``; returns how many pairs the angles and codes let through.

    Not ``counted``, angles and codes are looked at only where a distance would count.
    """
    cells, away = batch.column("cell").to_numpy(), batch.column("away").to_numpy()
    ids, vectors, measured = batch.column("id").to_numpy(), None, 0
    theta = np.arccos(np.clip(1 - np.minimum(asked.bound, 2), -1, 1)) + SLACK
    bounded, width = np.isfinite(asked.bound), asked.codes.shape[1] * 64
    marks = code_matrix(batch.column("code"), width)
    for c in np.unique(cells):
        wanting = np.flatnonzero(asked.wanted[:, c])
        if not len(wanting):
            continue
        vectors = matrix(batch.column("embedding")) if vectors is None else vectors
        here = np.flatnonzero(cells == c)
        rows, far, mark = Rows(ids[here], vectors[here]), away[here], marks[here]
        angles = asked.angles(wanting, c)
        for which, part in blocks(wanting, len(here)):
            near = angles[np.searchsorted(wanting, which)]
            limits, mine, theirs = asked.bits[which].astype(np.uint16), asked.codes[which], mark[part]
            # | angle to the centre of the one - that of the other | is the least they can lie apart
            angled = (bounded[which] & (np.maximum(far[part].max() - near, near - far[part].min()) > theta[which])).any()
            coded = (limits < width).any()
            if not counted and (angled or coded) and bounded[which].all():
                def let_through(q, x):
                    away = (np.abs(near[q] - far[part][x]) <= theta[which][q]) | ~angled
                    return away & (np.bitwise_count(mine[q] ^ theirs[x]).sum(axis=1, dtype=np.uint16) <= limits[q])

                best.offer_block(which, rows, part, asked, pairs=let_through)
                continue
            close = None
            if angled:
                close = (np.abs(near[:, None] - far[part][None, :]) <= theta[which][:, None]) | ~bounded[which][:, None]
            if coded:
                alike = _differing(mine, theirs) <= limits[:, None]
                close = alike if close is None else close & alike
            measured += len(which) * len(far[part]) if close is None else int(np.count_nonzero(close))
            best.offer_block(which, rows, part, asked, close)
    return measured


def _scan(index: CellIndex, asked: Asked, k: int, counted: bool = True) -> DataFrame:
    """``_q, id, distance`` of the best k rows of each task; ``_q`` -1 counts measured pairs in ``id``."""
    cells = [int(c) for c in np.flatnonzero(asked.wanted.any(axis=0))]
    sent = index.vectors.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, measured = Best(len(sent.value.vectors), k, sent.value.bound), 0
        for b in batches:
            measured += _measure(sent.value, k, b, best, counted) if b.num_rows else 0
        yield best.batch()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([measured]), pa.array([None], pa.float64())], names=["_q", "id", "distance"])

    return index.vectors.filter(F.col("cell").isin(cells)).select("id", "embedding", "cell", "away", "code").mapInArrow(
        nearest, "_q long, id long, distance double")


def _masks(units: np.ndarray, index: CellIndex, decide) -> list[np.ndarray]:
    """What ``decide(lo, cosines)`` makes of the cosines to all centres, a bounded number of queries at a time, end to end."""
    step = max(1, CELLS // len(index.sizes))
    parts = [decide(lo, similarities(units[lo : lo + step], index.centres) if index.sizes.any() else np.zeros((len(units[lo : lo + step]), len(index.sizes))))
             for lo in range(0, len(units), step)]
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _nearest_cells(sims: np.ndarray, sizes: np.ndarray, *at_least: float) -> list[np.ndarray]:
    """For each query its nearest cells, until they hold ``at_least`` vectors; a mask for each of these."""
    order = np.argsort(-sims, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = [np.zeros(sims.shape, bool) for _ in at_least]
    for mask, least in zip(out, at_least, strict=True):
        np.put_along_axis(mask, order, before < least, axis=1)
    return out


def cell_search(queries: DataFrame, index: CellIndex, k: int, share: float | None = None, params: Params = Params(),
                counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest rows ``(query_id, id, distance, rnk)``, and one row ``(scanned, measured, pairs)``.

    Without ``share`` the answer is that of ``dense_topk``. With it, each query
    reads its nearest cells until they hold that share of all vectors. ``scanned``
    counts the (query, vector) pairs in cells that were read for the query, ``measured``
    those that angles and codes let through; not ``counted`` it is less. Fewer than k rows come back
    only where fewer were read.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, n = settled(queries.select("query_id", "vector"))
    total, bits = int(index.sizes.sum()), params.code_bits
    found, counts = [], []
    at_once = sent_rows(queries, params, 2 * len(index.sizes)) if n > params.query_block else params.query_block
    for rows, names in numbered_blocks(queries, n, at_once):
        vectors = stored_matrix(rows["vector"])
        units = unit(vectors.astype(np.float64))
        seeds, *probed = _masks(units, index, lambda _, sims: _nearest_cells(
            sims, index.sizes, params.cell_seeds * k, *([] if share is None else [share * total])))
        asked = Asked(vectors, lengths_of(vectors.astype(np.float64)), codes(vectors.astype(np.float64), bits), None, seeds, np.full(len(rows), np.inf),
                      np.full(len(rows), bits), index.centres)
        first = written(_scan(index, asked, k), "cells-first")
        # k rows a query of the block
        seen = ranked(first.filter("_q >= 0").withColumnRenamed("_q", "query_id"), k).filter(F.col("rnk") == k).select("query_id", "distance").toArrow()
        bound = np.full(len(rows), np.inf)
        bound[seen["query_id"].to_numpy()] = seen["distance"].fill_null(np.inf).to_numpy()
        finite = np.isfinite(bound)
        theta = np.arccos(np.clip(1 - np.where(finite, bound, 2), -1, 1))
        if share is None:
            def reached(lo, sims):
                near, some = np.arccos(np.clip(sims, -1, 1)), slice(lo, lo + len(sims))
                return [(near - index.reach[None, :] <= theta[some, None] + SLACK) | ~finite[some, None]]

            wanted = _masks(units, index, reached)[0]  # noqa: B023
            limit = np.full(len(rows), bits)
        else:
            wanted = probed[0]
            p = theta / np.pi
            limit = np.where(finite, np.floor(bits * p + params.code_slack * np.sqrt(bits * p * (1 - p))), bits).astype(np.int64)
        wanted &= ~seeds & (index.sizes > 0)[None, :]
        rest = written(_scan(index, replace(asked, wanted=wanted, bound=bound, bits=limit), k, counted), "cells-rest")
        both = first.unionByName(rest)
        found.append(both.join(F.broadcast(names), "_q").select("query_id", "id", "distance"))
        scanned = int(((seeds | wanted) @ index.sizes).sum())
        counts.append(both.filter("_q < 0").agg(F.sum("id").alias("measured")).select(F.lit(scanned).alias("scanned"), "measured", F.lit(len(rows) * total).alias("pairs")))
    if not found:
        kind = queries.schema["query_id"].dataType.simpleString()
        empty = f"query_id {kind}, id long, distance double, rnk int"
        return spark.createDataFrame([], empty), spark.createDataFrame([(0, 0, 0)], "scanned long, measured long, pairs long")
    rows, count = found[0], counts[0]
    for more, c in zip(found[1:], counts[1:], strict=True):
        rows, count = rows.unionByName(more), count.unionByName(c)
    sums = [F.sum(c).cast("long").alias(c) for c in ("scanned", "measured", "pairs")]
    return ranked(rows, k), count.agg(*sums)


def cell_topk(queries: DataFrame, index: CellIndex, k: int, share: float | None = None, params: Params = Params()) -> DataFrame:
    """``(query_id, id, distance, rnk)`` by ``cell_search``."""
    return cell_search(queries, index, k, share, params, counted=False)[0]
