"""Nearest chunks by cosine distance, exact and approximate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ragloom.functions.vectors import DISTANCE_PLACES
from ragloom.params import Params
from ragloom.session import one_row, settled, ship, written

CELLS = 1 << 21  # distances held at once by one task
SENT_ROWS = 1 << 16  # queries that travel at once, at most
SPREAD_PAIRS = 1 << 32  # from so many pairs on the vectors are dealt out evenly first
NO_ID = np.iinfo(np.int64).max  # an empty place


def stored_matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column to a matrix of its own number type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pc.min_max(column.value_lengths()).as_py()
    if column.null_count or widths["min"] != widths["max"]:
        raise ValueError("a vector is missing, or the vectors differ in width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column to a float64 matrix."""
    return stored_matrix(column).astype(np.float64)


def lengths_of(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def units_of(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; rows without a direction stay zero."""
    return np.divide(m, lengths[:, None], out=np.zeros(m.shape), where=lengths[:, None] > 0).astype(np.float32)


class Queries:
    """Query vectors as they are sent; what follows from them is worked out where it is used."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    @cached_property
    def lengths(self) -> np.ndarray:
        return lengths_of(self.vectors.astype(np.float64))

    @cached_property
    def units(self) -> np.ndarray:
        return units_of(self.vectors.astype(np.float64), self.lengths)


class Rows:
    """Stored vectors of a batch."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        lengths = lengths_of(vectors)
        self.units, self.lost = units_of(vectors, lengths), ~(lengths > 0)
        self._first: np.ndarray | None = None

    def first(self, k: int) -> np.ndarray:
        """Whether a row is among the ``k`` smallest ids of those with its very vector."""
        if self._first is None:
            whole = np.ascontiguousarray(self.vectors).view(np.dtype((np.void, self.vectors.itemsize * self.vectors.shape[1]))).ravel()
            _, group = np.unique(whole, return_inverse=True)
            order = np.lexsort((self.ids, group))
            sizes = np.bincount(group)
            self._first = np.empty(len(group), bool)
            self._first[order] = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
        return self._first


class Best:
    """Running k smallest (distance, id) per query; ties fall to the id."""

    def __init__(self, n_queries: int, k: int, bound: np.ndarray | None = None):
        self.k = k
        self.d = np.full((n_queries, k), np.inf)
        self.i = np.full((n_queries, k), NO_ID)
        self.worst = np.full(n_queries, np.inf) if bound is None else bound.copy()

    def offer(self, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        if not len(q):
            return
        mine, at = np.unique(q, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(mine)), self.k), at])
        d, i = np.concatenate([self.d[mine].ravel(), d]), np.concatenate([self.i[mine].ravel(), i])
        order = np.lexsort((i, d, q))
        sizes = np.bincount(q)
        first = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(self.k)]
        self.d[mine], self.i[mine] = d[first], i[first]
        full = mine[self.i[mine, -1] != NO_ID]
        self.worst[full] = np.minimum(self.worst[full], self.d[full, -1])

    def offer_pairs(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, vectors: np.ndarray, asked) -> None:
        """Measure single pairs of a query and a vector; ``asked`` has ``vectors`` and ``lengths``."""
        step = max(1, CELLS // max(1, vectors.shape[1]))
        for lo in range(0, len(q), step):
            a, b = q[lo : lo + step], x[lo : lo + step]
            left, right = asked.vectors[a].astype(np.float64), vectors[b]
            scale = asked.lengths[a] * np.sqrt((right * right).sum(axis=1))
            away = np.full(len(a), np.inf)
            np.divide((left * right).sum(axis=1), scale, out=away, where=scale > 0)
            away = np.where(scale > 0, np.round(1.0 - away, DISTANCE_PLACES) + 0.0, np.inf)
            near = away <= self.worst[a]
            self.offer(a[near], away[near], ids[b[near]])

    def offer_block(self, which: np.ndarray, rows: Rows, part: slice, asked, close: np.ndarray | None = None, alike: bool = True, pairs=None) -> None:
        """Measure a block of queries against some rows, of which ``close`` says what counts.

        Cosines are taken in single precision first. Only pairs whose error lets them be
        among the k best are measured, in double precision. ``alike``: ``close`` says
        the same of equal vectors, so of a crowd of copies the k smallest ids will do.
        ``pairs(q, x)`` says the same as ``close`` of some pairs only: it is asked about
        those that are near enough, and about all where the bounds say too little.
        """
        ids = rows.ids[part]
        idle = ~(asked.lengths[which] > 0)
        if idle.any():  # nothing is near to them, so their bounds hold back nothing: the smallest ids
            self._offer_idle(which[idle], ids, None if close is None else close[idle])
        near = asked.units[which] @ rows.units[part].T
        near[:, rows.lost[part]] = -2
        slack = (rows.vectors.shape[1] + 8) * 2.0**-23  # twice the error of a sum of products
        limit = 1 - self.worst[which]
        limit[idle] = np.inf

        def tightened(some: np.ndarray) -> None:
            """The k-th of the block bounds its queries too."""
            if len(some) and near.shape[1] > self.k:
                limit[some] = np.maximum(limit[some], np.partition(near[some], -self.k, axis=1)[:, -self.k] - slack)

        def passing() -> np.ndarray:
            return np.flatnonzero(near >= np.maximum(limit - slack, -2.5).astype(np.float32)[:, None])

        if pairs is not None:
            at = passing()
            if len(at) <= 2 * self.k * len(which):
                q, x = np.divmod(at, near.shape[1])
                kept = pairs(q, x)
                self.offer_pairs(which[q[kept]], x[kept], ids, rows.vectors[part], asked)
                return
            close = pairs(*np.divmod(np.arange(near.size), near.shape[1])).reshape(near.shape)
        if close is not None:
            near[~close] = -3
        tightened(np.flatnonzero(np.isneginf(limit)))
        at = passing()
        if len(at) > 2 * self.k * len(which):  # the bound says little yet
            tightened(np.arange(len(which)))
            at = passing()
        q, x = np.divmod(at, near.shape[1])
        if alike and len(at) > 2 * self.k * len(which):
            few = rows.first(self.k)[part][x]
            q, x = q[few], x[few]
        if len(q):
            self.offer_pairs(which[q], x, ids, rows.vectors[part], asked)

    def _offer_idle(self, which: np.ndarray, ids: np.ndarray, close: np.ndarray | None) -> None:
        first = np.argsort(ids, kind="stable")
        if close is None:
            q, x = np.repeat(np.arange(len(which)), min(self.k, len(ids))), np.tile(first[: self.k], len(which))
        else:
            q, x = np.nonzero(close[:, first] & (np.cumsum(close[:, first], axis=1) <= self.k))
            x = first[x]
        low = ids[x] < self.i[which[q], -1]
        self.offer(which[q[low]], np.full(low.sum(), np.inf), ids[x[low]])

    def scan_batch(self, batch: pa.RecordBatch, queries) -> None:
        self.scan(batch.column("id").to_numpy(), matrix(batch.column("embedding")), queries)

    def scan_codes(self, batch: pa.RecordBatch, sent) -> None:
        """``sent``: the queries and which codes each one probes."""
        self.scan_coded(batch.column("id").to_numpy(), matrix(batch.column("embedding")), batch.column("code").to_numpy(), *sent)

    def scan_coded(self, ids, vectors, codes, queries, probes) -> None:
        """Measure vectors code by code, each against the queries that probe its code."""
        for c in np.unique(codes):
            which = np.nonzero(probes[:, c])[0]
            if len(which):
                here = codes == c
                self.scan(ids[here], vectors[here], queries, which)

    def scan(self, ids, vectors, queries, which=None) -> None:
        """Measure a batch of vectors against the queries (or the ``which`` of them)."""
        rows = Rows(ids, vectors)
        which = np.arange(len(queries.vectors)) if which is None else which
        for some, part in blocks(which, len(ids)):
            self.offer_block(some, rows, part, queries)

    def batch(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.i != NO_ID)
        d = self.d[q, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(self.i[q, place]), pa.array(d, mask=np.isinf(d))],
            names=["_q", "id", "distance"],
        )


def blocks(which: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, slice]]:
    """Queries and rows in blocks of at most ``CELLS`` pairs."""
    wide = max(1, min(n_rows, 4096))
    step = max(1, CELLS // wide)
    for lo in range(0, n_rows, wide):
        for at in range(0, len(which), step):
            yield which[at : at + step], slice(lo, lo + wide)


_PARTIAL = "_q bigint, id bigint, distance double"


def ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    return partial.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def dense_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    params: Params = Params(),
    vector: str = "vector",
    embedding: str = "embedding",
) -> DataFrame:
    """``(query_id, id, distance, rnk)``: the k nearest chunks of every query.

    ``queries`` has ``query_id`` and ``vector``; ``chunks`` has ``id`` and
    ``embedding``. Queries travel to the chunks in blocks, so chunk vectors are
    not shuffled (but once where ``SPREAD_PAIRS`` are measured) and at most k rows
    per query leave a task; with several blocks only rows leave that are no worse
    than the k-th of a sample of the chunks.
    """
    qs = queries.select("query_id", F.col(vector).alias("vector"))
    cs = chunks.select("id", F.col(embedding).alias("embedding"))
    ship(queries.sparkSession)
    qs, n = settled(qs)
    return _blocks_topk(qs, n, cs, k, params, Best.scan_batch)


def _stacked(rows) -> Queries:
    """Query rows, or an Arrow table of them, as they are sent."""
    if isinstance(rows, pa.Table):
        return Queries(stored_matrix(rows["vector"]))
    return Queries(np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), -1))


def sent_rows(queries: DataFrame, params: Params, besides: int = 0) -> int:
    """How many queries travel at once: ``query_block`` of them, and more while they fit into ``broadcast_bytes``.

    ``besides`` counts what goes with the vector of a query, in bytes.
    """
    widest = queries.agg(F.max(F.size("vector"))).head()[0] or 1
    return max(params.query_block, min(SENT_ROWS, params.broadcast_bytes // (8 * widest + besides)))


def numbered_blocks(queries: DataFrame, n: int, at_once: int) -> Iterator[tuple[pa.Table, DataFrame]]:
    """A settled query set in blocks of about ``at_once`` rows: the rows, and ``(_q, query_id)``."""
    n_blocks = math.ceil(n / at_once)
    for block in range(n_blocks):
        mine = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        rows = mine.toArrow()  # a block
        if len(rows):
            names = pa.table({"_q": pa.array(np.arange(len(rows))), "query_id": rows["query_id"]})
            yield rows, queries.sparkSession.createDataFrame(names)


def _bounds(chunks: DataFrame, sent, n_queries: int, k: int, scan) -> np.ndarray:
    """The k-th distance of each query among the given chunks; no limit where there are fewer."""
    worst = np.full(n_queries, np.inf)
    found = ranked(_partial(chunks, sent, n_queries, k, scan).withColumnRenamed("_q", "query_id"), k)
    last = found.filter((F.col("rnk") == k) & F.col("distance").isNotNull()).select("query_id", "distance").toArrow()  # a row a query of the block
    worst[last["query_id"].to_numpy()] = last["distance"].to_numpy()
    return worst


def _partial(chunks: DataFrame, sent, n_queries: int, k: int, scan, bound: np.ndarray | None = None) -> DataFrame:
    """The k best of each query in each task."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_queries, k, bound)
        for b in batches:
            if b.num_rows:
                scan(best, b, sent.value)
        yield best.batch()

    return chunks.mapInArrow(nearest, _PARTIAL)


def _blocks_topk(queries: DataFrame, n: int, chunks: DataFrame, k: int, params: Params, scan, prepared=_stacked) -> DataFrame:
    """Block after block of the queries is sent to where the chunks lie.

    Where far more pairs are measured than vectors read, the chunks are first written
    in even parts, so that the layout of the table does not decide how many tasks work.

    ``prepared`` makes of the rows of a block what is sent; ``scan(best, batch, sent)``
    offers a batch of chunks to the best rows.
    """
    sc, several, found = queries.sparkSession.sparkContext, n > params.query_block, []
    few = None
    if several:
        total = chunks.count()
        if n * total > SPREAD_PAIRS:
            chunks = written(chunks.repartition(2 * sc.defaultParallelism), "spread")
        steps = math.ceil(max(1, total) / params.slab_rows)
        few = chunks.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) == 0) if steps > 1 else None
    for rows, names in numbered_blocks(queries, n, sent_rows(queries, params) if several else params.query_block):
        sent = sc.broadcast(prepared(rows))
        bound = None if few is None else _bounds(few, sent, len(rows), k, scan)
        part = _partial(chunks, sent, len(rows), k, scan, bound).join(F.broadcast(names), "_q").select("query_id", "id", "distance")
        found.append(written(ranked(part, k), "nearest") if several else ranked(part, k))
        if several:
            sent.unpersist()
    if not found:
        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, id long, distance double, rnk int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# --- approximate -----------------------------------------------------------

def plane_signs(planes: int, dim: int) -> np.ndarray:
    """Signs of the hashing planes: +1 or -1 from the parity of md5("plane:axis")."""
    parity = lambda p, d: int(hashlib.md5(f"{p}:{d}".encode()).hexdigest()[7], 16) & 1
    return np.array([[1.0 - 2.0 * parity(p, d) for d in range(dim)] for p in range(planes)])


def _probes(queries: np.ndarray, planes: int, radius: int) -> np.ndarray:
    """Which codes each query probes, as a (query, code) table."""
    codes = ((queries @ plane_signs(planes, queries.shape[1]).T > 0) * (1 << np.arange(planes))).sum(axis=1)
    differing = np.array([bin(x).count("1") for x in range(1 << planes)])
    return differing[codes[:, None] ^ np.arange(1 << planes)[None, :]] <= radius


def plane_code(vector: Column, planes: int, dim: int) -> Column:
    """Random-hyperplane code of a vector (Charikar 2002), one bit per plane."""
    signs = plane_signs(planes, dim)

    @arrow_udf("int")
    def code(column: pa.Array) -> pa.Array:
        bits = (matrix(column) @ signs.T) > 0
        return pa.array((bits * (1 << np.arange(planes))).sum(axis=1), pa.int32())

    return code(vector)


def approximate_topk(
    queries: DataFrame,
    coded_chunks: DataFrame,
    k: int,
    planes: int,
    radius: int,
    params: Params = Params(),
) -> DataFrame:
    """Like ``dense_topk`` over the chunks whose code differs in at most ``radius`` bits.

    ``coded_chunks`` has ``id, embedding, code``; a table stored by ``code``
    prunes its files to the probed codes. Chunks are measured where they lie, so
    a code holding a third of all rows is spread over as many tasks as its files.
    """
    ship(queries.sparkSession)
    small, n = settled(queries.select("query_id", "vector"))

    def prepared(rows):
        sent = _stacked(rows)
        return sent, _probes(sent.vectors.astype(np.float64), planes, radius)

    coded = coded_chunks.select("id", "embedding", "code")
    if n <= params.query_block:  # codes that no query probes are not read
        probed = _probes(_stacked(small.toArrow()).vectors.astype(np.float64), planes, radius).any(axis=0) if n else np.zeros(1 << planes, bool)
        coded = coded.filter(F.col("code").isin([int(c) for c in np.flatnonzero(probed)]))
    return _blocks_topk(small, n, coded, k, params, Best.scan_codes, prepared)


def candidate_fraction(queries: DataFrame, coded_chunks: DataFrame, planes: int, radius: int) -> DataFrame:
    """Share of (query, chunk) pairs the approximate search measures.

    Works on code counts (at most 2**planes rows a side), not on pairs of rows.
    """
    q = queries.groupBy(F.col("code").alias("q_code")).agg(F.count(F.lit(1)).alias("nq"))
    c = coded_chunks.groupBy("code").agg(F.count(F.lit(1)).alias("nc"))
    flips = [m for m in range(1 << planes) if bin(m).count("1") <= radius]
    probes = q.select("nq", F.explode(F.array(*[F.col("q_code").bitwiseXOR(F.lit(m)) for m in flips])).alias("code"))
    return one_row(
        probes.join(c, "code").agg(F.coalesce(F.sum(F.col("nq") * F.col("nc")), F.lit(0)).alias("measured")),
        q.agg(F.sum("nq").alias("nq")),
        c.agg(F.sum("nc").alias("nc")),
    ).select("measured", (F.col("nq") * F.col("nc")).alias("pairs"),
             (F.col("measured") / (F.col("nq") * F.col("nc"))).alias("fraction"))
