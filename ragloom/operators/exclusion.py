"""Queries of exclusions alone: every chunk without a word, as id sets and ranked by distance.

A group whose terms are all excluded matches whatever holds none of its pieces.
Such a set is almost the whole table, so it is kept as what it leaves out: one
bitmap of 32,768 ids per query and range of ids, absent where nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ragloom.operators.dense import Best, Queries, Rows, blocks, matrix, numbered_blocks, ranked, stored_matrix
from ragloom.operators.lexical import match_terms
from ragloom.params import Params
from ragloom.session import settled, ship, written

BITMAP_BYTES = 4096
UNFOLDED = 16  # bitmaps whose ids are held at once


def _both(bitmaps: list[bytes]) -> bytes:
    return np.bitwise_and.reduce([np.frombuffer(b, np.uint8) for b in bitmaps]).tobytes()


@arrow_udf(T.BinaryType())
def _in_all(bitmaps: pa.Array) -> pa.Array:
    """The ids that every bitmap of a list holds."""
    return pa.array([_both(b) for b in bitmaps.to_pylist()], pa.binary())


@arrow_udf(T.BinaryType())
def _without(bitmap: pa.Array, out: pa.Array) -> pa.Array:
    """The ids of the first that the second does not hold; null holds none."""
    return pa.array([b if o is None else (np.frombuffer(b, np.uint8) & ~np.frombuffer(o, np.uint8)).tobytes()
                     for b, o in zip(bitmap.to_pylist(), out.to_pylist(), strict=True)], pa.binary())


@arrow_udf(T.ArrayType(T.LongType()))
def bitmap_ids(part: pa.Array, bitmap: pa.Array) -> pa.Array:
    """The ids of a bitmap of ``bitmap_construct_agg``."""
    return pa.array([_ids(p, b) for p, b in zip(part.to_pylist(), bitmap.to_pylist(), strict=True)], pa.list_(pa.int64()))


def bitmap_rows(sets: DataFrame) -> DataFrame:
    """A row per ``id`` of each bitmap ``ids``, with the other columns, ``part`` among them.

    A bitmap holds up to 32,768 ids, so ``UNFOLDED`` of them are unfolded at a time
    and never all of a batch.
    """
    ship(sets.sparkSession)
    kept = [f for f in sets.schema.fields if f.name != "ids"]
    names = [f.name for f in kept]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, UNFOLDED):
                b = whole.slice(lo, UNFOLDED)
                ids = [_ids(p, m) for p, m in zip(b.column("part").to_pylist(), b.column("ids").to_pylist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(ids)), [len(i) for i in ids]))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(row) for n in names), pa.array(np.concatenate(ids))], names=[*names, "id"])

    return sets.mapInArrow(unfold, T.StructType([*kept, T.StructField("id", T.LongType())]))


def _ids(part: int, bitmap: bytes) -> np.ndarray:
    at = np.flatnonzero(_bits(bitmap))
    return (part - 1) * 8 * BITMAP_BYTES + 1 + at if part > 0 else part * 8 * BITMAP_BYTES - at


def _bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)


def exclusion_groups(terms: DataFrame) -> DataFrame:
    """``(query_id, grp)`` of the groups in which every term is excluded."""
    return terms.groupBy("query_id", "grp").agg(F.bool_and("negated").alias("_all")).filter("_all").select("query_id", "grp")


def left_out(terms: DataFrame, index: DataFrame, counts: DataFrame, params: Params = Params()) -> DataFrame:
    """``(query_id, part, out)``: bitmaps of the ids that no exclusion group of the query allows.

    ``part`` is ``bitmap_bucket_number`` of the ids. A piece of a group is looked up
    like a group of its own that is wanted.
    """
    ship(terms.sparkSession)
    alone = terms.join(exclusion_groups(terms), ["query_id", "grp"], "left_semi")
    pieces = alone.select("query_id", F.col("piece").alias("grp"), "piece", F.lit(False).alias("negated"), "phrase", "off", "term")
    groups = alone.select("query_id", "piece", F.col("grp").alias("_of")).distinct()
    hits = match_terms(pieces, index, counts, params).select("query_id", F.col("grp").alias("piece"), "id").join(groups, ["query_id", "piece"])
    held = hits.groupBy("query_id", "_of", F.bitmap_bucket_number("id").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    several = groups.groupBy("query_id").agg(F.count_distinct("_of").alias("_groups"))
    # an id is out where every group excludes it
    return (
        held.groupBy("query_id", "part").agg(F.collect_list("bits").alias("_bits")).join(several, "query_id")
        .filter(F.size("_bits") == F.col("_groups")).select("query_id", "part", _in_all("_bits").alias("out"))
    )


def allowed_ids(queries: DataFrame, out: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, part, ids)``: for each of ``queries`` the bitmaps of the ids it allows.

    ``queries`` has ``query_id`` and is a bounded set; every one of them meets
    every bitmap of the table, as its answer does.
    """
    kind = queries.schema["query_id"].dataType
    names = F.array(*[F.lit(r["query_id"]).cast(kind) for r in queries.select("query_id").distinct().collect()])
    present = chunks.groupBy(F.bitmap_bucket_number("id").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    asked = present.select("part", "bits", F.explode(names).alias("query_id"))
    return asked.join(out, ["query_id", "part"], "left").select("query_id", "part", _without("bits", "out").alias("ids")).filter(F.bitmap_count("ids") > 0)


def _offer(best: Best, ids: np.ndarray, parts: np.ndarray, at: np.ndarray, vectors: np.ndarray, asked, sets: dict) -> None:
    """Offer the vectors, those of one ``part`` at a time, to the queries that allow them."""
    for part in np.unique(parts):
        here = np.flatnonzero(parts == part)
        rows = Rows(ids[here], vectors[here])
        out = {q: ~_bits(o)[at[here]] for q, o in sets.get(int(part), ())}
        for which, some in blocks(np.arange(len(asked.vectors)), len(here)):
            open_ = None
            if out:
                open_ = np.ones((len(which), len(rows.ids[some])), bool)
                for n, q in enumerate(which):
                    if q in out:
                        open_[n] = out[q][some]
            best.offer_block(which, rows, some, asked, open_, alike=False)


def allowed_topk(queries: DataFrame, out: DataFrame, chunks: DataFrame, k: int, params: Params = Params()) -> DataFrame:
    """``(query_id, id, distance, rnk)``: the k nearest chunks of each query among those it allows.

    ``queries`` has ``query_id, vector``; ``out`` is ``left_out``. Bitmaps within
    the size bound travel to the chunks; more of them meet the chunks of their
    range of ids in a task each.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, n = settled(queries.select("query_id", "vector"))
    found = []
    rows_of = chunks.select("id", "embedding", F.bitmap_bucket_number("id").alias("part"), F.bitmap_bit_position("id").alias("at"))
    for rows, names in numbered_blocks(queries, n, params.query_block):
        asked = spark.sparkContext.broadcast(Queries(stored_matrix(rows["vector"])))
        mine, n_sets = settled(out.join(F.broadcast(names), "query_id").select("_q", "part", "out"))

        def cell(parts: pa.Table, sets: pa.Table) -> pa.Table:
            best = Best(len(asked.value.vectors), k)
            if len(parts):
                held: dict = {}
                for r in sets.to_pylist():
                    held.setdefault(r["part"], []).append((r["_q"], r["out"]))
                _offer(best, *(parts[c].to_numpy() for c in ("id", "part", "at")), matrix(parts["embedding"]), asked.value, held)
            return pa.Table.from_batches([best.batch()])

        if n_sets * BITMAP_BYTES <= params.broadcast_bytes:
            sets: dict = {}
            for r in mine.collect():
                sets.setdefault(r["part"], []).append((r["_q"], r["out"]))
            sent = spark.sparkContext.broadcast(sets)

            def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Best(len(asked.value.vectors), k)
                for b in batches:
                    if b.num_rows:
                        _offer(best, *(b.column(c).to_numpy() for c in ("id", "part", "at")), matrix(b.column("embedding")), asked.value, sent.value)
                yield best.batch()

            part = rows_of.mapInArrow(nearest, "_q long, id long, distance double")
        else:
            part = rows_of.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(cell, "_q long, id long, distance double")
        found.append(written(ranked(part.join(F.broadcast(names), "_q").select("query_id", "id", "distance"), k), "allowed"))
    if not found:
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, id long, distance double, rnk int")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def with_exclusions(sparse: DataFrame, queries: DataFrame, terms: DataFrame, index: DataFrame, counts: DataFrame, chunks: DataFrame, k: int,
                    params: Params = Params()) -> DataFrame:
    """``sparse`` (query_id, id, score, rnk) with what groups of exclusions alone match.

    Such a match scores 0, so it comes behind what other alternatives found;
    among themselves the nearer chunk comes first. ``queries`` has ``query_id, vector``.
    """
    only = exclusion_groups(terms).select("query_id").distinct()
    some = queries.join(only, "query_id", "left_semi")
    near = allowed_topk(some, written(left_out(terms, index, counts, params), "left-out"), chunks, k, params)
    both = sparse.select("query_id", "id", "score", F.lit(None).cast("double").alias("distance")).unionByName(
        near.select("query_id", "id", F.lit(0.0).alias("score"), "distance"))
    one = both.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") == 0, F.col("distance")).asc_nulls_last(), "id")
    placed = one.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)
    return placed.select("query_id", "id", "score", "rnk")
