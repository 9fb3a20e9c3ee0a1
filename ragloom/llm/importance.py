"""Resampling of documents towards a target collection by hashed n-gram importance weights.

A feature is a run of 1 to ``max_n`` consecutive words; its bucket is the crc32 of
its bytes modulo ``buckets``. The gain of a bucket is the floored thousandfold
log ratio of its smoothed shares in the target and in all documents; a document's
weight is the floored mean of the gains of its features. Gumbel noise from a hash of
the id makes the best scores a draw without replacement.

The cutoff is found by weighted median-of-medians selection: each block of the
scores that remain gives its median, the driver takes the median of these
weighted by the blocks' sizes, and a count of the scores above it says which
side to discard, a quarter at least each round. What then lies above the cutoff is sorted.

Null texts have no words; a document without features has weight 0. A null id is
hashed as an empty text and comes last among equal scores. Rows that repeat an id
are documents of their own; among equal ids and scores the order of the rows decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import table, utf8
from ragloom.llm.registry import query
from ragloom.llm.spans import WORD, Words, batch_words, crc32, joined
from ragloom.operators.chunking import in_order, number_rows
from ragloom.session import written


@dataclass(frozen=True)
class ImportanceParams:
    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20  # of documents that may be drawn
    percent: int = 10  # of these that are drawn, floored
    seed: str = "2024"
    block_rows: int = 1 << 16  # scores that give one median
    sort_rows: int = 10_000  # remaining scores that the driver sorts to end the search


# -- features ----------------------------------------------------------------


def features(words: Words, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and lengths in ``words.data`` of the runs of each size, and the texts they lie in."""
    ends = words.starts + words.lengths
    for n in range(1, max_n + 1):
        first = np.arange(max(0, len(words) - n + 1))
        first = first[words.text[first] == words.text[first + n - 1]]
        yield words.starts[first], ends[first + n - 1] - words.starts[first], words.text[first]


def bucket_counts(texts: DataFrame, params: ImportanceParams, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket; a task leaves one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for words in batch_words(batch.column("text"), WORD):
                words = joined(words)
                for starts, lengths, _ in features(words, params.max_n):
                    counts += np.bincount(crc32(words.data, starts, lengths) % params.buckets, minlength=params.buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    parts = texts.select(utf8(texts[text_col]).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(params.buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray, params: ImportanceParams) -> np.ndarray:
    """The floored thousandfold log ratio of each bucket's shares, one added to every count."""
    s, t = docs.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * float(docs.sum() + params.buckets) / ((s + 1) * float(target.sum() + params.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """Floored thousandfold Gumbel noise from the first 32 bits of sha256(``seed:id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, params: ImportanceParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight and score of every document."""
    rows = docs.select(docs[id_col].alias("id"), utf8(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words in batch_words(batch.column("text"), WORD):
                words, here = joined(words), slice(words.lo, words.hi)
                n_words[here] = np.bincount(words.text, minlength=words.hi - words.lo)
                for starts, lengths, text in features(words, params.max_n):
                    gained = np.zeros(words.hi - words.lo, np.int64)
                    np.add.at(gained, text, gain[crc32(words.data, starts, lengths) % params.buckets])
                    total[here] += gained
                    n_features[here] += np.bincount(text, minlength=words.hi - words.lo)
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c) for c in (n_words, n_features, weight))], ["id", "n_words", "n_features", "weight"]
            )

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    made = rows.mapInArrow(run, schema)
    return made.withColumn("score", F.col("weight") + noise(F.col("id"), params.seed))


# -- selection ---------------------------------------------------------------


ORDER = [("score", "descending"), ("id", "ascending"), ("row", "ascending")]


def place(key) -> tuple:
    """Sorts keys (score, id, row) from best to worst; a null id comes last."""
    return -key["score"], key["id"] is None, 0 if key["id"] is None else key["id"], key["row"]


def before(key, ids: T.DataType) -> Column:
    """Whether a row stands before ``key`` in the order."""
    score, name, row = F.col("score"), F.col("id"), F.col("row")
    here = F.lit(key["id"]).cast(ids)
    id_before = name.isNotNull() if key["id"] is None else F.coalesce(name < here, F.lit(False))
    return (score > key["score"]) | ((score == key["score"]) & (id_before | (name.eqNullSafe(here) & (row < key["row"]))))


def medians(keys: DataFrame, block_rows: int) -> list:
    """Median and size of each block of rows that lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def median() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            best = pc.sort_indices(rows, ORDER, null_placement="at_end")
            found = rows.take(best.slice((len(rows) - 1) // 2, 1)).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*found.columns, pa.array([len(rows)], pa.int64())], [*found.schema.names, "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(lo, block_rows))
                if sum(map(len, held)) >= block_rows:
                    yield median()
                    held = []
        if held:
            yield median()

    # one row per block of remaining scores
    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("n", T.LongType())])).collect()


def cutoff(keys: DataFrame, k: int, n: int, params: ImportanceParams = ImportanceParams()):
    """The ``k``-th of ``n`` keys (score, id, row) in the order, or None if there are fewer."""
    if not 0 < k <= n:
        return None
    ids, stored = keys.schema["id"].dataType, n
    while n > params.sort_rows:
        found = sorted(medians(keys, params.block_rows), key=place)
        weight, half = 0, sum(m["n"] for m in found)
        for middle in found:
            weight += middle["n"]
            if 2 * weight >= half:
                break
        above = keys.filter(before(middle, ids)).count()
        if above + 1 == k:
            return middle
        if above >= k:
            keys, n = keys.filter(before(middle, ids)), above
        else:
            same = (F.col("score") == middle["score"]) & F.col("id").eqNullSafe(F.lit(middle["id"]).cast(ids)) & (F.col("row") == middle["row"])
            keys, n, k = keys.filter(~before(middle, ids) & ~same), n - above - 1, k - above - 1
        if 2 * n < stored:
            keys, stored = written(keys, "importance-left"), n
    return sorted(keys.collect(), key=place)[k - 1]  # ``sort_rows`` at most


def resample(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if drawn, its rank."""
    gain = gains(bucket_counts(docs, params, text_col), bucket_counts(target, params, text_col), params)
    scored = written(weigh(docs, gain, params, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    able = scored.filter(F.col("n_words") >= params.min_words)
    n = able.count()
    last = cutoff(able.select("score", "id", "row"), params.percent * n // 100, n, params)
    if last is None:
        ranked = scored.withColumn("rank", F.lit(None).cast("long"))
    else:
        ids = scored.schema["id"].dataType
        same = (F.col("score") == last["score"]) & F.col("id").eqNullSafe(F.lit(last["id"]).cast(ids)) & (F.col("row") == last["row"])
        drawn = (F.col("n_words") >= params.min_words) & (before(last, ids) | same)
        # among equal scores null ids come last
        winners = scored.filter(drawn).withColumns({"by_score": -F.col("score"), "no_id": F.col("id").isNull()})
        ranks = number_rows(in_order(winners, ["by_score", "no_id", "id", "row"]), "rank").select("rank", *scored.columns)
        ranked = ranks.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


@query(
    r"""
    WITH RECURSIVE crc(i, v, k) AS (
        SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) AS r(i)
        UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
    tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
    gw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM g) GROUP BY ALL),
    place AS (
        SELECT word, xor(list_reduce(
                   list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
        FROM (SELECT word FROM dw UNION SELECT word FROM gw), tab),
    s AS (SELECT b, sum(n) AS n FROM dw JOIN place USING (word) GROUP BY b),
    t AS (SELECT b, sum(n) AS n FROM gw JOIN place USING (word) GROUP BY b),
    totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
    gain AS (
        SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000)))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (b), totals),
    w AS (SELECT doc_id, CAST(floor(sum(gain * n)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM dw JOIN place USING (word) JOIN gain USING (b) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
        FROM d LEFT JOIN w USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN r USING (doc_id)
    """
)
def op11_importance_resampling(spark, sf_dir):
    """All documents weighed against the benchmark; a tenth of those of 20 words and more is drawn."""
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
