"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training counts in how many toxic and clean training rows each n-gram, under a
64-bit key, occurs (all rows, whole texts), turns the counts into log-count ratios and keeps
every n-gram with enough evidence of its own. A logistic regression over presence times ratio is fitted on a bounded sample of rows.

Null and empty texts have no n-grams and get the score of the intercept. Labels
other than 0 and 1 and null labels teach nothing. Without rows of both classes
the model is the smoothed share of toxic rows. Repeated rows count as often as
they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import LOWER, byte_view, fold_of, pieces, table, tidied, utf8
from ragloom.llm.registry import query
from ragloom.session import broadcast_within


#: Bytes of text worked on at once; every byte gives an n-gram of each order.
PIECE = 1 << 18

#: N-grams that a task adds up before they leave it.
HELD = 1 << 21


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (3, 4, 5, 6)  # bytes in an n-gram, 8 at most
    bits: int = 64  # of an n-gram's key; 64 keep n-grams apart
    smoothing: float = 1.0
    min_ratio: float = 1.0  # least absolute log-count ratio of a feature
    min_association: float = 10.0  # least G statistic of a feature
    fit_rows: int = 50_000  # bound of the labelled rows that the regression is fitted on
    penalty: float = 1e-3
    rounds: int = 300
    threshold: float = 0.7
    label_bytes: int = 64 << 20  # labels up to this size are sent to the texts


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # keys of n-grams, sorted
    weights: np.ndarray  # regression weight times log-count ratio
    intercept: float
    params: ToxicityParams


def hashed(data: np.ndarray, offsets: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of lower-cased texts and the text each belongs to.

    Each text is framed by spaces and followed by zero bytes, which keep neighbours
    apart; n-grams begin inside the frame.
    """
    gap = max(params.orders)
    lengths = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(lengths + gap + 2)])
    framed = np.zeros(starts[-1] + gap, np.uint8)
    spot = np.arange(offsets[-1] - offsets[0]) + np.repeat(starts[:-1] + 1 - (offsets[:-1] - offsets[0]), lengths)
    framed[spot] = np.frombuffer(LOWER, np.uint8)[data[offsets[0] : offsets[-1]]]
    framed[starts[:-1]] = framed[starts[:-1] + lengths + 1] = 32
    wide, n = framed.astype(np.uint64), int(starts[-1])
    code, made, found = np.zeros(n, np.uint64), 0, []
    for order in sorted(params.orders):
        for k in range(made, order):
            code |= wide[k : k + n] << np.uint64(8 * k)
        made = order
        h = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(h >> np.uint64(64 - params.bits))
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + gap + 2)
    inside = np.arange(n) - starts[text] < lengths[text] + 2
    return np.stack(found)[:, inside], text[inside]


def present(values: pa.Array, params: ToxicityParams, features: np.ndarray | None = None):
    """Yield (first text, text, n-gram) of the distinct n-grams of every piece of a batch.

    With ``features``, only those, as positions in it.
    """
    data, offsets = byte_view(values)
    if features is not None:
        # most n-grams are told apart from the features by their first bits
        first = min(params.bits, 24, max(16, int(len(features)).bit_length() + 6))
        shift = np.uint64(params.bits - first)
        maybe = np.zeros(1 << first, bool)
        maybe[(features >> shift).astype(np.int64)] = True
    for lo, hi in pieces(offsets, PIECE):
        grams, text = hashed(data, offsets[lo : hi + 1], params)
        if features is not None:
            row, col = np.nonzero(maybe[(grams >> shift).astype(np.int64)])
            gram = grams[row, col]
            at = np.minimum(np.searchsorted(features, gram), max(0, len(features) - 1))
            known = features[at] == gram if len(features) else np.zeros(0, bool)
            key = np.unique((text[col[known]].astype(np.int64) << 32) | at[known])
            yield lo, key >> 32, key & ((1 << 32) - 1)
        else:
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            every = [np.unique(grams[:, a:b]) for a, b in zip(cut, cut[1:])]
            yield lo, np.repeat(np.arange(hi - lo), [len(x) for x in every]), np.concatenate(every)


def labelled(docs: DataFrame, labels: DataFrame, label: str, params: ToxicityParams) -> DataFrame:
    """Texts with their 0/1 label; labels are sent to the texts where their size allows."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")
    )
    known = broadcast_within(known, known.count(), 32, params.label_bytes)
    return docs.select(F.col("doc_id").alias("_id"), utf8(F.col("text")).alias("_text")).join(known, "_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) that ``labels`` (doc_id, label) marks."""
    rows = labelled(docs, labels, label, params)

    def count(batches):
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # of clean and of toxic rows

        def out():
            for c in (0, 1):
                gram, n = np.unique(np.concatenate(held[c] or [none]), return_counts=True)
                held[c].clear()
                for a in range(0, len(gram), 100_000):
                    part, seen = pa.array(gram[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])
                    nothing = pa.array(np.zeros(len(part), np.int64))
                    yield pa.RecordBatch.from_arrays([part, *((nothing, seen) if c else (seen, nothing))], ["gram", "clean", "toxic"])

        size = 0
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for lo, text, gram in present(batch.column("_text"), params):
                for c in (0, 1):
                    held[c].append(gram[y[lo + text] == c])
                size += len(gram)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    def strong(batches):
        for batch in batches:
            ratio, keep = ratios(batch.to_pandas(), n0, n1, params)
            yield pa.RecordBatch.from_arrays([batch.column("gram").filter(pa.array(keep)), pa.array(ratio[keep])], ["gram", "ratio"])

    none = np.zeros(0, np.uint64)
    ends = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    n0, n1 = ends.get(0, 0), ends.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return ToxicityModel(none, np.zeros(0), float(np.log(prior / (1 - prior))), params)
    counts = rows.select("_text", "_y").mapInArrow(tidied(count), "gram long, clean long, toxic long")
    counts = counts.groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # only n-grams with enough evidence leave the tasks
    chosen = counts.mapInArrow(tidied(strong), "gram long, ratio double").toArrow()
    features = chosen.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(features)
    features, ratio = features[order], chosen.column("ratio").to_numpy()[order]
    weights, intercept = fit(*sample(rows, n0 + n1, features, params), ratio, params)
    return ToxicityModel(features, weights, intercept, params)


def ratios(grams: pd.DataFrame, n0: int, n1: int, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every n-gram, and which are associated strongly enough to be features."""
    q, p = grams.clean.to_numpy(float), grams.toxic.to_numpy(float)
    a = params.smoothing
    ratio = np.log((p + a) / (n1 + 2 * a)) - np.log((q + a) / (n0 + 2 * a))

    def part(seen, share):
        expected = np.maximum(share, 1e-9)
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    n, t = n0 + n1, p + q
    g = 2 * (part(p, t * n1 / n) + part(q, t * n0 / n) + part(n1 - p, (n - t) * n1 / n) + part(n0 - q, (n - t) * n0 / n))
    return ratio, (np.abs(ratio) >= params.min_ratio) & (g >= params.min_association)


def sample(rows: DataFrame, n: int, features: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``fit_rows`` of the ``n`` rows in hash order, as (row, feature) pairs and labels."""

    def pick(batches):
        for batch in batches:
            found = [(lo + text, gram.astype(np.int32)) for lo, text, gram in present(batch.column("_text"), params, features)]
            sizes = np.bincount(np.concatenate([t for t, _ in found]), minlength=batch.num_rows) if found else []
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g for _, g in found]) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), lists], ["_id", "_y", "_f"])

    if n > params.fit_rows:  # a hash of the id thins the rows out before their texts are read closely
        rows = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < (1 << 20) * params.fit_rows / n)
    found = rows.mapInArrow(tidied(pick), f"_id {dict(rows.dtypes)['_id']}, _y int, _f array<int>")
    got = found.orderBy(F.xxhash64("_id"), "_id", "_y", "_f").limit(params.fit_rows).select("_y", "_f").toArrow()
    lists = got.column("_f").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), flat, got.column("_y").to_numpy().astype(float)


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; the weights include the ratios."""
    n, value = len(y), ratio[col]
    weight, last, bias, last_bias = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    # a step that cannot overshoot: the curvature is at most a quarter of the mean squared row length
    curve = 0.25 * ((np.bincount(row, value * value, n) + 1).mean() if n else 1) + params.penalty
    for k in range(params.rounds):
        push = k / (k + 3)
        w, b = weight + push * (weight - last), bias + push * (bias - last_bias)
        error = (1 / (1 + np.exp(-(np.bincount(row, value * w[col], n) + b))) - y) / max(n, 1)
        last, last_bias = weight, bias
        weight = w - (np.bincount(col, value * error[row], len(ratio)) + params.penalty * w) / curve
        bias = b - error.sum() / curve
    return weight * ratio, float(bias)


def scorer(model: ToxicityModel):
    """A column function: text to its toxicity between 0 and 1."""

    @F.arrow_udf(T.DoubleType())
    def toxicity(text: pa.Array) -> pa.Array:
        total = np.full(len(text), model.intercept)
        for lo, doc, gram in present(text, model.params, model.features):
            total += np.bincount(lo + doc, model.weights[gram], len(total))
        return pa.array(1 / (1 + np.exp(-total)))

    return lambda text: toxicity(utf8(text))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score of each row of ``docs`` as a column to select or filter by."""
    return scorer(model)(docs[text])


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, 3) == 1


@query()
def op10_toxicity(spark, sf_dir):
    """Every document scored by the classifier learnt from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = ToxicityParams()
    model = train(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"), params=params)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
