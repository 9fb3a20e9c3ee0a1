"""Language identification by interpolated Kneser-Ney models over characters.

Texts become symbols: letters, lower-cased, and one space for each run of
anything else. Counts of all training texts become, per language and order, the
interpolated Kneser-Ney probability of each n-gram and the back-off weight of
each context, kept as sorted arrays of the n-grams with their logarithms. A text goes
to the language with the lowest cross-entropy per symbol. Temperature and the
entropy beyond which a text is rejected are calibrated on the training rows.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Ties
go to the language first in order. Rows without language teach nothing; without
any, every text is ``und``. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import byte_view, fold_of, mix, pieces, table, utf8
from ragloom.llm.registry import query
from ragloom.session import written

BITS = 12  # of a symbol


@dataclass(frozen=True)
class LangidParams:
    order: int = 4  # symbols in the longest n-gram, 5 at most
    hash_bits: int | None = None  # of hashed n-grams, which then share places; None keeps every n-gram itself
    block_bytes: int = 64 << 20  # models sent to the tasks at once; more languages mean more scans
    rejected_share: float = 0.001  # of the training texts that the calibrated bound rejects
    temperatures: tuple[float, ...] = (1, 2, 4, 8, 16, 32, 64, 128)


@lru_cache(1)
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of every code point, 32 for what is no letter, and the one that follows it or 0.

    A letter from U+1000 on is two symbols that no letter below has, so that all
    letters stay apart.
    """
    low = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            lower = chr(c).lower()
            low[c] = ord(lower) if len(lower) == 1 else c
    wide = low >= 1 << BITS
    free = np.setdiff1d(np.arange(1, 1 << BITS), low[~wide])
    rest = low[wide] - (1 << BITS)
    first, second = low.copy(), np.zeros(len(low), np.int32)
    first[wide], second[wide] = free[1024:][rest >> 10], free[rest & 1023]
    return first.astype(np.uint16), second.astype(np.uint16)


def grams(values: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a batch: first text, last text, the packed n-gram that ends at each symbol, its text."""
    data, offsets = byte_view(values)
    first_of, second_of = symbols()
    for lo, hi in pieces(offsets):
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1])]
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol, second = first_of[points].astype(np.int64), second_of[points]
        text = np.repeat(np.arange(hi - lo), lengths)
        wide = second > 0
        if wide.any():
            ends = np.cumsum(1 + wide) - 1
            symbol, text = np.repeat(symbol, 1 + wide), np.repeat(text, 1 + wide)
            symbol[ends[wide]] = second[wide]
        first = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
        # a space after a space or at the start of a text is left out
        space = symbol == 32
        keep = ~(space & (first | np.concatenate([[False], space[:-1]])[: len(space)]))
        symbol, text = symbol[keep], text[keep]
        packed, back = symbol.copy(), symbol
        for k in range(1, order):
            back = np.concatenate([[0], back[:-1]])[: len(symbol)]
            same = np.concatenate([np.full(min(k, len(text)), False), text[k:] == text[:-k]])
            packed |= np.where(same, back, 0) << (BITS * k)
        yield lo, hi, packed, text


def place(gram: np.ndarray, order: int, bits: int | None) -> np.ndarray:
    """The key of packed n-grams of an order: themselves, or a hash of so many bits."""
    if bits is None:
        return gram
    return (mix(gram.astype(np.uint64) + (np.uint64(order) << np.uint64(60))) >> np.uint64(64 - bits)).astype(np.int64)


def count(docs: DataFrame, params: LangidParams) -> DataFrame:
    """How often each n-gram of the highest order occurs in each language of ``docs`` (text, lang)."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(lang: str, gram: np.ndarray, n: np.ndarray) -> None:
            held.setdefault(lang, []).append((gram, n))
            if len(held[lang]) > 32:
                pack(lang)

        def pack(lang: str) -> None:
            every, inverse = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            held[lang] = [(every, np.bincount(inverse, np.concatenate([n for _, n in held[lang]])).astype(np.int64))]

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, gram, text in grams(batch.column("text"), params.order):
                for lang in sorted(set(langs[lo:hi])):
                    add(lang, *np.unique(gram[(langs[lo:hi] == lang)[text]], return_counts=True))
        for lang in held:
            pack(lang)
            gram, n = held[lang][0]
            for a in range(0, len(gram), 100_000):
                part = gram[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[a : a + 100_000])], ["lang", "gram", "c"])

    rows = docs.select(utf8(F.col("text")).alias("text"), "lang").filter("lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, order: int) -> DataFrame:
    """lang, n, gram, logp, and for contexts logb: interpolated Kneser-Ney of every order.

    The highest order goes by how often an n-gram occurs, the lower ones by how
    many symbols it follows; the discount of an order is n1 / (n1 + 2 n2).
    """
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * n) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    below, out = None, []
    for n in range(1, order + 1):
        ones = tables[n].groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        ones = ones.select("lang", F.least(F.greatest(d, F.lit(0.1)), F.lit(0.95)).alias("d"))
        rows = tables[n].withColumn("context", F.shiftright("gram", BITS))
        totals = rows.groupBy("lang", "context").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("t"))
        totals = totals.join(F.broadcast(ones), "lang").withColumn("b", F.col("d") * F.col("t") / F.col("s"))
        rows = rows.join(totals, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("under", F.lit(1.0 / (1 << BITS)))
        else:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND((1 << BITS * (n - 1)) - 1))
            rows = rows.join(below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("under")), ["lang", "rest"])
        below = written(rows.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("s") + F.col("b") * F.col("under")).alias("p")), "langid-order")
        out.append(below.select("lang", F.lit(n).alias("n"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
        out.append(totals.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("b").alias("logb")))
    return reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class Arrays:
    """One language: for each order the sorted keys with their logarithms."""

    lang: str
    logp: dict[int, tuple[np.ndarray, np.ndarray]]
    logb: dict[int, tuple[np.ndarray, np.ndarray]]

    def nbytes(self) -> int:
        return sum(a.nbytes + b.nbytes for t in (self.logp, self.logb) for a, b in t.values())

    @staticmethod
    def find(arrays: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = arrays
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, values[at]

    def score(self, gram: np.ndarray, order: int, bits: int | None) -> np.ndarray:
        """log P of the last symbol of each packed n-gram given those before it."""
        if order == 0:
            return np.full(len(gram), -np.log(1 << BITS))
        gram = gram & ((1 << BITS * order) - 1)
        seen, value = self.find(self.logp[order], place(gram, order, bits))
        value = value.astype(float)
        less = gram[~seen]
        if len(less):
            known, weight = self.find(self.logb[order - 1], place(less >> BITS, order - 1, bits))
            value[~seen] = np.where(known, weight, 0) + self.score(less, order - 1, bits)
        return value


def train(docs: DataFrame, params: LangidParams = LangidParams()) -> list[list[Arrays]]:
    """Models of all languages of ``docs`` (text, lang), in blocks of bounded size."""
    rows = estimate(written(count(docs, params), "langid-counts"), params.order)
    names = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]

    def hashed(batches):
        for batch in batches:
            n, gram = batch.column("n").to_numpy(), batch.column("gram").to_numpy()
            h = np.zeros(len(n), np.int64)
            for k in np.unique(n):
                h[n == k] = place(gram[n == k], int(k), params.hash_bits)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("lang", "n")] + [pa.array(h), batch.column("logp"), batch.column("logb")], ["lang", "n", "h", "logp", "logb"])

    rows = rows.mapInArrow(hashed, "lang string, n int, h long, logp double, logb double")
    rows = written(rows.groupBy("lang", "n", "h").agg(F.max("logp").cast("float").alias("logp"), F.max("logb").cast("float").alias("logb")), "langid-model")
    models, blocks, size = [], [[]], 0
    for lang in names:  # as many rows as the language has distinct n-grams
        t = rows.filter(F.col("lang") == lang).select("n", "h", "logp", "logb").toArrow().to_pandas().sort_values(["n", "h"])
        arrays = {}
        for what in ("logp", "logb"):
            known = t[t[what].notna()]
            arrays[what] = {n: tuple(known[known.n == n][c].to_numpy(k) for c, k in (("h", np.int64), (what, np.float32))) for n in range(params.order + 1)}
        models.append(Arrays(lang, arrays["logp"], arrays["logb"]))
    for m in models:
        if blocks[-1] and size + m.nbytes() > params.block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(m)
        size += m.nbytes()
    return [b for b in blocks if b]


def entropies(spark: SparkSession, block: list[Arrays], params: LangidParams):
    """A column function: text to its cross-entropy per symbol under each model; null without a letter."""
    sent = spark.sparkContext.broadcast(block)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measure(text: pa.Array) -> pa.Array:
        models, out = sent.value, [None] * len(text)
        for lo, hi, gram, at in grams(text, params.order):
            n = np.bincount(at, minlength=hi - lo)
            letters = np.bincount(at, (gram & ((1 << BITS) - 1)) != 32, minlength=hi - lo)
            every, inverse = np.unique(gram, return_inverse=True)
            sums = [np.bincount(at, m.score(every, params.order, params.hash_bits)[inverse], minlength=hi - lo) for m in models]
            for i in np.flatnonzero(letters):
                out[lo + i] = [float(-s[i] / n[i]) for s in sums]
        return pa.array(out, pa.list_(pa.float64()))

    return lambda text: measure(utf8(text))


def measured(docs: DataFrame, blocks: list[list[Arrays]], params: LangidParams, text: str = "text"):
    """Cross-entropies of all languages, in the order of the blocks, as a column of ``docs``."""
    return F.concat(*[entropies(docs.sparkSession, b, params)(docs[text]) for b in blocks])


def calibrate(scored: DataFrame, langs: list[str], params: LangidParams) -> tuple[float, dict[str, float]]:
    """The temperature of least log loss, and per language the entropy few training texts exceed.

    ``scored``: training rows with lang and their entropies h.
    """
    right = F.element_at("h", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int"))
    rows = scored.filter(F.col("h").isNotNull() & F.col("lang").isin(langs)).withColumn("right", right)

    def loss(k: float):
        return F.avg(F.log(F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(k * (F.array_min("h") - x)))) - k * (F.array_min("h") - F.col("right")))

    found = rows.agg(*[loss(k).alias(str(i)) for i, k in enumerate(params.temperatures)]).head()
    best = min(range(len(found)), key=lambda i: (found[i] is None, found[i], i))
    bounds = rows.groupBy("lang").agg(F.percentile_approx("right", 1 - params.rejected_share, 10_000).alias("bound")).collect()
    return float(params.temperatures[best]), {r.lang: r.bound for r in bounds}


def identify(scored: DataFrame, langs: list[str], temperature: float, bounds: dict[str, float]) -> DataFrame:
    """``scored`` with lang_pred, score and rejected from its entropies h."""
    least = F.array_min("h")
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("h", least).cast("int"))
    sure = 1 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(temperature * (least - x)))
    limit = F.element_at(F.create_map(*[F.lit(v) for x in langs for v in (x, bounds.get(x, float("inf")))]), name)
    return scored.withColumns({
        "lang_pred": F.coalesce(F.when(F.col("h").isNotNull(), name), F.lit("und")),
        "score": F.coalesce(F.when(F.col("h").isNotNull(), sure), F.lit(0.0)),
        "rejected": F.coalesce(F.when(F.col("h").isNotNull(), least > limit), F.lit(True)),
    })


@query()
def op6_language_id(spark, sf_dir):
    """The language of every document, learnt from three quarters of them."""
    params = LangidParams()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fold_of(F.col("doc_id"), 4) == 2
    blocks = train(docs.filter(~out), params)
    base = docs.withColumn("held_out", out)
    if not blocks:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    scored = written(base.select("doc_id", "held_out", "lang", measured(base, blocks, params).alias("h")), "langid-scored")
    langs = [m.lang for b in blocks for m in b]
    temperature, bounds = calibrate(scored.filter(~F.col("held_out")), langs, params)
    return identify(scored, langs, temperature, bounds).select("doc_id", "held_out", "lang_pred", "score", "rejected")
