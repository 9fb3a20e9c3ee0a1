"""Batch embedding: one vector per text, through a replaceable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ragloom.functions.text import cut_words, spaced
from ragloom.functions.vectors import is_width
from ragloom.session import written

ROLES = ("document", "query")


class Embedder(Protocol):
    dim: int

    def vector(self, text: Column, role: str | None) -> Column:
        """``array<float>`` of width ``dim`` for a text column."""


class HashingEmbedder:
    """Signed feature hashing of words (Weinberger et al. 2009), unit length.

    Spark finds the words of the texts; a task hashes each distinct word of an Arrow
    batch once and adds signs into a matrix. Texts without words give the zero vector.
    """

    def __init__(self, dim: int):
        self.dim = dim

    def vector(self, text: Column, role: str | None = None) -> Column:
        dim = self.dim

        @arrow_udf("array<float>")
        def hashed(texts: pa.Array) -> pa.Array:
            found = cut_words(texts)
            coded = found.flatten().dictionary_encode()
            digests = b"".join([hashlib.md5(w).digest()[:4] for w in coded.dictionary.cast(pa.binary()).to_pylist()])
            flat = np.frombuffer(digests, ">u4").astype(np.int64)[coded.indices.to_numpy()]
            per_row = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(found)), per_row)
            cell = row * dim + (flat >> 1) % dim
            sums = np.bincount(cell, weights=1.0 - 2.0 * (flat & 1), minlength=len(found) * dim)
            matrix = sums.astype(np.float64).reshape(len(found), dim)  # no words at all: integer zeros
            length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * dim, pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(unit.astype(np.float32).ravel()))

        return hashed(spaced(text))


class ModelEmbedder:
    """Wraps ``load() -> (texts, role) -> matrix``; the model loads once per task."""

    def __init__(self, load: Callable[[], Callable[[list[str], str | None], np.ndarray]], dim: int):
        self.load, self.dim = load, dim

    def vector(self, text: Column, role: str | None = None) -> Column:
        load, dim = self.load, self.dim

        @arrow_udf("array<float>")
        def modelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                matrix = np.asarray(model(batch.to_pylist(), role), dtype=np.float32)
                if matrix.shape != (len(batch), dim):
                    raise ValueError(f"embedder gave {matrix.shape}, wanted {(len(batch), dim)}")
                offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim, pa.int32())
                yield pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))

        return modelled(text)


def embed(
    df: DataFrame,
    embedder: Embedder,
    text: Column,
    role: str | None = None,
    task_types: bool = False,
    out: str = "embedding",
) -> DataFrame:
    """Add one vector per row. The role reaches the embedder only when enabled.

    A missing or wrong-width vector fails the job instead of being stored.
    """
    if role is not None and role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    filled = df.withColumn(out, embedder.vector(text, role if task_types else None))
    return checked_width(filled, embedder.dim, out)


def checked_width(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Fail on the first vector that is missing or not ``dim`` wide."""
    checked = F.when(is_width(F.col(col), dim), F.col(col)).otherwise(
        F.raise_error(F.lit(f"embedding missing or not {dim} wide")).cast("array<float>")
    )
    return df.withColumn(col, checked)


def split_by_width(df: DataFrame, dim: int, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(storable rows, rejected rows)."""
    ok = is_width(F.col(col), dim)
    return df.filter(ok), df.filter(~ok)


def width_report(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    ok = is_width(F.col(col), dim)
    return df.agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )


# --- vectors by content -------------------------------------------------------

@dataclass(frozen=True)
class VectorStore:
    """A stored table of vectors, keyed by a digest of model, role and input.

    ``path`` lies in a folder that all executors reach; ``model`` names the embedder
    and its version, so vectors of another one are never taken.
    """

    path: str
    model: str

    def digest(self, text: Column, role: str | None) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(self.model), F.lit(role or ""), text), 256)

    def read(self, spark: SparkSession) -> DataFrame:
        """``(digest, vector)``, once each."""
        schema = "digest string, vector array<float>"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        # two loads at a time may both have embedded an input
        return spark.read.schema(schema).parquet(self.path).groupBy("digest").agg(F.first("vector").alias("vector"))

    def add(self, vectors: DataFrame) -> None:
        vectors.select("digest", "vector").write.mode("append").parquet(self.path)


def embed_stored(
    df: DataFrame, embedder: Embedder, text: Column, store: VectorStore, role: str | None = None, task_types: bool = False, out: str = "embedding",
) -> tuple[DataFrame, int]:
    """Like ``embed``, and how many inputs went to the embedder: those the store has no vector of, once each.

    Their vectors are stored before any row is given one, so a load that fails
    later does not embed them again.
    """
    spark = df.sparkSession
    if role is not None and role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    keyed = df.withColumn("_text", text).withColumn("_digest", store.digest(F.col("_text"), role if task_types else None))
    inputs = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first("_text").alias("text"))
    missing = written(inputs.join(store.read(spark).select("digest"), "digest", "left_anti"), "inputs")
    n = missing.count()
    if n:
        store.add(embed(missing, embedder, F.col("text"), role, task_types, out="vector"))
    known = store.read(spark).select(F.col("digest").alias("_digest"), F.col("vector").alias(out))
    return checked_width(keyed.drop(out).join(known, "_digest", "left").drop("_digest", "_text"), embedder.dim, out), n
