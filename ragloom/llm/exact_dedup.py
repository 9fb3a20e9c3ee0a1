"""Exact duplicates: fuse filters of immutable snapshots screen the digests of a new batch.

A batch is stored once as a table of its rows with the SHA-256 digest of their
normalised text (all of 0x20 and 0x09-0x0D deleted). Its digests are grouped
among themselves. A snapshot is such a stored batch that no longer changes: the
exact buckets of its digests and one static binary-fuse filter per bucket. The
distinct digests of a new batch meet the filter of their bucket; those it lets
through are looked up in the exact bucket. Wherever a digest occurs more than
once, the texts themselves are compared byte by byte.

Null text counts as empty, and empty texts are equal to each other. Of equal
texts the row with the most code points stays, then the smallest id (null ids
last), then the first stored row, so that exactly one of repeated rows stays.
Other columns pass through inside a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import SPACES, byte_view, mix, table, utf8
from ragloom.llm.registry import query
from ragloom.session import broadcast_within, written


@dataclass(frozen=True)
class DedupParams:
    bucket_keys: int = 65_536  # digests behind one filter
    digest_chars: int = 64  # hex digits of the digest that are used; fewer only to test the byte check
    digest_bytes: int = 64 << 20  # sets of digests up to this size are sent to the rows


# -- binary-fuse filter ------------------------------------------------------


@dataclass(frozen=True)
class FuseFilter:
    """Static filter with three places a key: no false negatives, false positives 1 in 256."""

    seed: int
    segment: int  # places in a segment, a power of two
    starts: int  # first places to choose from
    prints: np.ndarray  # uint8

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        prints = (mix(h) & np.uint64(0xFF)).astype(np.uint8)
        return np.stack([first, second, third]).astype(np.int64), prints

    @staticmethod
    def build(keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        starts = max(1, int(np.ceil(room / segment)) - 2) * segment
        for seed in range(1, 1000):
            at, prints = FuseFilter.places(keys, seed, segment, starts)
            order = FuseFilter.peeled(at, starts + 2 * segment)
            if order is not None:
                table = np.zeros(starts + 2 * segment, np.uint8)
                for key, place in reversed(order):  # the place of a key is not read by any key set before it
                    others = table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]] ^ table[place]
                    table[place] = prints[key] ^ others
                return FuseFilter(seed, segment, starts, table)
        raise RuntimeError("no seed gives a filter")

    @staticmethod
    def peeled(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the place that only this key still has), or None if a core remains."""
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=size)
        total = np.zeros(size, np.int64)  # of the numbers of the keys at a place: at one key, the key
        for row in at:
            np.add.at(total, row, np.arange(n))
        rounds, left, lone = [], n, np.flatnonzero(count == 1)
        while len(lone):
            keys, one = np.unique(total[lone], return_index=True)
            rounds.append((keys, lone[one]))
            left -= len(keys)
            for row in at:
                np.subtract.at(count, row[keys], 1)
                np.subtract.at(total, row[keys], keys)
            touched = np.unique(at[:, keys])
            lone = touched[count[touched] == 1]
        return None if left else rounds

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.places(keys, self.seed, self.segment, self.starts)
        return self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]] == prints


# -- batches and snapshots ---------------------------------------------------


@F.arrow_udf(T.StringType())
def sha256_of(text: pa.Array) -> pa.Array:
    data, offsets = byte_view(text)
    return pa.array([hashlib.sha256(data[a:b].tobytes().translate(None, SPACES)).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string())


@F.arrow_udf(T.BinaryType())
def normalised(text: pa.Array) -> pa.Array:
    data, offsets = byte_view(text)
    return pa.array([data[a:b].tobytes().translate(None, SPACES) for a, b in zip(offsets, offsets[1:])], pa.binary())


def store(docs: DataFrame, params: DedupParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch as a stored table: doc (all columns), row, id, points, digest."""
    doc = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("id"), F.coalesce(F.length(docs[text_col]), F.lit(0)).alias("points"),
        F.substring(sha256_of(utf8(docs[text_col])), 1, params.digest_chars).alias("digest"),
    )
    return written(doc, "dedup-batch")


def grouped(batch: DataFrame) -> DataFrame:
    """One row per digest of a batch with how many rows have it; combined before the shuffle."""
    return batch.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))


def key_of(digest):
    """The leading 60 bits as a number, which filters and buckets go by."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Snapshot:
    exact: DataFrame  # bucket, digest, rows
    filters: DataFrame  # bucket, seed, segment, starts, prints
    buckets: int
    params: DedupParams


FILTER = "bucket long, seed int, segment int, starts long, prints binary"


def snapshot(batch: DataFrame, params: DedupParams) -> Snapshot:
    """Exact buckets of a stored batch and a filter for each; buckets hold a bounded share of the digests."""
    groups = written(grouped(batch), "dedup-groups")
    buckets = max(1, -(-groups.count() // params.bucket_keys))
    exact = groups.withColumn("bucket", F.pmod(key_of(F.col("digest")), F.lit(buckets)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy())
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": f.seed, "segment": f.segment, "starts": f.starts, "prints": [f.prints.tobytes()]})

    filters = exact.select("bucket", key_of(F.col("digest")).alias("key")).groupBy("bucket").applyInPandas(build, FILTER)
    return Snapshot(exact, written(filters, "dedup-filters"), buckets, params)


def screened(groups: DataFrame, old: Snapshot) -> DataFrame:
    """The distinct digests of a new batch that the filters of a snapshot let through.

    A bucket that meets many new digests is cut into slices of the same bound.
    """
    slices = max(1, -(-groups.count() // (old.buckets * old.params.bucket_keys)))
    key = key_of(F.col("digest"))
    new = groups.select("digest", key.alias("key"), F.pmod(key, F.lit(old.buckets)).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(slices)).alias("slice"))
    filters = old.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))

    def probe(keys: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not keys.num_rows:
            return keys.select(["digest"]).slice(0, 0)
        f = found.to_pylist()[0]
        known = FuseFilter(f["seed"], f["segment"], f["starts"], np.frombuffer(f["prints"], np.uint8))
        return keys.select(["digest"]).filter(pa.array(known.holds(keys.column("key").to_numpy())))

    return new.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInArrow(probe, "digest string")


def repeated(batch: DataFrame, old: list[Snapshot]) -> DataFrame:
    """Digests of ``batch`` that occur again, in the batch itself or in a snapshot."""
    groups = written(grouped(batch), "dedup-groups")
    found = [groups.filter("rows > 1").select("digest")]
    for shot in old:
        passed = screened(groups, shot)
        found.append(passed.join(shot.exact.select("digest"), "digest"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def decide(docs: DataFrame, params: DedupParams = DedupParams(), arrivals: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which rows of ``docs`` stay, the rows taken as arriving in ``arrivals`` batches.

    Each batch becomes a snapshot that the later ones are screened against.
    Returns doc (all columns as a struct), digest, keep (id and row of the row
    that stays), group_size and kept.
    """
    stored = store(docs, params, id_col, text_col)
    part = F.pmod(F.xxhash64("id"), F.lit(arrivals))
    again, shots = [], []
    for k in range(arrivals):
        batch = stored.filter(part == k)
        again.append(repeated(batch, shots))
        if k + 1 < arrivals:
            shots.append(snapshot(batch, params))
    found = again[0]
    for more in again[1:]:
        found = found.union(more)
    found = written(found.distinct(), "dedup-repeated")
    found = broadcast_within(found, found.count(), 2 * params.digest_chars + 64, params.digest_bytes)

    text = F.coalesce(F.col(f"doc.`{text_col}`").cast("binary"), F.lit(b""))
    members = stored.select("row", "id", "points", "digest", text.alias("text")).join(found, "digest")
    members = members.select("row", "id", "points", "digest", normalised(F.col("text")).alias("bytes"))
    first = members.groupBy("digest").agg(F.min("bytes").alias("first"))
    # a row whose bytes differ from those of its digest's first text is told apart by them
    checked = members.join(first.hint("merge"), "digest").select(
        "row", "id", "points", "digest", F.when(F.col("bytes") != F.col("first"), F.col("bytes")).otherwise(F.lit(b"")).alias("variant")
    )
    checked = written(checked, "dedup-checked")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("unknown"), "id", "row"))
    groups = checked.groupBy("digest", "variant").agg(best.alias("keep"), F.count(F.lit(1)).alias("group_size"))
    decided = checked.select("row", "digest", "variant").join(groups.hint("merge"), ["digest", "variant"])
    decided = decided.select("row", F.struct("keep.id", "keep.row").alias("keep"), "group_size")
    out = stored.select("doc", "row", "id", "digest").join(decided.hint("merge"), "row", "left")
    alone = F.struct(F.col("id"), F.col("row"))
    return out.select(
        "doc", "digest", F.coalesce("keep", alone).alias("keep"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def unique(docs: DataFrame, params: DedupParams = DedupParams(), arrivals: int = 2) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns unchanged."""
    return decide(docs, params, arrivals).filter("kept").select("doc.*")


@query(
    r"""
    WITH n AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
               length(coalesce(text, '')) AS points
        FROM documents),
    g AS (
        SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
               count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
    """
)
def op4_exact_dedup(spark, sf_dir):
    """Every document with the row that stays of its equal texts, found over two arrivals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decide(docs).select("doc.doc_id", F.col("keep.id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))
