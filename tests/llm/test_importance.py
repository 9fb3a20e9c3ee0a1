"""Importance resampling against plain loops, and the selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm import importance
from ragloom.llm.importance import ImportanceParams
from ragloom.llm.spans import SOLID, batch_words, crc32, hashes, joined

SCHEMA = "doc_id long, text string"


def plain(docs, target, p):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % p.buckets for n in range(1, p.max_n + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * p.buckets, [0] * p.buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + p.buckets) / ((s[b] + 1) * (sum(t) + p.buckets)))) for b in range(p.buckets)]
    rows = []
    for i, (name, text) in enumerate(docs):
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append((name, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i))
    able = sorted((r for r in rows if r[1] >= p.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    ranks = {r[5]: k + 1 for k, r in enumerate(able[: p.percent * len(able) // 100])}
    return sorted((r[0] or -1, *r[2:5], ranks.get(r[5], 0)) for r in rows)


def corpus(n, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcÄé9漢", k=rnd.randint(1, 6))) for _ in range(200)] + ["x" * 300]
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(n)]
    return texts, [" ".join(rnd.choices(words[:20], k=30)) for _ in range(10)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_against_a_plain_loop(spark, max_n):
    texts, target = corpus(120)
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "other " * 25), (None, texts[3]), (None, None), (900, ""), (901, "Straße " * 3000)]
    p = ImportanceParams(max_n=max_n, buckets=97, percent=40, sort_rows=40, block_rows=5)
    made = importance.resample(spark.createDataFrame([(t, "de", i) for i, t in docs], "text string, n_words string, doc_id long"), spark.createDataFrame([(t,) for t in target], "text string"), p)
    assert made.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((r["doc_id"] or -1, r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in made.collect())
    assert got == plain(docs, target, p)


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert importance.resample(empty, empty).count() == 0
    rows = importance.resample(spark.createDataFrame([(1, "a b " * 20), (2, None)], SCHEMA), empty, ImportanceParams(percent=100)).collect()
    assert [(r["doc_id"], r["rank"]) for r in sorted(rows)] == [(1, 1), (2, None)]


def test_cutoff_is_the_key_that_sorting_finds(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 3), rnd.choice([None, *range(9)]), i) for i in range(500)]
    keys = spark.createDataFrame(rows, "score long, id long, row long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    p = ImportanceParams(sort_rows=40, block_rows=16)
    for k in (1, 250, 499):
        found = importance.cutoff(keys, k, 500, p)
        assert (found["score"], found["id"], found["row"]) == order[k - 1]
    assert importance.cutoff(keys, 0, 500, p) is None and importance.cutoff(keys, 501, 500, p) is None


def test_text_ids_are_allowed(spark):
    docs = spark.createDataFrame([(f"d{i}", f"w{i} " * 25) for i in range(40)], "doc_id string, text string")
    ranks = [r["rank"] for r in importance.resample(docs, docs, ImportanceParams(percent=50, sort_rows=2, block_rows=4)).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 21))


def test_spans():
    rnd = np.random.default_rng(0)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    lengths = rnd.integers(0, 200, 300)
    starts = rnd.integers(0, 4800, 300)
    assert crc32(data, starts, lengths).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
    texts = [b"", b" a\tbb ", None, b"\xc3\xa9A", b"a", b"\n"]
    for limit in (1, 4, 100):
        found = [(w.lo + t, x) for w in batch_words(pa.array(texts, pa.binary()), SOLID, limit=limit) for t, x in zip(w.text.tolist(), w.array().to_pylist())]
        assert found == [(1, b"a"), (1, b"bb"), (3, b"\xc3\xa9a"), (4, b"a")]
    [words] = batch_words(pa.array(texts, pa.binary()), SOLID)
    assert joined(words).data.tobytes() == b"a bb \xc3\xa9a a "
    assert words.array(np.array([1, 2]), 1).to_pylist() == [b"b", b"\xc3"]
    values = pa.array([b"abc", b"", b"ab", b"abc", b"a" * 999], pa.large_binary())
    assert len(set(hashes(values).tolist())) == 4 and hashes(values)[3] == hashes(values.slice(3, 1))[0] == hashes(values)[0]
