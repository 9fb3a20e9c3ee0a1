import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import packing
from ragloom.llm.packing import PackingParams, Rooms, packed, powers
from ragloom.llm.wordids import BatchEncoder

ODD = ["", " ", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "it's we'll 'tis", "x\x00y z", "é ü ß\nÑ 12a!", "a\xa0b c", "a\tb", "<|endoftext|> x",
       "日本語 と\n漢字", "a\x85b", " x y", "a\x1cb c", "foo.\nBar 3,14 -- ok", "\r\n x", "١٢ x²", "a\n", "\na"]


def ids(encoder, texts):
    out = []
    for _, _, found, per_text in encoder(pa.array([t.encode() for t in texts], pa.binary())):
        out += [x.tolist() for x in np.split(found, np.cumsum(per_text)[:-1])]
    return out


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(packing.byte_bpe()), ODD + [" ".join(ODD), "\n".join(ODD)]
    assert ids(BatchEncoder(packing.byte_bpe(), 1000), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab éÉ×\n\t'.1 \u00a0<|", max_size=30), max_size=8))
def test_encoder_on_random_texts(texts):
    from tokenizers import Tokenizer

    known = test_encoder_on_random_texts.__dict__
    encode, plain = known.setdefault("encode", BatchEncoder(packing.byte_bpe(), 1 << 16)), known.setdefault("plain", Tokenizer.from_file(packing.byte_bpe()))
    assert ids(encode, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rooms_finds_the_first_bin():
    rooms, free = Rooms(5, 10), [10] * 8
    for need in (6, 5, 4, 10, 5, 1, 9):
        want = next(i for i, f in enumerate(free) if f >= need)
        free[want] -= need
        assert rooms.take(need) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_packed_places_every_id_once(sizes):
    full, tail = packed(sizes, 16)
    assert all(sum(p[2] for p in s) == 16 for s in full)
    cut = powers(tail, sum(p[2] for p in tail))
    lengths = [sum(p[2] for p in s) for s in cut]
    assert all(n & (n - 1) == 0 for n in lengths) and sum(lengths) < 16
    seen = sorted((d, i) for s in full + cut for d, a, n in s for i in range(a, a + n))
    assert seen == [(d, i) for d, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("group", [40, 1 << 20])
def test_pack_round_trip(spark, group):
    from tokenizers import Tokenizer

    texts = ODD + [None, "long word " * 3000, "same", "same"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(5, ODD[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack(docs, packing.byte_bpe(), PackingParams(group_tokens=group)).toPandas()
    plain = Tokenizer.from_file(packing.byte_bpe())
    seqs = {}
    for r in out.itertuples():
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    for i, text, _ in rows:
        if i in (None, 5):
            continue
        mine = out[out.doc_id == i].sort_values("start")
        found = np.frombuffer(b"".join(mine.ids), "<u4").tolist()
        assert found == plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert set(mine.doc_tokens) == {len(found)}
    assert len(out[out.doc_id == 5]) >= 2


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.byte_bpe()).count() == 0


def test_digest_column(spark):
    from pyspark.sql import functions as F

    got = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), packing.byte_bpe()).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(r.ids) == r.c for r in got)
