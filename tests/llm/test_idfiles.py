"""The word-aligned code, its files, and the ids in them against the tokenizers library."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.llm import idfiles, wordids
from ragloom.llm.idfiles import COUNTS, ESCAPE, WIDTHS, IdFileParams
from ragloom.session import scratch_path

ODD = [
    "Plain words, and 'quotes' it's we'RE don't. (x) 3DS 12.5% a--b ...", "Éclair ÇA VA? naïve œuvre Ÿ İstanbul ſ ŉ", "ΑΣ σΣ. Привет мир", "漢字かな กข é ẋ̣",
    "a b c\u0085d \x1c\x00\x7f tab\tx\r\n\x0by", "a <|endoftext|> b<|startoftext|>c <| x", "😀👍🏽 ™½ ª º µ ß ẞ ǅ Ⱥ ﻿x ‍", "", " ", "x" * 5000, "ab'sab's''s's 're're", "퟿",
]


@lru_cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def expected(path, text, end):
    return [*tokenizer(path).encode(text, add_special_tokens=False).ids, end]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49407), st.integers(0, 2**64 - 1), st.sampled_from([0, 0, 0, int(ESCAPE), int(ESCAPE) - 1])), max_size=700))
def test_code_round_trip(values):
    words, escapes = idfiles.encode(np.array(values, np.uint64))
    assert idfiles.decode(words, len(values), escapes).tolist() == values
    assert len(escapes) == sum(v >= int(ESCAPE) for v in values)


def test_each_word_takes_as_many_values_as_fit():
    rnd = np.random.default_rng(0)
    values = [int(v) >> int(s) for v, s in zip(rnd.integers(0, 2**40, 3000), rnd.integers(0, 41, 3000))] + [0] * 500 + [7]
    at, want = 0, 0
    while at < len(values):
        at += next(n for n, w in zip(COUNTS.tolist(), WIDTHS.tolist()) if all(v < 1 << w for v in values[at : at + n]))
        want += 1
    assert len(idfiles.encode(np.array(values, np.uint64))[0]) == want
    assert len(idfiles.encode(np.zeros(240, np.uint64))[0]) == 1 == len(idfiles.encode(np.full(60, 1))[0])


def test_file_round_trip_and_damage():
    ids = np.random.default_rng(1).integers(0, 49408, 1000)
    sizes = np.array([0, 400, 1, 599])
    data = idfiles.file_bytes(3, 4, [7, None, -2, 1 << 62], sizes, ids, 64) + b"\n"
    file = idfiles.IdFile(data)
    assert (file.part, file.number, file.n_ids, file.n_blocks) == (3, 4, 1000, 16)
    assert file.doc_ids.to_pylist() == [7, None, -2, 1 << 62] and file.sizes.tolist() == sizes.tolist()
    assert file.ids().tolist() == ids.tolist() and file.block(15).tolist() == ids[960:].tolist() and file.block(2).tolist() == ids[128:192].tolist()
    for broken in (data[:-1], data[:100], data[:200] + b"x" + data[201:], b"", b"\n"):
        with pytest.raises(ValueError):
            idfiles.IdFile(broken)
    assert idfiles.IdFile(idfiles.file_bytes(0, 0, [], np.zeros(0, int), np.zeros(0, int), 64) + b"\n").ids().tolist() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    import public_tokenizers

    path = str(public_tokenizers.path(name))
    rnd = np.random.default_rng(2)
    alphabet = list("aB'st. ,<|>09éÉ漢́  \nſß")
    texts = ODD + ["".join(rnd.choice(alphabet, 60)) for _ in range(300)]
    encoder = wordids.BatchEncoder(path, 1 << 14)  # forgets often
    got = []
    for _, _, ids, per_text in encoder(pa.array([t.encode() for t in texts], pa.binary())):
        ids, per_text = wordids.with_end(ids, per_text, 1)
        got += [x.tolist() for x in np.split(ids, np.cumsum(per_text)[:-1])]
    assert got == [expected(path, t, 1) for t in texts]
    assert encoder.by_word == name.startswith("word")


def test_files_of_a_table(spark):
    texts = [*ODD, None, "same", "same"]
    names = [*range(20, 20 - len(ODD), -1), None, 5, 5]
    docs = spark.createDataFrame(list(zip(texts, names, ["x"] * 99)), "text string, doc_id long, id string").repartition(3)
    path = scratch_path(spark, "test-ids")
    idfiles.write_ids(docs, path, idfiles.word_bpe(), IdFileParams(block_ids=8, file_ids=40))
    found = idfiles.with_starts(idfiles.read_files(spark, path, "ids array<long>", idfiles.documents)).orderBy("start").collect()
    assert [r["id"] for r in found] == [*sorted(n for n in names if n is not None), None]
    want = sorted((n is None, n or 0, expected(idfiles.word_bpe(), t or "", 1)) for n, t in zip(names, texts))
    start = 0
    for row, (_, _, ids) in zip(found, want, strict=True):
        assert (row["ids"], row["n_tokens"], row["start"]) == (ids, len(ids), start)
        start += len(ids)
    sums = idfiles.read_files(spark, path, "ids_crc32 long", idfiles.checksums).collect()
    assert sorted(r["ids_crc32"] for r in sums) == sorted(zlib.crc32(np.array(w[2], "<u4").tobytes()) for w in want)
    assert spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).count() > 3


def test_no_documents(spark):
    path = scratch_path(spark, "test-ids")
    idfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, idfiles.word_bpe())
    assert idfiles.with_starts(idfiles.read_files(spark, path, "", lambda *_: [])).count() == 0


class Counting(wordids.BatchEncoder):
    """Keeps how many plain pieces were asked for at once, and each text."""

    def __init__(self, *args):
        super().__init__(*args)
        self.asked, self.texts = [], []

    def of_pieces(self, made):
        self.asked.append(len(made))
        return super().of_pieces(made)

    def of_text(self, text):
        self.texts.append(text)
        return super().of_text(text)


@pytest.mark.parametrize("limit", [1 << 24, 1 << 12])
def test_new_words_of_a_batch_are_encoded_together(limit):
    """A call per distinct word took most of the time of op12_token_ids."""
    words = [f"{a}{b}ing{c}" for a in "bcdfghjklm" for b in ("a", "e", "ö", "ß") for c in "nprstvwxz"]
    odd = ["it's", "漢字", "a<|b", "naïve", "a<b", "œuvre", "<|endoftext|>", "x" * 3000]
    texts = [" ".join(words[i::3] + odd) for i in range(3)] * 2
    encoder = Counting(idfiles.word_bpe(), limit)
    ((lo, hi, ids, per_text),) = encoder(pa.array([t.encode() for t in texts], pa.binary()))
    assert (lo, hi) == (0, 6)
    assert [x.tolist() for x in np.split(ids, np.cumsum(per_text)[:-1])] == [expected(idfiles.word_bpe(), t, 1)[:-1] for t in texts]
    assert encoder.asked == [len({*words, "naïve", "a", "<", "b", "x" * 3000})]
    assert sorted(encoder.texts) == sorted({"it's", "漢字", "a<|b", "œuvre", "<|endoftext|>"})
    list(encoder(pa.array([t.encode() for t in texts], pa.binary())))
    assert (len(encoder.asked) == 1) == (limit == 1 << 24)  # forgotten words are encoded anew


def test_readers_of_files_forget_words():
    """Idle workers kept the words of the writing stage, up to their limit each."""
    wordids.batch_encoder(idfiles.word_bpe(), 1 << 20)

    class Files:
        """Files that are read in this process."""

        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            data = idfiles.file_bytes(0, 0, [3, 4], np.array([2, 1]), np.array([5, 6, 1]), 64) + b"\n"
            return list(run(iter([pa.record_batch([pa.array([data])], ["content"])])))

    class Session:
        read = Files()

    (rows,) = idfiles.read_files(Session(), "", "ids_crc32 long", idfiles.checksums)
    assert rows.column("n_tokens").to_pylist() == [2, 1]
    assert wordids.batch_encoder.cache_info().currsize == 0
