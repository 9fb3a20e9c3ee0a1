"""Cases in which an operator once did less than the whole job."""

import gzip
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ragloom.llm import langid, toxicity, warc

# -- 6 language --------------------------------------------------------------


def test_letters_stay_apart():
    first, second = langid.symbols()
    letters = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    lower = {ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters}
    assert len({(int(first[c]), int(second[c])) for c in letters}) == len(lower)
    assert first.max() < 1 << langid.BITS and (first[letters] != 32).all()


def test_every_ngram_has_its_place(spark):
    rnd = np.random.default_rng(0)
    texts = ["".join(x) for x in rnd.choice(list("abcdefghijklmnopqrstuvwxyz漢字กข"), (20, 10_000))]
    train = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    params = langid.LangidParams()
    model = langid.train(train, params)[0][0]
    seen = {int(g) for _, _, gram, _ in langid.grams(pa.array([t.encode() for t in texts], pa.binary()), 4) for g in gram}
    assert len(seen) > 100_000
    assert set(model.logp[4][0].tolist()) == seen


# -- 10 toxicity -------------------------------------------------------------


def test_a_rare_but_certain_term_is_a_feature():
    params = toxicity.ToxicityParams()
    # a term in 900 of 1,000 toxic rows beside one in 40 of them, neither in 9,000 clean rows
    grams = pd.DataFrame({"gram": [1, 2, 3], "clean": [0, 0, 900], "toxic": [900, 40, 100]})
    _, strong = toxicity.ratios(grams, 9000, 1000, params)
    assert strong.tolist() == [True, True, False]


def test_ngrams_do_not_share_keys():
    rnd = np.random.default_rng(1)
    text = bytes(rnd.integers(97, 123, 200_000).astype(np.uint8))
    params = toxicity.ToxicityParams()
    got = np.concatenate([gram for _, _, gram in toxicity.present(pa.array([text], pa.binary()), params)])
    framed = b" " + text + b" "
    want = {(n, framed[k : k + n].ljust(n, b"\0")) for n in params.orders for k in range(len(framed))}
    assert len(got) == len(set(got.tolist())) == len(want)
    # as positions among some of them
    some = np.sort(got)[::7]
    found = np.concatenate([at for _, _, at in toxicity.present(pa.array([text, b"zz"], pa.binary()), params, some)])
    assert sorted(set(found.tolist())) == list(range(len(some)))


# -- 2 archives --------------------------------------------------------------


def archived(n):
    pages = [f"<p>{i}</p>".encode() * 3000 + np.random.default_rng(i).bytes(3000).hex().encode() for i in range(n)]
    return [warc.record(i, f"http://x/{i}", p, warc.base32_sha1(p), None, False, "2024-01-01T00:00:00Z") + warc.END for i, p in enumerate(pages)]


def names(found):
    return [int(f[4]["warc-record-id"].strip("<>").removeprefix(warc.NAME)) for f in found if f[0] == "record"]


@pytest.mark.parametrize("level", [0, 6])
def test_members_of_many_records_lose_only_what_is_damaged(level):
    parts = archived(6)
    inside = b"".join(p.replace(b"<p>2</p>", b"<p>X</p>", 1) for p in parts)
    found = list(warc.salvage(gzip.compress(inside, level)))
    assert names(found) == [0, 1, 3, 4, 5]
    start = len(parts[0] + parts[1])
    assert [(f[3], f[6]) for f in found if f[0] == "gap"] == [("block digest differs", (start, len(parts[2])))]
    whole = gzip.compress(b"".join(parts), level)
    cut = list(warc.salvage(whole[: len(whole) * 3 // 4]))
    assert names(cut) == [0, 1, 2, 3] and cut[-1][:4] == ("gap", 0, len(whole) * 3 // 4, "gzip member truncated")
    # the first member breaks off, the next one follows
    both = list(warc.salvage(whole[: len(whole) * 3 // 4] + gzip.compress(parts[5])))
    assert set(range(6)) - {4} == set(names(both)) and len(names(both)) == 5
