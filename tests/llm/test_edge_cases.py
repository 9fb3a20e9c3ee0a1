"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; against plain loops."""

import random

import pytest
from brute import contamination, jaccard_components, shingle_set, squeezed
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, exact_dedup, jaccard_join, langid, license_scan, pitman_yor, toxicity
from ragloom.llm.exact_dedup import DedupParams, FuseFilter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
CLASH = ["node", "n", "digest", "kept", "row", "id", "tokens", "h", "words", "score", "_y", "held"]


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


def near(text, seed, edits):
    rnd, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 999)}"
    return " ".join(words)


def edge_rows():
    base = sentence(1, 120)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, "Two words"), (6, "two  WORDS"), (7, base), (8, base.upper())]
    rows += [(100 + i, near(base, i, i % 7)) for i in range(30)]
    rows += [(200 + i, near(sentence(2, 12), i, i % 3)) for i in range(20)]
    rows += [(300 + i, " ".join(WORDS[: 3 + i % 5]) + (" x" if i % 2 else "")) for i in range(12)]
    rows += [(400, sentence(3, 20_000)), (401, sentence(3, 20_000) + " tail"), (402, "é漢字 \U0001f600 " * 50), (403, "a\x00b \x0b c\x1fd")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# -- 4 exact dedup -----------------------------------------------------------


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup(docs, digest_chars):
    """With one hex digit most digests collide, and only the byte check tells texts apart."""
    got = exact_dedup.decide(docs, DedupParams(digest_chars=digest_chars, bucket_keys=8), arrivals=3).select("doc.doc_id", "doc.text", "keep.id", "group_size", "kept").collect()
    groups = {}
    for i, t in edge_rows():
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(edge_rows())
    kept = {}
    for r in got:
        g = groups[squeezed(r.text)]
        assert (r.id, r.group_size) == (min(g)[3], len(g))
        kept[squeezed(r.text)] = kept.get(squeezed(r.text), 0) + r.kept
    assert set(kept.values()) == {1}


def test_unique_keeps_columns(docs, nothing):
    out = exact_dedup.unique(docs)
    assert out.columns == docs.columns and out.count() == len({squeezed(t) for _, t in edge_rows()})
    assert exact_dedup.unique(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    import numpy as np

    keys = np.random.default_rng(n).integers(0, 1 << 60, n, dtype=np.uint64)
    f = FuseFilter.build(keys)
    assert f.holds(keys).all()
    other = np.random.default_rng(n + 1).integers(1 << 60, 1 << 61, 20_000, dtype=np.uint64)
    assert f.holds(other).mean() < 0.01 and len(f.prints) < 1.5 * n + 64


# -- 7 near duplicates -------------------------------------------------------


@pytest.mark.parametrize("cell_nodes, subset_keys", [(4096, 4096), (5, 4096), (4096, 0)])
def test_jaccard(docs, cell_nodes, subset_keys):
    rows = edge_rows()
    params = jaccard_join.JaccardParams(cell_nodes=cell_nodes, subset_keys=max(1, subset_keys))
    got = jaccard_join.classes(docs, params).collect()
    want = sorted(((rows[i][0], n, c if n else rows[i][0]) for i, (n, c) in jaccard_components(rows).items()), key=repr)
    assert sorted(((r.id, r.n, r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("boundary", [None, 0, 9, 14])
def test_small_sets_by_subsets(spark, boundary):
    """Sets of up to 14 shingles, by subsets and by lists, against all pairs."""
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        words = [f"w{i // 6}x{k}" for k in range(rnd.randint(5, 18))]
        if rnd.random() < 0.7:
            words = words[: rnd.randint(5, len(words))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n, r.component_id) for r in jaccard_join.classes(docs, jaccard_join.JaccardParams(boundary=boundary)).collect()}
    assert got == {rows[i][0]: v for i, v in jaccard_components(rows).items()}


def test_subset_keys_are_as_many_as_counted():
    import numpy as np

    for n, have in ((1, 1), (5, 5), (9, 8), (12, 12)):
        keys = jaccard_join.subset_keys(n, np.arange(have, dtype=np.uint64), 80, 100)
        assert len(keys) == jaccard_join.subset_count(n, have, 80)


def test_distinct_texts(docs, nothing):
    out = jaccard_join.distinct_texts(exact_dedup.unique(docs))
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    sizes = [s for s in (shingle_set(t) for _, t in rows) if s]
    assert len(sizes) == len({(c, n) for i, (n, c) in jaccard_components(rows).items() if n}) == len({c for c in jaccard_components(rows).values() if c[0]})
    assert jaccard_join.distinct_texts(nothing).count() == 0


# -- 5 decontamination -------------------------------------------------------


def bench_rows():
    base = sentence(1, 120).split(" ")
    return [(1, " ".join(base[20:45])), (2, "ONE"), (3, None), (4, ""), (5, "..."), (5, " ".join(base[30:41])), (None, "漢字"), (6, "nowhere to be found in any of these texts at all"), (7, "two, words")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, block_bytes):
    bench = spark.createDataFrame([(*r, 0) for r in bench_rows()], "item_id long, text string, n int")
    params = decontaminate.DecontaminationParams(block_bytes=block_bytes)
    got = docs.select("text", decontaminate.scan(docs, bench, params).alias("f")).collect()
    want = dict(zip([t for _, t in edge_rows()], contamination([t for _, t in edge_rows()], bench_rows())))
    for r in got:
        n, hit, ids = want[r.text]
        assert r.f.n_words == n and r.f["items"] == sorted(i for i in ids if i is not None)
        assert {w for s in r.f.spans for w in range(s.first_word, s.last_word + 1)} == hit
        for s in r.f.spans:
            assert len(decontaminate.words_of(r.text[s.start : s.end].encode())) == s.last_word - s.first_word + 1
    clean = decontaminate.clean(docs, bench, params)
    assert clean.columns == docs.columns and clean.count() == sum(not want[t][1] for _, t in edge_rows())


def test_decontamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.clean(nothing, none).count() == 0


# -- 10 toxicity -------------------------------------------------------------


def test_toxicity(spark, docs, nothing):
    rows = [(i, sentence(i, 30) + (" vile brute" if i % 4 == 0 else "")) for i in range(200)]
    texts = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _text string")
    marks = [(i, int(i % 4 == 0), 9) for i in range(150)] + [(3, None, 9), (None, 1, 9), (4, 7, 9)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, _y int")
    model = toxicity.train(texts, labels)
    got = {r.doc_id: r.s for r in texts.select("doc_id", toxicity.score(texts, model).alias("s")).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i, _ in rows)
    edge = docs.select("text", toxicity.score(docs, model).alias("s")).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r.s <= 1 for r in edge)
    assert len({r.s for r in edge if r.text in (None, "")}) == 1
    # the same rows twice, in other partitions, give the same model; a bound on the sample holds
    again = toxicity.train(texts.repartition(7), labels, params=toxicity.ToxicityParams())
    assert (again.weights == model.weights).all()
    few = toxicity.train(texts, labels, params=toxicity.ToxicityParams(fit_rows=60))
    assert set(few.features) == set(model.features)
    for lost in (toxicity.train(nothing, labels), toxicity.train(texts, labels.filter("toxic = 0"))):
        assert not len(lost.features) and texts.select(toxicity.score(texts, lost)).distinct().count() == 1


def test_toxicity_features_equal_a_loop():
    import pyarrow as pa

    params = toxicity.ToxicityParams()
    texts = [b"Ab cab", b"", b"abc", None, "é".encode()]
    found = {}
    for lo, text, gram in toxicity.present(pa.array(texts, pa.binary()), params):
        for t, g in zip(text.tolist(), gram.tolist()):
            found.setdefault(lo + t, set()).add(g)
    for i, t in enumerate(texts):
        framed = b" " + (t or b"").lower() + b" "
        want = set()
        for n in params.orders:
            for k in range(len(framed)):
                code = int.from_bytes(framed[k : k + n], "little")
                want.add(((code + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - params.bits))
        assert found[i] == want


# -- 6 language --------------------------------------------------------------


def test_language(spark, docs, nothing):
    en = ["the house and the garden are green", "that man is walking with the dog"]
    de = ["das haus und der garten sind grün", "der mann geht mit dem hund durch die stadt"]
    rows = [(i, (en + de)[i % 4] + f" {i}", "en" if i % 4 < 2 else "de") for i in range(40)] + [(99, None, "en"), (98, "text", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    params = langid.LangidParams()
    blocks = langid.train(train, params)
    langs = [m.lang for b in blocks for m in b]
    assert langs == ["de", "en"]
    scored = train.select("text", "lang", langid.measured(train, blocks, params).alias("h"))
    out = langid.identify(scored, langs, *langid.calibrate(scored, langs, params)).collect()
    assert all(r.lang_pred == r.lang for r in out if r.text and r.lang)
    edge = docs.select("text", langid.measured(docs, blocks, params).alias("h"))
    for r in langid.identify(edge, langs, 4.0, {}).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.rejected)
    # one language per block gives the same entropies
    apart = langid.train(train, langid.LangidParams(block_bytes=1))
    assert len(apart) == 2
    a = [r.h for r in scored.collect()]
    b = [r.h for r in train.select(langid.measured(train, apart, params).alias("h")).collect()]
    assert a == b
    assert langid.train(nothing.select("text", F.lit("en").alias("lang")), params) == []


def test_kneser_ney_sums_to_one(spark):
    """Over all symbols seen after a context the probabilities and the rest of the base add up."""
    import numpy as np

    train = spark.createDataFrame([("abc abd abe bcd cab dab", "x")], "text string, lang string")
    params = langid.LangidParams(order=3)
    model = langid.train(train, params)[0][0]
    for context in ("ab", "c ", "zz"):
        base = (ord(context[0]) << 24) | (ord(context[1]) << 12)
        p = np.exp(model.score(np.array([base | s for s in range(4096)], np.int64), 3, params.hash_bits))
        assert p.sum() == pytest.approx(1, abs=0.02)


# -- 1 licenses --------------------------------------------------------------


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def test_license_scan(spark, nothing):
    mit = license_scan.TEMPLATES[18][1]
    rows = [(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (None, "LICENSED under the -- apache license, version 2.0"),
            (4, mit.replace(", ", ",\n")), (5, "Licensed under CC BY 4.0.\n\nLicensed under CC BY-NC 4.0."), (6, "no notice " * 20_000), (7, "the MIT"), (8, "word\n" * 5000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, words string, unit int")
    got = license_scan.scan(docs).collect()
    for r in got:
        best = max(dice(set(license_scan.bigrams_of(r.unit_text)), set(license_scan.bigrams_of(t))) for n, t in license_scan.TEMPLATES if n == r.license)
        assert best == r.dice >= 0.85
    seen = sorted((r.doc_id or 0, r.kind, r.unit, r.license) for r in got)
    assert seen == [(0, "line", 0, "Apache-2.0"), (0, "paragraph", 0, "Apache-2.0"), (1, "line", 1, "MIT"), (1, "line", 1, "MIT"), (4, "paragraph", 0, "MIT"),
                    (5, "line", 0, "CC-BY-4.0"), (5, "line", 2, "CC-BY-NC-4.0"), (5, "paragraph", 0, "CC-BY-4.0"), (5, "paragraph", 1, "CC-BY-NC-4.0")]
    assert license_scan.scan(nothing.select("doc_id", "text")).count() == 0
    assert license_scan.scan(docs, templates=()).count() == 0


@pytest.mark.parametrize("size", [1, 4, 10, 57])
def test_size_bounds(size):
    lo, hi = license_scan.bounds(size, 0.85)
    able = [a for a in range(1, 500) if 2 * min(a, size) / (a + size) >= 0.85]
    assert (lo, hi) == (able[0], able[-1])


# -- 3 language model --------------------------------------------------------


def test_scores_of_the_model(spark, docs, nothing):
    rows = pitman_yor.rows_of(docs, F.col("doc_id") % 5 == 2)
    params = pitman_yor.PitmanYorParams(part_tokens=6000, chunk_tokens=4000)
    got = pitman_yor.score(pitman_yor.train(rows, params)).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        assert r.n_tokens >= 1 and r.score < 0 and r.base_score < 0 and 0 <= r.n_known <= r.n_tokens
    total = [sum(r.score for r in got), sum(r.base_score for r in got)]
    assert total[0] > total[1]
    one = pitman_yor.score(pitman_yor.train(rows, pitman_yor.PitmanYorParams())).collect()
    assert sum(r.base_score for r in one) == pytest.approx(total[1])
    assert sum(r.score for r in one) == pytest.approx(total[0], rel=0.05)  # parts seat their customers apart
    empty = pitman_yor.rows_of(nothing, F.lit(False))
    assert pitman_yor.score(pitman_yor.train(empty, params)).count() == 0
    unseen = pitman_yor.score(pitman_yor.train(rows.withColumn("held", F.lit(True)), params)).collect()
    assert all(r.score == r.base_score == 0 for r in unseen)


def test_probabilities_sum_to_one(spark):
    """Over the known words and one unknown, after a frequent, a rare and an unknown word."""
    train = [(i, "a b a c", False) for i in range(20)] + [(50, "c d e", False)]
    known = ["a", "b", "c", "d", "e", "unseen"]
    held = [(100 + 10 * k + i, f"{first} {w}", True) for k, first in enumerate(("a", "d", "zzz")) for i, w in enumerate(known)]
    alone = [(900 + i, w, True) for i, w in enumerate(known)]
    rows = spark.createDataFrame(train + held + alone + [(999, "", True)], "id long, held boolean, text string".replace("held boolean, text string", "text string, held boolean"))
    model = pitman_yor.train(rows.withColumn("text", F.col("text").cast("binary")))
    got = {r.id: r.score for r in pitman_yor.score(model).collect()}
    ends = {}
    # P(first word | start) * P(end | word) over all first words, and the empty text, less what follows them
    for i, w in enumerate(known):
        ends[w] = got[900 + i]
    assert 10 ** got[999] < 1 and all(10**v < 1 for v in ends.values())
    assert sum(10**v for v in ends.values()) + 10 ** got[999] < 1
    better = [got[100], got[101]]  # a a / a b: b follows a more often
    assert better[1] > better[0]


def test_stirling_numbers():
    """Against seating plans of few customers counted one by one."""
    from itertools import product

    d = 0.6
    table = pitman_yor.closing(d)
    for c in range(2, 7):
        weight, single = {}, {}
        for plan in product(range(c), repeat=c):
            if plan[0] != 0 or any(plan[i] > max(plan[:i]) + 1 for i in range(1, c)):
                continue
            sizes = [plan.count(t) for t in set(plan)]
            w = 1.0
            for s in sizes:
                for k in range(1, s):
                    w *= k - d
            t = len(sizes)
            weight[t] = weight.get(t, 0) + w
            single[t] = single.get(t, 0) + w * sizes.count(1) / c
        for t in weight:
            assert table[c, t] == pytest.approx(single[t] / weight[t])
