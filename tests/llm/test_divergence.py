"""Prefix refinement and the audit against plain loops."""

import random
import re
from collections import Counter, defaultdict

from ragloom.llm import divergence
from ragloom.llm.common import utf8
from ragloom.llm.divergence import DivergenceParams


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, p):
    rows = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    held = defaultdict(set)
    for i, (lang, _, words) in enumerate(rows):
        for w in words:
            held[lang, w].add(i)
    kept = defaultdict(list)
    for (lang, w), docs in held.items():
        if len(docs) >= p.min_docs:
            kept[lang].append(w)
    counts = defaultdict(Counter)
    for lang, source, words in rows:
        for who in ((lang, source), (lang, None)):
            counts[who].update(w for w in words if w in kept[lang])
    out = []
    for lang, source in (k for k in counts if k[1] is not None):
        def share(who, w, lang=lang):
            return 1 + p.unit * (counts[who][w] + 2) // (sum(counts[who].values()) + 2 * len(kept[lang]))

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        parts = {"pair": [], "term": []}
        for other in (k for k in counts if k[0] == lang and k[1] not in (None, source)):
            parts["pair"].append((-sum(apart(share((lang, source), w), share(other, w)) for w in kept[lang]), other[1].encode()))
        for w in kept[lang]:
            a, b = share((lang, source), w), share((lang, None), w)
            if counts[lang, source][w] and a > b:
                parts["term"].append((-apart(a, b), w.encode()))
        for part, found in parts.items():
            for rank, (value, item) in enumerate(sorted(found)[: None if part == "pair" else p.top], 1):
                out.append((lang, source, part, item.decode(), -value, rank))
    return sorted(out)


def corpus(n, seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abé漢ß", k=rnd.choice([1, 3, 4, 5, 7, 8, 9, 16, 17]))) for _ in range(30)]
    words = stems + [s + t for s in stems[:12] for t in ("a", "bb", "ccccccccc", "d" * 9)]
    rows = []
    for _ in range(n):
        lang = rnd.choice(["en", "de", "x", None])
        some = rnd.sample(words, 25)
        rows.append((rnd.choice([" ", "1", "-"]).join(rnd.choices(some, k=rnd.randint(0, 40))).upper() if rnd.random() < 0.9 else None, lang, rnd.choice(["s1", "s2", "é", None])))
    return rows + [(None, "none", "a"), (None, "none", "b"), ("w" * 3000 + " once", "en", "s1"), ("w" * 3000, "x", "only")]


def check(spark, rows, p):
    df = spark.createDataFrame([(t, lang, s, i, i) for i, (t, lang, s) in enumerate(rows)], "text string, lang string, source string, n long, term long")
    made = divergence.audit(df.repartition(3), p)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, made.collect())) == plain(rows, p)


def test_against_a_plain_loop(spark):
    check(spark, corpus(150, 1), DivergenceParams(min_docs=6))


def test_small_blocks_stripes_and_filters_change_nothing(spark):
    # a filter of so few bits is full of false hits
    check(spark, corpus(150, 2), DivergenceParams(min_docs=9, block_cells=64, stripe=1, filter_bits=64, first_bytes=2))


def test_copies_of_a_very_long_term(spark):
    check(spark, [("Z" * 50 + " é", "en", f"s{i % 2}") for i in range(12)] + [("z" * 49, "en", "s0")] * 3, DivergenceParams())


def test_no_documents_and_no_terms(spark):
    check(spark, [("1 2", "en", "a"), ("", "en", "b"), (None, None, None)], DivergenceParams())
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_only_prefixes_that_last_are_extended(spark):
    rows = [(f"common{'x' * 10} rare{'abcdefghij'[i]}{'y' * 20}", "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("text", utf8(divergence.F.col("text")))
    kept, n = divergence.kept_terms(docs)
    assert n == 1 and [(r["lang"], bytes(r["term"]), r["n"]) for r in kept.collect()] == [("en", b"common" + b"x" * 10, 10)]
    first = divergence.level(docs, 4, None).filter("n >= 10")
    assert sorted(bytes(r["term"]) for r in first.collect()) == [b"comm", b"rare"]
    before = spark.sparkContext.broadcast(divergence.bit_set(first.limit(0).unionByName(first.filter("term = cast('comm' as binary)")), 1, 1 << 20))
    assert [bytes(r["term"]) for r in divergence.level(docs, 8, before).collect()] == [b"commonxx"]
