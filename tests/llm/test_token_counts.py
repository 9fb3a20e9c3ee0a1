import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import token_counts
from ragloom.llm.packing import byte_bpe
from ragloom.llm.token_counts import Counter, CountParams, Sums, Tree, build, edited, with_edits

ALPHABET = "ab re'st 1.\n\t é漢 '"
MADE: list[Counter] = []


def counter():
    if not MADE:
        MADE.append(Counter(byte_bpe(), 10_000))
    return MADE[0]


@settings(max_examples=600, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.lists(st.tuples(st.integers(-2, 130), st.integers(0, 12), st.text(ALPHABET, max_size=8)), max_size=5), st.integers(1, 6))
def test_edits_equal_encoding_anew(text, edits, leaf):
    params = CountParams(leaf=leaf)
    tree = Tree(text, *counter()(text), params)
    for start, length, new in edits:
        tree.edit(start, length, new, counter())
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[start + length :]
        got, lengths, counts = tree.parts()
        want = counter()(text)
        assert got == text
        assert lengths.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()
        assert tree.tokens.total() == want[1].sum() and tree.chars.total() == len(text)
        leaves = [tree.leaf(i) for i in range(len(tree.leaves))]
        assert [len(x[0]) for x in leaves] == [int(x[1].sum()) for x in leaves]
        assert tree.chars.node[tree.chars.size :][: len(leaves)] == [len(x[0]) for x in leaves]


def test_sums_find():
    sums = Sums(np.array([3, 0, 4, 1]))
    assert [sums.find(p) for p in range(8)] == [(0, 0)] * 3 + [(2, 3)] * 4 + [(3, 7)]
    sums.put(0, 1)
    assert sums.total() == 6 and sums.find(1) == (2, 1)


def test_only_the_region_is_encoded():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = Tree(text, *counter()(text), CountParams())
    tree.edit(50_000, 3, "xyz zy", counter())
    assert tree.encoded < 500


def test_tables(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe())
    plain.encode_special_tokens = True
    rows = [(1, "hello wörld", 0), (2, None, 0), (3, "", 0), (None, "no id", 0), (4, "twice", 0), (4, "twice", 0), (5, "long one " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts int")
    edits = spark.createDataFrame(
        [(1, 2, 0, 5, "bye"), (1, 1, 6, None, "dear "), (2, 1, 5, 5, "new"), (4, 1, -3, 1, None), (5, 1, 100_000, 7, "é"), (9, 1, 0, 0, "x"), (1, 3, None, 1, "skipped")],
        "doc_id long, seq int, start int, length int, replacement string")
    got = edited(with_edits(build(docs, byte_bpe()), edits), byte_bpe()).collect()
    want = {1: "bye dear wörld", 2: "new", 3: "", None: "no id", 4: "wice", 5: ("long one " * 30_000)[:100_000] + "é" + ("long one " * 30_000)[100_007:]}
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 4, 5]
    for r in got:
        assert r.text == want[r.doc_id]
        assert r.n_tokens == len(plain.encode(r.text, add_special_tokens=False).ids) == np.frombuffer(r.counts, "<u4").sum()


def test_one_pass_equals_two(spark):
    rows = [(1, "hello wörld it's\n\n x", [(1, 6, 0, "dear "), (0, 0, 5, "bye")]), (2, None, [(1, 0, 0, "new words.")]), (None, "", None), (4, "twice 42", []), (4, "x" * 300, [(1, None, 1, "x")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<seq:long,start:long,length:long,replacement:string>>")
    params = CountParams(leaf=3)
    two = edited(build(docs, byte_bpe(), params, keep=("edits",)), byte_bpe(), params)
    one = token_counts.edited_texts(docs, byte_bpe(), params)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert token_counts.edited_texts(docs.filter("false"), byte_bpe()).count() == 0


def test_query_equals_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(byte_bpe())
    plain.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = token_counts.op9_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.tokens_before == len(plain.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    edits = spark.createDataFrame([], "doc_id long, seq int, start int, length int, replacement string")
    assert edited(with_edits(build(docs, byte_bpe()), edits), byte_bpe()).count() == 0
