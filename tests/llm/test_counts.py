"""Counts of terms, added up in a task before they leave it."""

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm import divergence


def test_counts_add_up_over_batches():
    counts = divergence.Counts(["lang"], limit=7)
    term = pa.array([b"a", b"b", b"c"], pa.large_binary())
    for _ in range(3):
        counts.add(counts.number([("x",), ("y",)])[[0, 0, 1]], term, np.array([1, 2, 3]))
        assert not counts.full()  # nine rows are three after adding up
    rows = [r for batch in counts.out() for r in batch.to_pylist()]
    assert sorted((r["lang"], r["term"], r["n"]) for r in rows) == [("x", b"a", 3), ("x", b"b", 6), ("y", b"c", 9)]
    assert not counts.rows and not counts.numbers and not list(counts.out())


@pytest.mark.parametrize("cut", [1, 2, 3, 5])
def test_lists_of_sources_add_up(cut):
    counts = divergence.Counts(["lang", "source"])
    batches = []
    for i in range(4):
        number = counts.number([("x", "p"), ("x", "q"), ("y", "p")])
        counts.add(number, pa.array([b"a", b"a", b"b"], pa.binary()), np.array([1, 10, 100 + i]))
        batches += list(counts.lists())
    table = pa.Table.from_batches(batches).sort_by([("term", "ascending"), ("lang", "ascending")]).combine_chunks()
    found, held = [], []
    for batch in table.to_batches(max_chunksize=cut):
        done, last = divergence.neighbours([*held, batch])
        found, held = found + done, [last]
    found = [r for batch in [*found, divergence.summed(held[0])] for r in batch.to_pylist()]
    assert sorted((r["lang"], r["source"], r["term"], r["n"]) for r in found) == [("x", "p", b"a", 4), ("x", "q", b"a", 40), ("y", "p", b"b", 406)]
