"""Benchmark decontamination: one Aho-Corasick automaton scans each text once.

Items (questions and answers) and texts become words: A-Z lower-cased, runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Every run of ``window`` words of an item, or
all words of a shorter one, is a pattern of the automaton, which runs over the
words of a text joined by single spaces. Matches map back to word numbers and
to code-point offsets in the original text.

Null and empty texts have no words and no hits. An item without words has no
window. Repeated items count by their distinct ids; items with a null id are
matched and counted under the id null, which the list of ids leaves out.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import byte_view, table, utf8
from ragloom.llm.registry import query

#: Lower-cases A-Z and blanks every ASCII character that is no letter or digit.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10  # words
    block_bytes: int = 8 << 20  # item text behind one automaton; more items mean more scans


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def patterns(items: list[tuple[object, bytes]], window: int) -> dict[str, tuple[int, tuple]]:
    """Window text, framed by spaces, to its number of words and the ids that have it."""
    found: dict[str, set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[" " + b" ".join(words[i : i + window]).decode("latin-1") + " "].add(item)
    return {p: (p.count(" ") - 1, tuple(sorted(ids, key=lambda x: (x is None, x)))) for p, ids in found.items()}


def automaton(known: dict[str, tuple[int, tuple]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for pattern, what in known.items():
        made.add_word(pattern, what)
    if known:
        made.make_automaton()
    return made


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (first, last) put together where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def found_in(text: bytes, made: ahocorasick.Automaton) -> dict:
    """Words, ids of items and matched spans of one text."""
    blank = text.translate(WORDS)
    words = blank.split()
    if not words or not len(made):
        return {"n_words": len(words), "items": [], "spans": []}
    line = " " + b" ".join(words).decode("latin-1") + " "
    items, runs, gaps = set(), [], None
    for end, (n, ids) in made.iter(line):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(gaps, end)) - 1  # the pattern ends on the space after its last word
        runs.append((last - n + 1, last))
        items.update(ids)
    if not runs:
        return {"n_words": len(words), "items": [], "spans": []}
    word = np.frombuffer(blank, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]])))
    # code points before each byte: bytes that continue a character do not count
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = [
        {"first_word": a, "last_word": b, "start": int(points[edge[2 * a]]), "end": int(points[edge[2 * b + 1]])}
        for a, b in merged(runs)
    ]
    return {"n_words": len(words), "items": sorted((i for i in items if i is not None)), "spans": spans}


def scanner(known: dict[str, tuple[int, tuple]]):
    """Text column to words, items and spans; each task builds the automaton once."""
    built: list[ahocorasick.Automaton] = []

    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        if not built:
            built.append(automaton(known))
        data, offsets = byte_view(text)
        rows = [found_in(data[a:b].tobytes(), built[0]) for a, b in zip(offsets, offsets[1:])]
        return pa.array(rows, pa.struct([
            ("n_words", pa.int64()), ("items", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "last_word", "start", "end")]))),
        ]))

    return lambda text: scan(utf8(text))


def blocks(benchmark: DataFrame, params: DecontaminationParams, id_col: str, text_col: str) -> list[dict]:
    """Patterns of the benchmark, in as many blocks as its size asks for; each block is bounded."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("id"), utf8(benchmark[text_col]).alias("text"))
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = max(1, -(-size // params.block_bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [
        patterns([(r.id, bytes(r.text)) for r in items.filter(part == k).collect()], params.window) for k in range(n)
    ]


def scan(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(),
         text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Column:
    """The result of scanning a text column of ``docs``: struct n_words, items, spans.

    A benchmark beyond one block is scanned block by block and put together per
    row, without a shuffle.
    """
    found = [scanner(known)(docs[text]) for known in blocks(benchmark, params, item_id, item_text)]
    if len(found) == 1:
        return found[0]
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found]))))
    spans = F.array_sort(F.flatten(F.array(*[f["spans"] for f in found])))

    def join(out, span):
        last = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (span["first_word"] <= F.try_element_at(out, F.lit(-1))["last_word"] + 1)
        wide = F.struct(
            last["first_word"].alias("first_word"), F.greatest(last["last_word"], span["last_word"]).alias("last_word"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
        )
        return F.when(touches, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wide))).otherwise(F.concat(out, F.array(span)))

    empty = F.from_json(F.lit("[]"), RESULT["spans"].dataType)
    return F.struct(found[0]["n_words"].alias("n_words"), items.alias("items"), F.aggregate(spans, empty, join).alias("spans"))


def n_hit(found: Column) -> Column:
    """Words inside any matched span."""
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark; columns unchanged."""
    doc = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    return doc.filter(F.size(scan(doc, benchmark, params)["spans"]) == 0).select("doc.*")


@query(
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
        FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
    pos AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
    sizes AS (SELECT DISTINCT n FROM bw),
    hits AS (
        SELECT doc_id, i, n, item_id
        FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM pos, sizes WHERE i + n - 1 <= len(w)) JOIN bw USING (n, win)),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op5_decontamination(spark, sf_dir):
    """Every document scanned for the windows of all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", scan(docs, table(spark, sf_dir, "benchmark")).alias("f"))
    ids = F.array_join(F.array_sort(F.transform("f.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "f.n_words", n_hit(F.col("f")).alias("n_hit"), F.size("f.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("f.spans") > 0).alias("contaminated"),
    )
