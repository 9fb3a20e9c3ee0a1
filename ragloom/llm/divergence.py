"""How far the sources of a language lie apart in their words, over terms found by iceberg prefix refinement.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the terms that lie in at least ``min_docs`` of its documents. They
are found level by level: the first pass counts, for each language, the documents
that hold each prefix of ``first_bytes`` bytes; prefixes below the threshold are
discarded with all terms under them; the next pass counts prefixes twice as long of
the terms that are left, and so on. A term that ends within a level's bytes is
counted as a whole there. It ends when no unfinished prefix is left.

A document lies in one row, so distinct documents add up over batches and no
shuffle carries documents; a task adds up the counts of its batches, a bounded number
of rows at a time, before they leave it. The prefixes left are sent as a bit set of hashes, at most
``filter_bits`` long: a false hit costs a count at the next level, never a result,
because a term is kept by its own exact count.

Shares are integers, 1 + floor(``unit`` * (count + 2) / (N + 2 V)), with N occurrences and V kept
terms; two shares p, q lie floor((p - q)^2 / (p + q)) apart. Each group (language and source) is
compared with the other sources of its language over all kept terms, and with the
language as a whole by term.

Null text, language and source count as ''. Rows that repeat an id are documents of
their own. A group without kept terms is compared as well; where the language keeps
none, all values are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import mix, table, tidied, utf8
from ragloom.llm.registry import query
from ragloom.llm.spans import LETTER, Words, batch_words, hashes
from ragloom.session import written

#: Rows of counts that a task adds up before they leave it.
HELD = 1 << 20


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 10
    unit: int = 1_000_000_000
    top: int = 10  # terms reported of a group
    first_bytes: int = 4  # of the prefixes of the first level; each level doubles them
    filter_bits: int = 1 << 27  # 16 MB
    block_cells: int = 1 << 16  # shares (terms x sources) compared at once; more where there are many sources
    stripe: int = 256  # sources compared with all others at once


# -- kept terms --------------------------------------------------------------


class Prefixes:
    """A bit set of hashes of (language, prefix)."""

    def __init__(self, bits: int, bit_set: np.ndarray):
        self.bits, self.bit_set = bits, bit_set

    def has(self, lang: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """For hashes of languages and of prefixes."""
        at = places(lang, prefix, self.bits)
        return (self.bit_set[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def places(lang: np.ndarray, prefix: np.ndarray, bits: int) -> np.ndarray:
    """A place below ``bits`` for each (hash of a language, hash of a prefix)."""
    return mix(prefix ^ lang) & np.uint64(bits - 1)


def lang_hashes(lang: pa.Array) -> np.ndarray:
    return mix(hashes(lang.cast(pa.large_binary())))


def bit_set(kept: DataFrame, n: int, limit: int) -> Prefixes:
    """The (lang, term) rows of ``kept`` as a bit set of 16 bits a row, ``limit`` at most."""
    bits = min(limit, max(1 << 12, 1 << (16 * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(lang_hashes(batch.column("lang")), hashes(batch.column("term")), bits)
            ones = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(ones.view(np.int64))], ["word", "ones"])

    words = kept.select("lang", "term").mapInArrow(run, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones"))
    found = words.toArrow()  # ``bits`` / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["ones"].to_numpy().view(np.uint64)
    return Prefixes(bits, out)


def coded(words: Words, chosen: np.ndarray, limit: int | None, langs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of the chosen words' prefixes, and the code language * values + value of each word."""
    values = words.array(chosen, limit).dictionary_encode()
    return values.dictionary, langs[words.text[chosen]] * len(values.dictionary) + values.indices.to_numpy()


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and how often each occurs."""
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(first, append=len(code))


class Counts:
    """Counts of terms under names (of a language, or of a language and source), added up over batches."""

    def __init__(self, names: list[str], limit: int = HELD):
        self.names, self.limit = names, limit
        self.empty()

    def empty(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.tables: list[pa.Table] = []
        self.rows = 0

    def number(self, names: list[tuple]) -> np.ndarray:
        """A number for each name, the same until the rows are given out."""
        return np.array([self.numbers.setdefault(name, len(self.numbers)) for name in names], np.int32)

    def add(self, number: np.ndarray, term: pa.Array, n: np.ndarray) -> None:
        self.tables.append(pa.table({"number": number, "term": term.cast(pa.binary()), "n": n.astype(np.int64)}))
        self.rows += len(n)

    def full(self) -> bool:
        """Adds the rows up when they are too many; whether they should leave, as that made them few no longer."""
        if self.rows <= self.limit:
            return False
        self.merge()
        return self.rows > self.limit // 2

    def merge(self) -> None:
        if len(self.tables) > 1:
            held = pa.concat_tables(self.tables).group_by(["number", "term"], use_threads=False).aggregate([("n", "sum")])
            self.tables = [held.rename_columns({"n_sum": "n"}).select(["number", "term", "n"])]
        self.rows = sum(map(len, self.tables))

    def out(self) -> Iterator[pa.RecordBatch]:
        """All rows as (name, term, n), of names of one part; nothing is held afterwards."""
        self.merge()
        names = pa.array([name for (name,) in self.numbers], pa.string())
        for table_ in self.tables:
            for batch in table_.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([names.take(batch.column("number")), batch.column("term"), batch.column("n")], [*self.names, "term", "n"])
        self.empty()

    def lists(self) -> Iterator[pa.RecordBatch]:
        """All rows as (first of the names, term, list of the second names, list of n); nothing is held afterwards."""
        self.merge()
        first, of = np.unique([a for a, _ in self.numbers], return_inverse=True)
        first, second = pa.array(first.tolist(), pa.string()), pa.array([b for _, b in self.numbers], pa.string())
        for table_ in self.tables:
            table_ = table_.append_column("first", pa.array(of[table_["number"].to_numpy()].astype(np.int32)))
            for batch in table_.group_by(["first", "term"], use_threads=False).aggregate([("number", "list"), ("n", "list")]).to_batches(max_chunksize=1 << 15):
                number, n = batch.column("number_list"), batch.column("n_list")
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(n).to_numpy())]).astype(np.int32)
                lists = (pa.ListArray.from_arrays(offsets, values) for values in (second.take(number.flatten()), n.flatten()))
                yield pa.RecordBatch.from_arrays([first.take(batch.column("first")), batch.column("term"), *lists], [self.names[0], "term", f"{self.names[1]}s", "ns"])
        self.empty()


def level(docs: DataFrame, size: int, before: Broadcast | None) -> DataFrame:
    """lang, term (the prefix), n: documents of each language with each prefix of ``size`` bytes.

    A value of fewer bytes is a whole term. Terms count that were unfinished at half
    the size and whose prefix is in ``before``.
    """
    half = 0 if before is None else size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(["lang"])
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            for words in batch_words(batch.column("text"), LETTER):
                langs = lang.indices.to_numpy()[words.lo : words.hi].astype(np.int64)
                live = np.flatnonzero(words.lengths >= half)
                if not len(live):
                    continue
                values, code = coded(words, live, size, langs)
                room = len(lang.dictionary) * len(values)
                # each (document, value) once; a document has one language
                code = distinct(words.text[live] * room + code)[0] % room
                code, n = distinct(code)
                value, of = code % len(values), code // len(values)
                if before is not None:
                    short = hashes(pc.binary_slice(values, 0, half))
                    left = before.value.has(lang_hashes(lang.dictionary)[of], short[value])
                    value, of, n = value[left], of[left], n[left]
                counts.add(counts.number([(x,) for x in lang.dictionary.to_pylist()])[of], values.take(pa.array(value)), n)
                if counts.full():
                    yield from counts.out()
        yield from counts.out()

    return docs.select("lang", "text").mapInArrow(tidied(run), "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> tuple[DataFrame, int]:
    """lang, term, n (documents) of all terms in at least ``min_docs`` documents of a language, and their number."""
    sc, size, before, found, total = docs.sparkSession.sparkContext, params.first_bytes, None, [], 0
    while True:
        left = written(level(docs, size, before).filter(F.col("n") >= params.min_docs), "divergence-level")
        whole = F.length("term") < size
        done, open_ = left.groupBy(whole.alias("whole")).count().collect(), 0
        for row in done:
            total, open_ = (total + row["count"], open_) if row["whole"] else (total, row["count"])
        found.append(left.filter(whole))
        if before is not None:
            before.unpersist()
        if not open_:
            break
        before, size = sc.broadcast(bit_set(left.filter(~whole), open_, params.filter_bits)), 2 * size
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, total


def occurrences(docs: DataFrame, kept: DataFrame, total: int, params: DivergenceParams) -> DataFrame:
    """lang, source, term, n: occurrences of each kept term in each group that has any."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_set(kept, total, params.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(["lang", "source"])
        for batch in batches:
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            _, first, of_doc = np.unique(pair, return_index=True, return_inverse=True)
            groups = list(zip(batch.column("lang").take(first).to_pylist(), batch.column("source").take(first).to_pylist(), strict=True))
            hash_of = lang_hashes(batch.column("lang").take(first))
            for words in batch_words(batch.column("text"), LETTER):
                if not len(words):
                    continue
                values, code = coded(words, np.arange(len(words)), None, of_doc[words.lo : words.hi])
                code, n = distinct(code)
                group, value = code // len(values), code % len(values)
                left = wanted.value.has(hash_of[group], hashes(values)[value])
                counts.add(counts.number(groups)[group[left]], values.take(pa.array(value[left])), n[left])
                if counts.full():
                    yield from counts.lists()
        yield from counts.lists()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15:
                done, last = neighbours(held)
                yield from done
                held, rows = [last], last.num_rows
        if rows:
            done, last = neighbours(held)
            yield from [*done, summed(last)]

    rows = docs.select("lang", "source", "text").mapInArrow(tidied(run), "lang string, term binary, sources array<string>, ns array<long>")
    # dealt out once for both the join and the sums; a task gives a term of a language in few rows, so a frequent one is no hot key
    rows = rows.repartition("term", "lang").join(kept.select("lang", "term"), ["term", "lang"], "left_semi")
    rows = rows.sortWithinPartitions("term", "lang").select("lang", "term", "sources", "ns")
    return rows.mapInArrow(tidied(added), "lang string, source string, term binary, n long")


def summed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n of rows (lang, term, sources, ns), equal terms side by side."""
    lang, term = rows.column("lang"), rows.column("term")
    new = np.concatenate([[True], runs_end(lang, term)]) if len(rows) else np.zeros(0, bool)
    run = np.cumsum(new, dtype=np.int64) - 1
    number = run[pc.list_parent_indices(rows.column("ns")).to_numpy()]
    flat = pa.table({"run": number, "source": rows.column("sources").flatten(), "n": rows.column("ns").flatten()})
    flat = flat.group_by(["run", "source"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    at = pa.array(np.flatnonzero(new)[flat["run"].to_numpy()])
    whole = pa.table({"lang": lang.take(at), "source": flat["source"], "term": term.take(at), "n": flat["n_sum"]}).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns], whole.column_names)


def runs_end(lang: pa.Array, term: pa.Array) -> np.ndarray:
    """Which rows but the last differ from the next in language or term."""
    return pc.or_(pc.not_equal(lang[:-1], lang[1:]), pc.not_equal(term[:-1], term[1:])).to_numpy(zero_copy_only=False)


def neighbours(held: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
    """The sums of all terms that end within these sorted rows, and the rows of the last term, which may go on."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    ends = np.flatnonzero(runs_end(rows.column("lang"), rows.column("term")))
    cut = int(ends[-1]) + 1 if len(ends) else 0
    if cut:
        return [summed(rows.slice(0, cut))], rows.slice(cut)
    # one term alone: its counts so far become one row
    one = summed(rows)
    lists = (pa.ListArray.from_arrays(np.array([0, len(one)], np.int32), one.column(c)) for c in ("source", "n"))
    return [], pa.RecordBatch.from_arrays([rows.column("lang")[:1], rows.column("term")[:1], *lists], rows.schema.names)


# -- shares ------------------------------------------------------------------


def share(n: str, total: str, terms: str, unit: int) -> Column:
    """1 + floor(unit * (n + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + (cast({unit} as decimal(20, 0)) * cast({n} + 2 as decimal(18, 0))) div cast({total} + 2 * {terms} as decimal(18, 0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def between_sources(counts: DataFrame, groups: DataFrame, params: DivergenceParams) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    Terms are dealt to blocks of about ``block_cells`` shares; a block is a
    task's matrix of shares, and its sums are one row per two sources.
    """
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("terms"))
    size = size.select(
        # a block gives a row per two sources, so it holds some times as many shares
        "lang", F.ceil(F.col("terms") * F.col("sources") / F.greatest(F.lit(params.block_cells), F.least(4 * F.col("sources") ** 2, F.lit(1 << 22)))).cast("int").alias("blocks"),
        F.ceil(F.col("sources") / params.stripe).cast("int").alias("stripes"),
    )
    base = groups.join(size, "lang").withColumn("p", F.when(F.col("v") > 0, share("0", "total", "v", params.unit)).otherwise(F.lit(1)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = base.select("lang", "source", F.lit(None).cast("binary").alias("term"), "p", number.alias("stripe_of"), "blocks", "stripes")
    all_blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))).alias("block")
    sources = base.select("*", all_blocks)
    shares = counts.join(base.select("lang", "source", "blocks", "stripes"), ["lang", "source"]).join(groups, ["lang", "source"])
    shares = shares.select(
        "lang", "source", "term", share("n", "total", "v", params.unit).alias("p"), F.lit(-1).alias("stripe_of"), "blocks", "stripes",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
    )
    rows = shares.unionByName(sources).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    step = params.stripe

    def block(rows: pa.Table) -> pa.Table:
        given = pc.is_valid(rows["term"])
        base, terms = rows.filter(pc.invert(given)).sort_by("stripe_of"), rows.filter(given)
        names, lang, stripe = base["source"].combine_chunks(), rows["lang"][0], rows["stripe"][0].as_py()
        term = terms["term"].combine_chunks().dictionary_encode()
        p = np.repeat(base["p"].to_numpy()[:, None], len(term.dictionary), axis=1)
        p[pc.index_in(terms["source"], names).to_numpy(), term.indices.to_numpy()] = terms["p"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for a in range(step * stripe, min(len(p), step * (stripe + 1))):
            value = ((p - p[a]) ** 2 // (p + p[a])).sum(axis=1)
            others = np.delete(np.arange(len(p)), a)
            for col, part in zip(out, (np.full(len(others), a), others, value[others]), strict=True):
                col.append(part)
        a, b, value = (np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in out)
        return pa.table({"lang": pa.repeat(lang, len(a)), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": value})

    sums = rows.groupBy("lang", "block", "stripe").applyInArrow(block, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def from_language(counts: DataFrame, groups: DataFrame, params: DivergenceParams) -> DataFrame:
    """lang, source, item, value of the terms that a group has, with a share above the language's."""
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    rows = counts.join(langs, ["lang", "term"]).join(groups.join(totals, "lang"), ["lang", "source"])
    rows = rows.withColumns({"p": share("n", "total", "v", params.unit), "q": share("n_lang", "total_lang", "v", params.unit)})
    return rows.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), apart("p", "q").alias("value"))


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", order)
    out = out if top is None else out.filter(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, params: DivergenceParams = DivergenceParams(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows, a group against the other sources of
    its language, and ``term`` rows, the terms that set it off from the language."""
    held = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    docs = docs.select(*held, utf8(docs[text_col]).alias("text"))
    kept, total = kept_terms(docs, params)
    counts = written(occurrences(docs, kept, total, params), "divergence-counts")
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = written(groups.fillna(0, ["total", "v"]), "divergence-groups")
    return ranked(between_sources(counts, groups, params), "pair").unionByName(ranked(from_language(counts, groups, params), "term", params.top))


@query(
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents),
    t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    g AS (
        SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, sum(coalesce(total, 0)) OVER (PARTITION BY lang) AS total_lang
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total::HUGEINT + 2 * v) AS p
          FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total_lang::HUGEINT + 2 * v) AS q
          FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN (SELECT DISTINCT lang, v, total_lang FROM g) USING (lang)),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
        FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                   FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS f
          ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    r AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value FROM terms)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM r QUALIFY part = 'pair' OR rank <= 10
    """
)
def op13_source_divergence(spark, sf_dir):
    """The sources of each language against each other and their own terms, over all documents."""
    return audit(table(spark, sf_dir, "documents"))
