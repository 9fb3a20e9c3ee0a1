"""Full-text side: lexeme index, web-style matching, cover-density ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import NOT_WORD, STOP_WORDS, cut_words, is_stop_word, spaced, stem, stems_of
from ragloom.operators.covers import Lists, Plan, Postings
from ragloom.params import Params
from ragloom.session import settled, ship, written

SCORE_PLACES = 9

POSTINGS = "id long, term string, positions array<int>, titled int"
STOPS = pa.array(STOP_WORDS)


def _coded(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The code of each word's stem, -1 for a stop word, and the stems by code; a distinct word is stemmed once."""
    coded = found.dictionary_encode()
    stems = pc.if_else(pc.is_in(coded.dictionary, STOPS), None, stems_of(coded.dictionary)).dictionary_encode()
    return stems.indices.fill_null(-1).to_numpy().astype(np.int64)[coded.indices.to_numpy()], stems.dictionary


def _placed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, code, position from 1 and whether in the title of all that is no stop word, title before body, and the terms."""
    lists = [cut_words(b.column("head")), cut_words(b.column("body"))]
    sizes = [c.value_lengths().fill_null(0).to_numpy() for c in lists]
    row, body_row = (np.repeat(np.arange(b.num_rows), n) for n in sizes)
    place, behind = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1 for n in sizes)
    code, terms = _coded(pa.concat_arrays([c.flatten() for c in lists]))
    in_head = code[: len(row)] >= 0
    shift = np.zeros(b.num_rows, np.int64)
    np.maximum.at(shift, row[in_head], place[in_head])
    title = np.arange(len(code)) < len(row)
    row, place = np.concatenate([row, body_row]), np.concatenate([place, behind + shift[body_row]])
    kept = code >= 0
    return row[kept], code[kept], place[kept], title[kept], terms


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys changes, the first place included."""
    changes = np.zeros(len(keys[0]), bool)
    changes[:1] = True
    for key in keys:
        changes[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changes)


def _in_order(code: np.ndarray, row: np.ndarray, place: np.ndarray, title: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same by code, row and place. Where they fit into one number together, those are sorted as they are."""
    wide = [int(x.max(initial=0)).bit_length() for x in (code, row, place)]
    if sum(wide) > 62:
        order = np.lexsort((place, row, code))
        return code[order], row[order], place[order], title[order]
    key = np.sort((((code << wide[1]) | row) << (wide[2] + 1)) | (place << 1) | title)
    part = lambda skip, n: (key >> skip) & ((1 << n) - 1)
    return part(1 + wide[2] + wide[1], wide[0]), part(1 + wide[2], wide[1]), part(1, wide[2]), (key & 1).astype(bool)


def _words_of(chunks: DataFrame, title: str, content: str) -> DataFrame:
    ship(chunks.sparkSession)
    return chunks.select("id", spaced(F.coalesce(F.col(title), F.lit(""))).alias("head"), spaced(F.coalesce(F.col(content), F.lit(""))).alias("body"))


def postings(chunks: DataFrame, title: str = "doc_title", content: str = "content", params: Params = Params()) -> DataFrame:
    """``(id, term, positions, titled, bucket, block)``, one row per chunk and term.

    Body positions follow the last title position; a null title counts as empty.
    The first ``titled`` positions lie in the title. A chunk's words are in one
    row, so its postings are made where it lies, without a shuffle. ``bucket`` is a
    hash of the term, ``block`` a range of ids.
    """
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, place, title, terms = _placed(b)
            order = np.argsort(row * len(terms) + code, kind="stable")
            row, code, place, title = row[order], code[order], place[order], title[order]
            opens = _opens(row, code)
            starts = np.append(opens, len(row)).astype(np.int32)
            titles = np.concatenate([[0], np.cumsum(title)])
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(row[opens])), terms.take(pa.array(code[opens])),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(place.astype(np.int32))),
                pa.array((titles[starts[1:]] - titles[starts[:-1]]).astype(np.int32)),
            ], names=["id", "term", "positions", "titled"])

    return _words_of(chunks, title, content).mapInArrow(group, POSTINGS).withColumns({
        "bucket": bucket_of("term", params),
        "block": F.floor(F.col("id") / params.id_block).cast("long"),
    })


def bucket_of(term: str, params: Params):
    return F.pmod(F.xxhash64(term), F.lit(params.term_buckets)).cast("int")


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Pieces of an array of numbers as bytes; ``starts`` has the end too."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(blobs: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All the numbers of a column of ``_blobs``, one after the other."""
    found = [np.empty(0, kind)]
    for part in blobs.chunks if isinstance(blobs, pa.ChunkedArray) else [blobs]:
        if len(part):  # the bytes of a column lie together
            _, offsets, data = part.buffers()
            ends = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1]
            if ends[-1] > ends[0]:
                found.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
    return found[-1] if len(found) == 2 else np.concatenate(found)


PACKED = "term string, first long, block long, ids binary, titled binary, sizes binary, positions binary"
UNPACKED_ROWS = 1 << 18


def packed_postings(chunks: DataFrame, title: str = "doc_title", content: str = "content", params: Params = Params()) -> DataFrame:
    """``postings``, those of a term in consecutive chunks of a batch in one row (``PACKED``), and their ``bucket``."""
    width = params.id_block

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            row, code, place, title, terms = _placed(b)
            run = np.zeros(b.num_rows, np.int64)
            run[1:] = np.cumsum((np.diff(ids) != 1) | (np.diff(ids // width) != 0))
            code, row, place, title = _in_order(code, row, place, title)
            opens = _opens(code, row)
            starts, titles = np.append(opens, len(row)), np.concatenate([[0], np.cumsum(title)])
            row, code = row[opens], code[opens]
            heads = _opens(code, run[row])
            ends = np.append(heads, len(row))
            first = ids[row[heads]]
            yield pa.RecordBatch.from_arrays([
                terms.take(pa.array(code[heads])), pa.array(first), pa.array(first // width),
                _blobs((ids[row] - np.repeat(first, np.diff(ends))).astype(np.int32), ends),
                _blobs(np.diff(titles[starts]).astype(np.int32), ends), _blobs(np.diff(starts).astype(np.int32), ends),
                _blobs(place.astype(np.int32), starts[ends]),
            ], names=["term", "first", "block", "ids", "titled", "sizes", "positions"])

    return _words_of(chunks, title, content).mapInArrow(pack, PACKED).withColumn("bucket", bucket_of("term", params))


def _unfolded(whole: pa.RecordBatch, *kept: str) -> Iterator[pa.RecordBatch]:
    """Packed rows as a row per chunk and term, with the ``kept`` columns, ``UNPACKED_ROWS`` at a time."""
    lengths = pc.divide(pc.binary_length(whole.column("ids")), 4).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(lengths) - 1) // UNPACKED_ROWS
    bounds = np.append(_opens(piece), len(piece)).tolist()
    for lo, hi in zip(bounds, bounds[1:]):
        b = whole.slice(lo, hi - lo)
        n = lengths[lo:hi]
        starts = np.concatenate([[0], np.cumsum(_numbers(b.column("sizes"), np.int32))]).astype(np.int32)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(b.column("first").to_numpy(), n) + _numbers(b.column("ids"), np.int32)),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(_numbers(b.column("positions"), np.int32))),
            pa.array(_numbers(b.column("titled"), np.int32)), *(b.column(c).take(at) for c in kept),
        ], names=["id", "positions", "titled", *kept])


def is_packed(index: DataFrame) -> bool:
    return "ids" in index.columns


def unpacked(index: DataFrame) -> DataFrame:
    """``(id, term, positions, titled, bucket)`` of an index, packed or not."""
    if not is_packed(index):
        return index

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _unfolded(whole, "term", "bucket"):
                yield b.select(["id", "term", "positions", "titled", "bucket"])

    ship(index.sparkSession)
    return index.mapInArrow(unpack, f"{POSTINGS}, bucket int")


def stored_index(chunks: DataFrame, title: str = "doc_title", content: str = "content", params: Params = Params()) -> DataFrame:
    """The index: ``packed_postings`` stored by bucket of terms.

    A task writes its part of every bucket where the chunks lie, so nothing is
    shuffled and a term that every chunk holds is no hot key.
    """
    return written(packed_postings(chunks, title, content, params).drop("block"), "index", "bucket")


def stored_postings(chunks: DataFrame, title: str = "doc_title", content: str = "content", params: Params = Params()) -> DataFrame:
    """``postings`` as the stored index holds them."""
    return unpacked(stored_index(chunks, title, content, params))


def flat_postings(index: DataFrame) -> DataFrame:
    """``(id, term, pos, weight)``."""
    return unpacked(index).select("id", "term", "titled", F.posexplode("positions").alias("_i", "pos")).select(
        "id", "term", "pos", F.when(F.col("_i") < F.col("titled"), "A").otherwise("B").alias("weight"))


def term_counts(index: DataFrame) -> DataFrame:
    """``(term, df)``: how many chunks hold each term."""
    n = F.sum(F.shiftright(F.octet_length("ids"), 2).cast("long")) if is_packed(index) else F.count(F.lit(1))
    return index.groupBy("term").agg(n.alias("df"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """Read web-style queries into terms.

    Plain words are ANDed; a quoted phrase wants adjacent positions; the word
    ``or`` starts an alternative group; a leading ``-`` excludes. Output, one row
    per term: ``query_id, grp, piece, negated, phrase, off, term`` where ``off``
    is the place inside the piece, stop words counted.
    """
    piece = F.col("_piece")
    pieces = F.regexp_extract_all(F.col(text), F.lit(r'(-?"[^"]*"?|[^\s\x{00A0}"]+)'), F.lit(1))
    in_order = Window.partitionBy("query_id").orderBy("piece")
    bare = F.regexp_replace(piece, r'\A-|"', "")
    found = (
        queries.select("query_id", F.posexplode(pieces).alias("piece", "_piece"))
        .withColumn("_or", F.lower(piece) == "or")
        .withColumn("grp", F.count_if("_or").over(in_order).cast("int"))
        .filter(~F.col("_or"))
        .select(
            "query_id", "grp", "piece",
            (piece.startswith("-") & (F.length(bare) > 0)).alias("negated"),
            F.regexp_like(piece, F.lit('\\A-?"')).alias("phrase"),
            F.posexplode(F.filter(F.split(F.lower(bare), NOT_WORD), lambda w: w != "")).alias("off", "_word"),
        )
        .filter(~is_stop_word(F.col("_word")))
    )
    return found.withColumn("term", stem(F.col("_word"))).drop("_word")


# --- matching ---------------------------------------------------------------

TERM_BYTES = 40  # what a query term takes in a plan, about


def pass_rows(params: Params) -> int:
    """How many query terms are looked up at once: ``pass_terms``, and more while their plan fits into ``broadcast_bytes``.

    A pass reads the postings of all terms it wants, and most of the common ones are wanted by any.
    """
    return max(params.pass_terms, params.broadcast_bytes // TERM_BYTES)


def _passes(terms: DataFrame, n: int, params: Params) -> Iterator[DataFrame]:
    """The terms of as many queries at a time as may be sent."""
    parts = max(1, math.ceil(n / pass_rows(params)))
    for part in range(parts):
        yield terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> Lists:
    """``n`` lists of ``values``, whose lists ``of`` names in rising order."""
    return Lists(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64), values.astype(np.int64))


def _plan(terms: DataFrame, counts: DataFrame, params: Params) -> tuple[Plan, DataFrame, DataFrame] | None:
    """What the queries of a pass ask for: the plan, its codes ``(term, bucket, code)`` and its
    groups ``(_g, query_id, grp)``. Groups with a term that no chunk holds are left out, and
    groups of exclusions alone.

    The terms of a pass are a bounded set; here they come to the driver, as columns.
    """
    spark = terms.sparkSession
    held = counts.join(F.broadcast(terms.select("term").distinct()), "term").select("term", "df").toArrow().sort_by("term")
    asked = terms.select("query_id", "grp", "piece", "negated", "phrase", "off", "term").toArrow()
    if not len(held) or not len(asked):
        return None
    named, df = held["term"].combine_chunks(), held["df"].to_numpy()
    code = pc.fill_null(pc.index_in(asked["term"], named), -1).to_numpy().astype(np.int64)
    names = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, grp, piece, off = names.indices.to_numpy().astype(np.int64), *(asked[c].to_numpy().astype(np.int64) for c in ("grp", "piece", "off"))
    negated, phrase = (np.array(asked[c].combine_chunks().to_numpy(zero_copy_only=False), bool) for c in ("negated", "phrase"))
    order = np.lexsort((off, piece, grp, query))
    query, grp, piece, off, code, negated, phrase = (x[order] for x in (query, grp, piece, off, code, negated, phrase))
    first = _opens(query, grp)  # of a group
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(query))))
    wants = np.bincount(group, ~negated, len(first)) > 0
    good = wants & (np.bincount(group, ~negated & (code < 0), len(first)) == 0)
    if not good.any():
        return None
    number = np.cumsum(good) - 1
    n = int(good.sum())
    # each wanted term of a group once; the rarest comes first where they are sorted by count
    mine = good[group] & ~negated
    pair = np.unique(number[group[mine]] * len(df) + code[mine])
    of, needed = pair // len(df), pair % len(df)
    by_df = np.lexsort((needed, df[needed], of))
    rare = needed[by_df][_opens(of)]
    by_rare = np.argsort(rare, kind="stable")
    # pieces, those that are more than one of the terms; a piece with an unknown part is in no chunk
    opens = _opens(query, grp, piece)
    size = np.diff(np.append(opens, len(query)))
    whole = np.bincount(np.repeat(np.arange(len(opens)), size), code < 0, len(opens)) == 0
    plain = ~negated[opens] & (~phrase[opens] | (size == 1))
    kept = good[group[opens]] & ~plain & whole
    in_kept = np.repeat(kept, size)
    home = number[group[opens[kept]]]
    asks, query_of = np.unique(query[first[good]], return_inverse=True)
    plan = Plan(len(df), query_of, _lists(of, needed, n), _lists(rare[by_rare], by_rare, len(df)), _lists(home, np.arange(len(home)), n),
                _lists(np.repeat(np.arange(len(home)), size[kept]), code[in_kept], len(home)), off[in_kept], negated[opens[kept]], phrase[opens[kept]])
    used = pa.array(np.unique(np.concatenate([needed, code[in_kept]])))
    codes = spark.createDataFrame(pa.table({"term": named.take(used), "code": used.cast(pa.int32())}))
    groups = spark.createDataFrame(pa.table({
        "_g": pa.array(np.arange(n)), "_q": pa.array(query_of.astype(np.int64)), "query_id": names.dictionary.take(pa.array(asks[query_of])),
        "grp": pa.array(grp[first[good]].astype(np.int32))}))
    return plan, codes.withColumn("bucket", bucket_of("term", params)), groups


def _wanted(index: DataFrame, codes: DataFrame) -> DataFrame:
    """The postings of the wanted terms, read once, packed if the index is; only their buckets are opened."""
    # said as a condition, it makes the optimizer prune buckets by the terms
    kept = ["first", "ids", "sizes"] if is_packed(index) else ["id"]
    return index.join(F.broadcast(codes.filter("code >= 0")), ["bucket", "term"]).select(*kept, "code", "positions", "titled")


SLAB_IDS = 256  # chunks that are answered at once, at most
PACKED_ROWS = 1 << 19  # postings that are packed at once
SLABS = "slab long, id binary, code binary, titled binary, sizes binary, positions binary"


def _by_chunk(index: DataFrame, plan: Plan, codes: DataFrame, answer, kind: str) -> DataFrame:
    """``answer(postings)`` for the wanted postings of whole chunks, some chunks at a time.

    Postings are dealt out by slabs of chunks once, however many queries want them;
    on the way there, the postings of a slab that a task has read are one row.
    """
    spark = index.sparkSession
    ship(spark)
    sent, folded = spark.sparkContext.broadcast(plan), is_packed(index)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in (some for whole in batches for some in (_unfolded(whole, "code") if folded else [whole])):
            held.append(b)
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        slab = rows["id"].to_numpy() // SLAB_IDS
        order = np.argsort(slab, kind="stable")
        slab, rows = slab[order], rows.take(pa.array(order)).combine_chunks()
        lists = rows["positions"].chunk(0)
        opens = _opens(slab)
        ends = np.append(opens, len(slab))
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        return pa.RecordBatch.from_arrays([
            pa.array(slab[opens]), *(_blobs(rows[c].to_numpy(), ends) for c in ("id", "code", "titled")),
            _blobs(np.diff(starts).astype(np.int32), ends), _blobs(lists.flatten().to_numpy(), starts[ends]),
        ], names=["slab", "id", "code", "titled", "sizes", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            bounds = np.append(_opens(b.column("slab").to_numpy()), b.num_rows).tolist()
            for lo, hi in zip(bounds, bounds[1:]):
                if held and held[0].column("slab")[0] != b.column("slab")[lo]:
                    yield from answered(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from answered(held)
        yield from answer(None, sent.value)

    def answered(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        ids, code, titled, sizes, positions = (
            _numbers(rows[c], kind) for c, kind in (("id", np.int64), ("code", np.int32), ("titled", np.int32), ("sizes", np.int32), ("positions", np.int32)))
        order = np.lexsort((code, ids))
        n = sizes[order].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[order]
        places = positions[np.repeat(begin - starts[:-1], n) + np.arange(starts[-1])].astype(np.int64)
        found = Postings(sent.value, ids[order], code[order].astype(np.int64), starts, places, titled[order].astype(np.int64))
        yield from answer(found, sent.value)

    dealt = _wanted(index, codes).mapInArrow(pack, SLABS).repartition("slab").sortWithinPartitions("slab")
    return dealt.mapInArrow(run, kind)


def match_terms(terms: DataFrame, index: DataFrame, counts: DataFrame, params: Params = Params()) -> DataFrame:
    """``(query_id, grp, id, occurrences, part)`` for every chunk that a group of terms matches.

    ``part`` is the cover density of the group in the chunk. Candidates come from
    the rarest term of each group; all else that a group asks is looked up in the
    postings of the same chunk.
    """

    def answer(found: Postings | None, plan: Plan) -> Iterator[pa.RecordBatch]:
        if found is None:
            return
        chunk, group = found.matches()
        yield pa.RecordBatch.from_arrays(
            [pa.array(group), pa.array(found.ids[chunk]), pa.array(found.occurrences(chunk, group)), pa.array(found.scores(chunk, group))],
            names=["_g", "id", "occurrences", "part"])

    def one(plan, codes, groups):
        made = _by_chunk(index, plan, codes, answer, "_g long, id long, occurrences long, part double")
        return made.join(F.broadcast(groups), "_g").select("query_id", "grp", "id", "occurrences", "part")

    return _over_passes(terms, counts, params, one, "grp int, id long, occurrences long, part double")


def _over_passes(terms: DataFrame, counts: DataFrame, params: Params, one, kind: str) -> DataFrame:
    terms, n = settled(terms)
    found = [one(*planned) for some in _passes(terms, n, params) if (planned := _plan(some, counts, params))]
    if len(found) > 1:
        found = [written(f, "pass") for f in found]
    if not found:
        return terms.sparkSession.createDataFrame([], f"query_id {terms.schema['query_id'].dataType.simpleString()}, {kind}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cover_rank(matches: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: the cover densities of a query's alternatives add up."""
    return matches.groupBy("query_id", "id").agg(F.round(F.sum("part"), SCORE_PLACES).alias("score"))


def sparse_topk(ranks: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rnk)``, best first, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranks.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


MOST_WAITING = 256  # offers


class _Top:
    """The k best (score, id) of each query so far; ties fall to the id.

    Offers wait until they are as many as what is held, so that a large set of
    queries is not sorted anew for each; ``least`` may lag behind.
    """

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.full(n_queries, -np.inf)
        self.q, self.s, self.i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        self.waiting.append((q, s, i))
        if sum(len(w[0]) for w in self.waiting) >= len(self.q) or len(self.waiting) >= MOST_WAITING:
            self.settle()

    def settle(self) -> None:
        q, s, i = (np.concatenate(p) for p in zip((self.q, self.s, self.i), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.s, self.i = q[place < self.k], s[place < self.k], i[place < self.k]
        full = place == self.k - 1
        self.least[q[full]] = s[full]


def ranked_terms(terms: DataFrame, index: DataFrame, counts: DataFrame, k: int, params: Params = Params()) -> DataFrame:
    """What ``sparse_topk(cover_rank(match_terms(...)), k)`` gives, without making all matches.

    All alternatives of a query meet a chunk in one task, so a task knows whole
    scores: it keeps k rows a query, and works out covers only where the ceiling
    of a score can still reach them.
    """

    def one(plan, codes, groups):
        names = groups.select("_q", "query_id").distinct()
        made = _by_chunk(index, plan, codes, _best(k), "_q long, id long, score double")
        return sparse_topk(made.join(F.broadcast(names), "_q").select("query_id", "id", "score"), k)

    return _over_passes(terms, counts, params, one, "id long, score double, rnk int")


def _best(k: int):
    def answer(found: Postings | None, plan: Plan) -> Iterator[pa.RecordBatch]:
        nonlocal top
        top = top or _Top(int(plan.query.max()) + 1, k)
        if found is None:
            done, top = top, None
            done.settle()
            yield pa.RecordBatch.from_arrays([pa.array(done.q), pa.array(done.i), pa.array(done.s)], names=["_q", "id", "score"])
            return
        chunk, group = found.matches()
        if not len(chunk):
            return
        pair, of = np.unique(plan.query[group] * len(found.ids) + chunk, return_inverse=True)
        query, where = pair // len(found.ids), pair % len(found.ids)
        ceiling = np.bincount(of, found.ceilings(chunk, group), len(pair))
        # rounding moves a score by less than the slack
        open_ = ceiling + 10.0 ** (1 - SCORE_PLACES) >= top.least[query]
        some = open_[of]
        score = np.bincount(of[some], found.scores(chunk[some], group[some]), len(pair))
        score = np.round(score, SCORE_PLACES)
        good = open_ & (score >= top.least[query])
        top.offer(query[good], score[good], found.ids[where[good]])

    top: _Top | None = None
    return answer
