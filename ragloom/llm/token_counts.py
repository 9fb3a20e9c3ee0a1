"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

The leaves of a document's tree are runs of pre-tokens with their lengths in
code points and their numbers of ids; the nodes above hold sums of both. An edit
descends by lengths to the pre-tokens it touches, takes those before whose rule
could look at the edit, re-encodes from there until a new boundary falls on an
old one behind the edit, and updates the sums above the leaf.

Strings of added tokens are ordinary text here. Null texts count as empty and have no pre-tokens. Edits are applied in order of
``seq`` (then start, length, replacement), each to the text the last one left;
ranges are clipped to the text, a null length counts as 0, a null replacement as
empty, and an edit with a null start is skipped. Each row with an id gets all
edits of the id; rows with a null id get none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import table, utf8
from ragloom.llm.packing import byte_bpe
from ragloom.llm.registry import query
from ragloom.llm.wordids import BatchEncoder, byte_letters


@dataclass(frozen=True)
class CountParams:
    leaf: int = 24  # pre-tokens in a leaf when built; it is split beyond four times as many
    look: int = 2  # code points behind its end that may decide where a pre-token ends
    cache_words: int = 100_000  # words around edits that a worker remembers
    cache_bytes: int = 64 << 20  # pieces of whole texts that a worker remembers


RUNS = ("  ", " \n", "\n ", "\n\n", "\0")
ODD = re.compile(r"[^\S \n]")


def plain_words(text: str) -> list[str] | None:
    """A text cut where the byte-level pre-tokenizer always cuts, or None if white space is not so plain.

    A single space between two characters that are no white space always starts
    a new piece, and a single line feed there is a piece of its own. A space before
    the first word belongs to it.
    """
    if text[0] == " " and len(text) > 1:
        words = plain_words(text[1:])
        return words and [" " + words[0], *words[1:]]
    if text[0].isspace() or text[-1].isspace() or any(r in text for r in RUNS):
        return None
    if not text.replace("\n", "").isprintable() and ODD.search(text):
        return None
    return text.replace("\n", " \n").replace(" ", "\0 ").replace(" \n", "\n\0").split("\0")


class BatchCounter(BatchEncoder):
    """(length, number of ids) of the pre-tokens of the texts of a batch; strings of added tokens are ordinary text."""

    def __init__(self, path: str, cache_bytes: int):
        super().__init__(path, cache_bytes)
        self.added, self.split = [], self.tokenizer.pre_tokenizer.pre_tokenize_str

    def of_pieces(self, made: list[bytes]) -> list[bytes]:
        sizes = (len(self.model.tokenize(piece.decode("latin-1").translate(self.letters))) for piece in made)
        return [array("I", (len(piece.decode()), n)).tobytes() for piece, n in zip(made, sizes)]

    def of_text(self, text: str) -> bytes:
        pairs = array("I")
        for piece, (start, end) in self.split(text):
            pairs.extend((end - start, len(self.model.tokenize(piece))))
        return pairs.tobytes()


@lru_cache(2)
def batch_counter(path: str, cache_bytes: int) -> BatchCounter:
    return BatchCounter(path, cache_bytes)


class Pieces(dict):
    """(length, number of ids) of the pre-tokens of words, as 32-bit pairs, found when first asked for."""

    def __init__(self, path: str, limit: int, batches: BatchCounter | None = None):
        super().__init__()
        from tokenizers import Tokenizer

        self.of_batches = {} if batches is None else batches.known
        tokenizer = Tokenizer.from_file(path)
        self.split, self.model, self.limit = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model, limit
        self.letters = byte_letters()
        self.counts: dict[str, int] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        if word[-1:] in (".", ",") and word[-2:-1].isalnum():  # a mark behind a letter or digit is a piece of its own
            made = self[word[:-1]] + self[word[-1]]
        elif (known := self.of_batches.get(word.encode())) is not None:  # a piece of a whole text
            made = known
        elif (word[1:] if word[0] == " " else word).isalpha():  # one piece
            made = array("I", (len(word), self.ids(word.encode().decode("latin-1").translate(self.letters)))).tobytes()
        else:
            made = self.whole(word)
        self[word] = made
        return made

    def ids(self, piece: str) -> int:
        """The number of ids of a pre-token in the characters of the vocabulary."""
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) > self.limit:
                self.counts.clear()
            n = self.counts[piece] = len(self.model.tokenize(piece))
        return n

    def whole(self, text: str) -> bytes:
        pairs = array("I")
        for piece, (start, end) in self.split(text):
            pairs.extend((end - start, self.ids(piece)))
        return pairs.tobytes()


class Counter:
    """Pre-tokens of a text and the number of ids of each."""

    def __init__(self, path: str, cache_words: int, batches: BatchCounter | None = None):
        self.known = Pieces(path, cache_words, batches)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths in code points and numbers of ids."""
        words = plain_words(text) if text else []
        made = self.known.whole(text) if words is None else b"".join(map(self.known.__getitem__, words))
        pairs = np.frombuffer(made, np.uint32).astype(np.int64)
        return pairs[::2], pairs[1::2]


@lru_cache(2)
def counter_of(path: str, params: CountParams) -> Counter:
    """The counter of a worker process, which keeps what it knows from task to task."""
    return Counter(path, params.cache_words, batch_counter(path, params.cache_bytes))


class Sums:
    """A segment tree of sums: update a leaf, find the leaf that holds a position."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        level = np.zeros(self.size, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        self.node = [0, *np.concatenate(levels[::-1]).tolist()]

    def total(self) -> int:
        return self.node[1]

    def put(self, leaf: int, value: int) -> None:
        at = leaf + self.size
        more = value - self.node[at]
        while at:
            self.node[at] += more
            at >>= 1

    def find(self, position: int) -> tuple[int, int]:
        """The leaf of a position below the total, and the sum of the leaves before it."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if position - before >= self.node[at]:
                before += self.node[at]
                at += 1
        return at - self.size, before


Leaf = tuple[str, np.ndarray, np.ndarray]  # text, lengths, numbers of ids


class Tree:
    """A document's leaves are numbers of untouched runs of its pre-tokens, or what edits left of them."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, params: CountParams):
        self.params, self.whole = params, (text, lengths, counts)
        self.starts = np.append(np.arange(0, max(1, len(lengths)), params.leaf), len(lengths))
        self.places = np.concatenate([[0], np.cumsum(lengths)])[self.starts]  # code points before each leaf
        self.leaves: list[int | Leaf] = list(range(len(self.starts) - 1))
        self.encoded = 0  # pre-tokens encoded by edits
        self.sum()

    def run(self, first: int, last: int) -> Leaf:
        """Untouched leaves from ``first`` to before ``last``."""
        text, lengths, counts = self.whole
        cut = slice(self.starts[first], self.starts[last])
        return text[self.places[first] : self.places[last]], lengths[cut], counts[cut]

    def leaf(self, i: int) -> Leaf:
        leaf = self.leaves[i]
        return self.run(leaf, leaf + 1) if isinstance(leaf, int) else leaf

    def cut(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> list[Leaf]:
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return [
            (text[ends[a] : ends[min(a + self.params.leaf, len(lengths))]], lengths[a : a + self.params.leaf], counts[a : a + self.params.leaf])
            for a in range(0, max(1, len(lengths)), self.params.leaf)
        ]

    def sum(self) -> None:
        tokens = np.diff(np.concatenate([[0], np.cumsum(self.whole[2])])[self.starts])
        chars = np.diff(self.places)
        self.chars = Sums(np.array([chars[x] if isinstance(x, int) else len(x[0]) for x in self.leaves], np.int64))
        self.tokens = Sums(np.array([tokens[x] if isinstance(x, int) else x[2].sum() for x in self.leaves], np.int64))

    def edit(self, start: int, length: int, new: str, counter: Counter) -> None:
        total = self.chars.total()
        start = min(max(start, 0), total)
        stop = min(start + max(length, 0), total)
        # the first pre-token whose end lies within sight of the edit
        sight = max(0, start - self.params.look)
        i, before = self.chars.find(max(0, min(sight, total) - 1)) if total else (0, 0)
        head = self.leaf(i)
        ends = before + np.cumsum(head[1])
        j = int(np.searchsorted(ends, sight))
        from_ = int(ends[j] - head[1][j]) if j < len(ends) else before + len(head[0])
        k = max(i, self.chars.find(min(stop, total - 1))[0] if total else 0)
        shift = len(new) - (stop - start)
        while True:
            last = k + 1 == len(self.leaves)
            more = [self.leaf(x) for x in range(i + 1, k + 1)]
            old = head[0][from_ - before :] + "".join(x[0] for x in more)
            text = old[: start - from_] + new + old[stop - from_ :]
            lengths, counts = counter(text)
            self.encoded += len(lengths)
            made = np.cumsum(lengths)
            kept = np.concatenate([head[1][j:], *[x[1] for x in more]])
            was = from_ + np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
            # boundaries behind the edit that both have and that nothing unseen could move
            fit = made[(made >= start - from_ + len(new)) & (made <= (len(text) if last else len(text) - self.params.look - 1))]
            back = fit + from_ - shift  # where they were; ``was`` is sorted
            fit = fit[was[np.minimum(np.searchsorted(was, back), len(was) - 1)] == back]
            if len(fit) or last:
                break
            k = min(len(self.leaves) - 1, k + max(1, k - i))
        sync = int(fit[0]) if len(fit) else len(text)
        n_new = int(np.searchsorted(made, sync, side="right"))
        n_old = int(np.searchsorted(was[1:], sync + from_ - shift, side="right"))
        all_counts = np.concatenate([head[2][j:], *[x[2] for x in more]])
        leaf = (
            head[0][: from_ - before] + text,
            np.concatenate([head[1][:j], lengths[:n_new], kept[n_old:]]).astype(np.int64),
            np.concatenate([head[2][:j], counts[:n_new], all_counts[n_old:]]).astype(np.int64),
        )
        if i == k and len(leaf[1]) <= 4 * self.params.leaf:
            self.leaves[i] = leaf
            self.chars.put(i, len(leaf[0]))
            self.tokens.put(i, int(leaf[2].sum()))
        else:
            self.leaves[i : k + 1] = self.cut(*leaf)
            self.sum()

    def parts(self) -> Leaf:
        """Text, lengths and numbers of ids; neighbouring untouched leaves are taken in one piece."""
        out: list[Leaf] = []
        i = 0
        while i < len(self.leaves):
            first, j = self.leaves[i], i + 1
            if isinstance(first, int):
                while j < len(self.leaves) and isinstance(self.leaves[j], int):
                    j += 1
                out.append(self.run(first, first + j - i))
            else:
                out.append(first)
            i = j
        return "".join(x[0] for x in out), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])


TREE = "text string, lengths binary, counts binary, n_pretokens long, n_tokens long"


def build(docs: DataFrame, tokenizer: str, params: CountParams = CountParams(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The tree of every document: its text, the lengths and numbers of ids of its pre-tokens
    (little-endian unsigned 32-bit, in order), their number and the number of ids.
    Columns named in ``keep`` come along."""
    rows = docs.select(docs[id_col].alias("id"), *[docs[c].alias(f"kept_{c}") for c in keep], utf8(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = batch_counter(tokenizer, params.cache_bytes)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            texts = [raw.decode("utf-8", "replace") for raw in batch.column("text").to_pylist()]
            for lo, hi, pairs, per_text in counter(pa.array([t.encode() for t in texts], pa.binary())):
                lengths, counts, ends = pairs[::2].astype("<u4"), pairs[1::2].astype("<u4"), np.cumsum(per_text) // 2
                for text, a, b in zip(texts[lo:hi], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    for col, value in zip(out, (text, lengths[a:b].tobytes(), counts[a:b].tobytes(), b - a, int(counts[a:b].sum())), strict=True):
                        col.append(value)
            types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=schema.names,
            )

    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(TREE).fields])
    made = rows.mapInArrow(run, schema)
    return made.withColumnsRenamed({"id": id_col} | {f"kept_{c}": c for c in keep})


EDIT = "struct<seq:long,start:long,length:long,replacement:string>"


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` with the array ``edits`` of the edits (id, seq, start, length, replacement) of each id."""
    edit = F.struct(*[edits[c].cast(t).alias(c) for c, t in (("seq", "long"), ("start", "long"), ("length", "long"), ("replacement", "string"))])
    grouped = edits.select(edits[id_col].alias("_id"), edit.alias("edit")).groupBy("_id").agg(F.collect_list("edit").alias("edits"))
    return trees.join(grouped, trees[id_col] == F.col("_id"), "left").drop("_id")


def edited(trees: DataFrame, tokenizer: str, params: CountParams = CountParams(), id_col: str = "doc_id") -> DataFrame:
    """The trees after their ``edits``: the columns of a tree, the number of ids before, and the
    number of pre-tokens that were encoded again."""
    rows = trees.select(trees[id_col].alias("id"), "text", "lengths", "counts", F.col("edits").cast(f"array<{EDIT}>").alias("edits"), F.col("n_tokens").alias("tokens_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer, params)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("text", "lengths", "counts", "edits")]
            made = [after_edits(t, *(np.frombuffer(x, "<u4").astype(np.int64) for x in (n, c)), e, counter, params) for t, n, c, e in zip(*cols, strict=True)]
            yield _edited_batch(batch.column("id"), batch.column("tokens_before"), made)

    return rows.mapInArrow(run, _edited_schema(rows.schema["id"].dataType)).withColumnRenamed("id", id_col)


def after_edits(text: str, lengths: np.ndarray, counts: np.ndarray, edits: list[dict] | None, counter: Counter, params: CountParams) -> tuple:
    """Text, lengths, numbers of ids, their sizes and the number of pre-tokens encoded again."""
    tree = Tree(text, lengths, counts, params)
    order = sorted((e for e in edits or [] if e is not None and e["start"] is not None),
                   key=lambda e: (e["seq"] is None, e["seq"] or 0, e["start"], e["length"] or 0, e["replacement"] or ""))
    for e in order:
        tree.edit(e["start"], e["length"] or 0, e["replacement"] or "", counter)
    text, lengths, counts = tree.parts()
    return text, lengths.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), len(lengths), tree.tokens.total(), tree.encoded


def _edited_batch(ids: pa.Array, before: pa.Array, made: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    cols = zip(*made, strict=True) if made else [()] * len(types)
    names = ["id", "tokens_before", *(c.split()[0] for c in EDITED.split(", "))]
    return pa.RecordBatch.from_arrays([ids, before, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


EDITED = TREE + ", n_encoded long"


def _edited_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", kind), T.StructField("tokens_before", T.LongType()), *T.StructType.fromDDL(EDITED).fields])


def edited_texts(docs: DataFrame, tokenizer: str, params: CountParams = CountParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited(build(docs))`` in one pass, for documents that come with their ``edits``: no tree is
    handed on, and edits find the pieces of whole texts remembered."""
    rows = docs.select(docs[id_col].alias("id"), F.col("edits").cast(f"array<{EDIT}>").alias("edits"), utf8(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_pieces, counter = batch_counter(tokenizer, params.cache_bytes), counter_of(tokenizer, params)
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in batch.column("text").to_pylist()]
            edits, made, before = batch.column("edits").to_pylist(), [], []
            for lo, hi, pairs, per_text in batch_pieces(pa.array([t.encode() for t in texts], pa.binary())):
                lengths, counts, ends = pairs[::2].astype(np.int64), pairs[1::2].astype(np.int64), np.cumsum(per_text) // 2
                for i, a, b in zip(range(lo, hi), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    before.append(int(counts[a:b].sum()))
                    made.append(after_edits(texts[i], lengths[a:b], counts[a:b], edits[i], counter, params))
            yield _edited_batch(batch.column("id"), pa.array(before, pa.int64()), made)

    return rows.mapInArrow(run, _edited_schema(rows.schema["id"].dataType)).withColumnRenamed("id", id_col)


@query()
def op9_token_counts(spark, sf_dir):
    """Token counts of every document before and after four edits that its id and text give."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)

    def edit(seq: int, length: int, replacement):
        start = F.pmod(F.xxhash64("doc_id", F.lit(seq)), n + 1)
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), F.lit(length).cast("long").alias("length"), replacement.alias("replacement"))

    edits = F.array(
        edit(0, 12, F.lit("")), edit(1, 0, F.concat(F.lit(" "), F.substring(text, 1, 40), F.lit("'s\n\n  "))),
        edit(2, 25, F.upper(F.substring(text, 10, 30))), edit(3, 1, F.lit("re 42")),
    )
    return edited_texts(docs.withColumn("edits", edits), byte_bpe()).select(
        "doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "n_pretokens", "n_encoded", F.length("text").cast("long").alias("n_chars")
    )
