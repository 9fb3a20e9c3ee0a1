"""Files of token ids in Simple-8b: 64-bit words of a 4-bit selector and as many equally wide ids as fit in 60 bits.

A file holds whole documents in ascending order of their ids. All numbers are
little-endian; lengths and document ids are 64 bits wide.

    "RLIDS8B1", range part, number in the part, documents, ids, blocks, ids per block
    document ids; one byte per document, 1 where the id is null
    lengths of the documents, Simple-8b: words, escapes, then both
    per block: place of its first word behind this table, in words; escapes of the blocks before
    words of all blocks; escapes of all blocks
    crc32 of all before (4 bytes), line feed

A block is coded for itself, so any block can be decoded from its place in the
table, and all words of one selector are decoded at once. A value from 2^60 - 1 on
is a word of its own with all 60 bits set, and stands whole among the escapes.

Null and empty texts are the end id alone. Rows that repeat an id are documents of
their own, in the order of the rows; null ids come last. Document ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import table, tidied, utf8
from ragloom.llm.registry import query
from ragloom.llm.wordids import batch_encoder, with_end
from ragloom.operators.chunking import in_order
from ragloom.session import scratch_path, written


@dataclass(frozen=True)
class IdFileParams:
    end_id: int = 1
    block_ids: int = 1 << 16  # ids of a block
    file_ids: int = 4 << 20  # a file is closed when it holds so many
    cache_bytes: int = 128 << 20  # words whose ids a worker remembers


# -- the code ----------------------------------------------------------------

#: Values of a word and their width by selector; the first two are runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, *(60 // n for n in COUNTS[2:])])
ESCAPE = np.uint64((1 << 60) - 1)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BITS = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits, and the escaped values in order."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    escaped = values >= ESCAPE
    values, escapes = (np.where(escaped, ESCAPE, values), values[escaped]) if escaped.any() else (values, values[:0])
    bits = _BITS[values] if n and values.max() < len(_BITS) else np.searchsorted(_POWERS, values, side="right").astype(np.uint8)
    # the selector of the most values that fit, for a word that began at each place; behind the end all is zero
    chosen = np.full(n, 15, np.uint8)
    widest, held = np.concatenate([bits, np.zeros(240, np.uint8)]), 1  # of the ``held`` values from each place on
    for selector in reversed(range(15)):
        while held < COUNTS[selector]:
            step = min(held, int(COUNTS[selector]) - held)
            widest = np.maximum(widest[:-step], widest[step:])
            held += step
        fits = widest[:n] <= WIDTHS[selector]
        if not fits.any():
            break  # fewer bits for more values fit nowhere either
        chosen -= fits  # who fits here fitted all before
    steps, begins, at = COUNTS[chosen].tolist(), [], 0
    while at < n:
        begins.append(at)
        at += steps[at]
    begin = np.array(begins, np.int64)
    selectors = chosen[begin]
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors[selectors > 1]).tolist():
        here = np.flatnonzero(selectors == selector)
        first, made = begin[here], words[here]
        for i in range(COUNTS[selector]):
            made |= padded[first + i] << np.uint64(i * WIDTHS[selector])
        words[here] = made
    return words, escapes


def decode(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` values of the words of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[selectors]
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for selector in np.unique(selectors[selectors > 1]).tolist():
        here = np.flatnonzero(selectors == selector)
        first, coded, mask = begin[here], words[here], np.uint64((1 << int(WIDTHS[selector])) - 1)
        for i in range(COUNTS[selector]):
            out[first + i] = (coded >> np.uint64(i * WIDTHS[selector])) & mask
    out = out[:n]
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


# -- files -------------------------------------------------------------------

MAGIC = b"RLIDS8B1"


def file_bytes(part: int, number: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block_ids: int) -> bytes:
    coded = [encode(ids[lo : lo + block_ids]) for lo in range(0, len(ids), block_ids)]
    lengths, odd = encode(sizes)
    n_words, n_escapes = (np.array([len(c[i]) for c in coded], np.int64) for i in (0, 1))
    places = np.stack([np.cumsum(n_words) - n_words, np.cumsum(n_escapes) - n_escapes], 1)
    null = np.array([d is None for d in doc_ids], np.uint8)
    made = b"".join([
        MAGIC, np.array([part, number, len(doc_ids), len(ids), len(coded), block_ids], "<i8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.array([len(lengths), len(odd)], "<i8").tobytes(), lengths.astype("<u8").tobytes(), odd.astype("<u8").tobytes(),
        np.append(places.ravel(), [n_words.sum(), n_escapes.sum()]).astype("<i8").tobytes(),
        *(c[0].astype("<u8").tobytes() for c in coded), *(c[1].astype("<u8").tobytes() for c in coded),
    ])
    return made + zlib.crc32(made).to_bytes(4, "little")


class IdFile:
    """A file's documents and blocks; raises ValueError for bytes that are not whole."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 61 or data[-1:] != b"\n" or zlib.crc32(data[:-5]) != int.from_bytes(data[-5:-1], "little"):
            raise ValueError("not a whole file of ids")
        self.data, at = data, 8

        def take(n: int, kind: str = "<i8") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.part, self.number, docs, self.n_ids, self.n_blocks, self.block_ids = take(6).tolist()
        names = take(docs)
        self.doc_ids = pa.array(names, mask=take(docs, "u1").astype(bool))
        words, odd = take(2).tolist()
        self.sizes = decode(take(words, "<u8"), docs, take(odd, "<u8")).astype(np.int64)
        self.places = take(2 * self.n_blocks + 2).reshape(-1, 2)
        self.words = take(int(self.places[-1, 0]), "<u8")
        self.escapes = take(int(self.places[-1, 1]), "<u8")

    def block(self, i: int) -> np.ndarray:
        """The ids of a block."""
        (word, odd), (word_end, odd_end) = self.places[i], self.places[i + 1]
        n = min(self.block_ids, self.n_ids - i * self.block_ids)
        return decode(self.words[word:word_end], n, self.escapes[odd:odd_end])

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.block(i) for i in range(self.n_blocks))])


# -- tables ------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, tokenizer: str, params: IdFileParams = IdFileParams(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents to files below ``path``, a file per ``file_ids`` or longer document.

    One shuffle deals the texts out by ranges of their ids; the number of the row
    is part of the key, so a repeated id is cut into several ranges.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), utf8(docs[text_col]).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = in_order(rows.withColumn("no_id", F.col("id").isNull()), ["no_id", "id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = batch_encoder(tokenizer, params.cache_bytes), TaskContext.get().partitionId(), 0
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            made = file_bytes(part, number, names, np.concatenate(sizes), np.concatenate(ids), params.block_ids)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["value"])

        for batch in batches:
            known = batch.column("id").to_pylist()
            for lo, hi, found, per_text in encoder(batch.column("text")):
                found, per_text = with_end(found, per_text, params.end_id)
                ends, at = np.concatenate([[0], np.cumsum(per_text)]), 0
                while at < len(per_text):  # documents up to the one that fills the file
                    to = min(len(per_text), int(np.searchsorted(ends, ends[at] + params.file_ids - held)))
                    names += known[lo + at : lo + to]
                    sizes.append(per_text[at:to])
                    ids.append(found[ends[at] : ends[to]])
                    held, at = held + int(ends[to] - ends[at]), to
                    if held >= params.file_ids:
                        yield closed()
                        names, sizes, ids, held, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    made = ordered.select("id", "text").mapInArrow(tidied(run, (batch_encoder,)), "value binary")
    # the text writer copies the bytes and adds a line feed
    made.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


READ = "part long, number long, doc_no long, id long, before long, n_tokens long"


def read_files(spark: SparkSession, path: str, columns: str, of_file) -> DataFrame:
    """What ``of_file`` makes of each file below ``path``: ``READ`` and ``columns``.

    ``of_file`` takes the file, its ids and the places of its documents among
    them, and returns one array per column of ``columns``. A file is read by one task.
    """
    schema = READ + (f", {columns}" if columns else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                file = IdFile(data.as_py())
                n, ends = len(file.sizes), np.cumsum(file.sizes)
                more = of_file(file, file.ids(), np.concatenate([[0], ends]))
                first = [np.full(n, file.part), np.full(n, file.number), np.arange(n)]
                arrays = [*map(pa.array, first), file.doc_ids, pa.array(ends - file.sizes), pa.array(file.sizes), *more]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(tidied(run), schema)


def with_starts(found: DataFrame) -> DataFrame:
    """``start``, the number of ids of all documents before, from one small row per file and then per part."""
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = files.select("part", "number", (F.sum("n").over(in_part) - F.col("n")).alias("_in_part"))
    # one row per range partition, so a few thousand rows at most
    up_to_here = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(up_to_here) - F.col("n")).alias("_parts"))
    placed = found.join(files, ["part", "number"]).join(F.broadcast(parts), "part")
    return placed.withColumn("start", F.col("_parts") + F.col("_in_part") + F.col("before")).drop("_parts", "_in_part")


def checksums(file: IdFile, ids: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """crc32 of the ids of each document as unsigned 32-bit numbers."""
    data, at = ids.astype("<u4").tobytes(), (4 * places).tolist()
    return [pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], pa.int64())]


def documents(file: IdFile, ids: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """The ids themselves."""
    return [pa.LargeListArray.from_arrays(pa.array(places), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))]


def word_bpe() -> str:
    """The tokenizer file of the registered query."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op12_token_ids(spark, sf_dir):
    """Ids of all documents written to files in order and read back."""
    path = scratch_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, word_bpe())
    found = written(read_files(spark, path, "ids_crc32 long", checksums), "ids-read")
    return with_starts(found).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
