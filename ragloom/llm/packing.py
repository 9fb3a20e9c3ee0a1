"""Packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents become token ids and an end id and are dealt at random to tasks. A
task reads its share in a fixed order and closes a group whenever it holds
``group_tokens``. A group's documents fill whole sequences as far as they go;
what remains of each is placed, longest first, into the first sequence with
room, which a tournament tree of free places finds. Then the emptiest sequences
are dissolved to fill the gaps of the others, so one sequence of a group at most
is not full; it is carried to the next group of the task, and the last one is cut
into lengths that are powers of two.

Ids are those of the tokenizers library without special tokens added; the string of an added
token in a text is that token, as the library reads it. Null and empty texts are the end id alone. Each row is a document of its own,
repeated rows and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import table, tidied, utf8
from ragloom.llm.registry import query
from ragloom.llm.wordids import batch_encoder, with_end


@dataclass(frozen=True)
class PackingParams:
    length: int = 1024  # places in a sequence, a power of two
    group_tokens: int = 4 << 20  # documents packed together
    end_id: int = 0
    cache_bytes: int = 96 << 20  # pieces of texts whose ids a worker remembers


class Rooms:
    """A tournament tree over the free places of bins: the first bin with enough of them."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.size)

    def take(self, need: int) -> int:
        best, at = self.best, 1
        while at < self.size:
            at = 2 * at if best[2 * at] >= need else 2 * at + 1
        best[at] -= need
        place, at = at - self.size, at >> 1
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at >>= 1
        return place


Piece = tuple[int, int, int]  # document, first id, number of ids


def packed(sizes: list[int], length: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of pieces, and the pieces of the one that is not full."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, size in enumerate(sizes):
        whole = size // length
        full += [[(doc, k * length, length)] for k in range(whole)]
        if size % length:
            rest.append((doc, whole * length, size % length))
    rest.sort(key=lambda p: (-p[2], p[0]))
    rooms, bins = Rooms(max(1, len(rest)), length), []
    for piece in rest:
        place = rooms.take(piece[2])
        while place >= len(bins):
            bins.append([])
        bins[place].append(piece)
    held = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-held[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        b, donor = order[lo], order[hi]
        gap = length - held[b]
        if not gap:
            full.append(bins[b])
            lo += 1
            continue
        doc, start, n = bins[donor].pop()
        cut = min(gap, n)
        bins[b].append((doc, start, cut))
        if cut < n:
            bins[donor].append((doc, start + cut, n - cut))
        held[b] += cut
        held[donor] -= cut
        if not held[donor]:
            hi -= 1
    tail = bins[order[lo]] if bins else []
    if tail and held[order[lo]] == length:
        full.append(tail)
        tail = []
    return full, tail


def powers(pieces: list[Piece], sizes: int) -> list[list[Piece]]:
    """The pieces of one sequence cut into sequences whose lengths are powers of two."""
    out: list[list[Piece]] = []
    left = list(reversed(pieces))
    for bit in reversed(range(sizes.bit_length())):
        room = sizes & (1 << bit)
        if room:
            out.append([])
        while room:
            doc, start, n = left.pop()
            cut = min(room, n)
            out[-1].append((doc, start, cut))
            if cut < n:
                left.append((doc, start + cut, n - cut))
            room -= cut
    return out


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, params: PackingParams = PackingParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: their ids (little-endian unsigned 32-bit) and place.

    One shuffle deals the texts out by a number of the row, so that neither a
    repeated id nor a sorted input gathers in a task.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), utf8(docs[text_col]).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartition(F.xxhash64("row")).sortWithinPartitions("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer, params.cache_bytes)
        base, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[object, int, int, bytes]] = []  # id, ids before, ids of the document, ids
        tokens = 0

        def out(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lo in range(0, len(sequences), 4096):
                cols: list[list] = [[] for _ in range(7)]
                for sequence in sequences[lo : lo + 4096]:
                    offset = 0
                    for doc, start, n in sequence:
                        name, before, total, ids = held[doc]
                        for col, value in zip(cols, (name, before + start, n, ids[4 * start : 4 * (start + n)], total, base + made, offset), strict=True):
                            col.append(value)
                        offset += n
                    made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], id_arrow), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols[1:]))],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            names = batch.column("id").to_pylist()
            for lo, hi, found, per_text in encode(batch.column("text")):
                found, per_text = with_end(found, per_text, params.end_id)
                raw, ends = found.astype("<u4").tobytes(), np.cumsum(per_text)
                for name, a, b in zip(names[lo:hi], (ends - per_text).tolist(), ends.tolist(), strict=True):
                    held.append((name, 0, b - a, raw[4 * a : 4 * b]))
                    tokens += b - a
                    if tokens >= params.group_tokens:
                        full, tail = packed([len(h[3]) // 4 for h in held], params.length)
                        yield from out(full)
                        held = [(held[d][0], held[d][1] + s, held[d][2], held[d][3][4 * s : 4 * (s + n)]) for d, s, n in tail]
                        tokens = sum(p[2] for p in tail)
        full, tail = packed([len(h[3]) // 4 for h in held], params.length)
        yield from out(full + powers(tail, sum(p[2] for p in tail)))

    return dealt.select("id", "text").mapInArrow(tidied(run, (batch_encoder,)), f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def byte_bpe() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op8_packing(spark, sf_dir):
    """All documents cut and packed into sequences of 1024 ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
