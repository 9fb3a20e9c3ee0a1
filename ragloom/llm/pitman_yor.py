"""Language-model scores by a hierarchical Pitman-Yor model over words.

Each context has a restaurant whose customers are the words that follow it and
whose tables are customers of one parent restaurant that all contexts share; the
parent's base is uniform over the known words and one unknown word. The context
of a word is the word before it, hashed into ``contexts`` buckets, so a rare word
shares its restaurant with others. Tables are sampled by Gibbs: the table sizes
of a dish are summed out, so its state is its number of tables, and a customer
that is taken out closes one with the probability that generalised Stirling
numbers give. The probabilities of the samples are averaged.

Words and their followers are counted in one shuffle that keeps what belongs to a
word together; a word with more occurrences than a part may hold is dealt to
several parts by context. A sweep moves the customers of all parts at once,
given the table totals of the last sweep, which are gathered per context: the
usual approximation of parallel Gibbs sampling. Sweeps draw from seeds that
depend on part and sweep alone, so a task that is run again repeats its state
and no state is stored.

Null and empty texts are the end token alone. Repeated rows count, and come out,
as often as they occur; a null id counts as the empty text where rows are dealt
to training and held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import fold_of, mix, table, tidied, tidied_group, utf8
from ragloom.llm.registry import query
from ragloom.llm.shingles import hashed
from ragloom.session import written

#: The hash of the end token, which also stands before the first word.
END = np.uint64(0xE4D0_3A5C_96B1_7F29)


@dataclass(frozen=True)
class PitmanYorParams:
    contexts: int = 1 << 16  # buckets of the word before
    strength: float = 1.0  # of both restaurants
    burn_in: int = 2  # sweeps before the first sample
    samples: int = 3
    moves: int = 4  # customers of a dish that move in a sweep
    chunk_tokens: int = 1_000_000  # counted together before the shuffle
    part_tokens: int = 500_000  # occurrences that a part should hold
    hot_share: float = 0.001  # of a chunk's tokens from which a word may be hot
    send_bytes: int = 1 << 20  # of a chunk's parts that leave a task at once


# -- counting ----------------------------------------------------------------


def chunks(batches, params: PitmanYorParams):
    """(ids, held out, tokens of each text, tokens, contexts, text of each token) a chunk at a time."""
    ids, held, sizes, tokens = [], [], [], []
    total = 0

    def out():
        token, n = np.concatenate(tokens), np.concatenate(sizes)
        before = np.concatenate([[END], token[:-1]])
        context = ((before >> np.uint64(32)) * np.uint64(params.contexts) >> np.uint64(32)).astype(np.uint16)
        return ids, np.array(held, bool), n, token, context, np.repeat(np.arange(len(n), dtype=np.uint32), n)

    for batch in batches:
        ids += batch.column("id").to_pylist()
        held += batch.column("held").to_pylist()
        for _, _, n, word in hashed(batch.column("text"), 1):
            tokens.append(np.insert(word, np.cumsum(n), END))
            sizes.append(n + 1)
            total += len(tokens[-1])
        if total >= params.chunk_tokens:
            made = out()
            ids, held, sizes, tokens, total = [], [], [], [], 0
            yield made
            del made
    if ids:
        yield out()


def hot_words(rows: DataFrame, params: PitmanYorParams) -> tuple[np.ndarray, np.ndarray, int]:
    """Words with more occurrences than half a part, sorted, over how many parts to deal each, and all tokens.

    Every such word has its share in some chunk, or is rare enough for its part.
    There are at most two per part.
    """

    def run(batches):
        for _, _, _, token, _, _ in chunks(batches, params):
            word, n = np.unique(token, return_counts=True)
            often = n >= params.hot_share * len(token)
            words = np.append(word[often].view(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), np.int64), len(token)))], ["word", "n", "total"])

    counted = written(rows.mapInArrow(tidied(run), "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "lm-hot")
    total = counted.agg(F.sum("total")).head()[0] or 0
    got = counted.filter(F.col("n") > params.part_tokens // 2).select("word", "n").toArrow()
    word, n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], -(-2 * n[order] // params.part_tokens), int(total)


PARTS = (
    "part int, words binary, counts binary, ones binary, many_word binary, many_context binary, many_count binary,"
    " pair_word binary, pair_context binary, pair_count binary, pair_length binary, texts binary, keys binary"
)
DOCS = "base long, ids array<{id}>, held array<boolean>, lengths binary"


def count(rows: DataFrame, params: PitmanYorParams) -> tuple[DataFrame, np.ndarray]:
    """The stored parts of the counted corpus and the rows it was counted from, and the hot words.

    A part: words with their training counts and how many of their pairs occur
    once in training; the pairs that occur more often; and every pair with its
    occurrences by text, training or not.
    """
    id_type = dict(rows.dtypes)["id"]
    hot, shares, total = hot_words(rows, params)
    parts = max(1, -(-total // params.part_tokens))
    blob = f"part int, base long, words binary, runs binary, contexts binary, texts binary, ids array<{id_type}>, held array<boolean>, lengths binary"
    out_type = T.StructType(T.StructType.fromDDL(PARTS).fields + T.StructType.fromDDL(DOCS.format(id=id_type)).fields)

    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def request(batches):
        made = 0
        for chunk in chunks(batches, params):
            base = (TaskContext.get().partitionId() << 40) + made
            made += len(chunk[0])
            yield from dealt(base, *chunk[1:])
            ids, held, sizes = chunk[:3]
            last = (parts + TaskContext.get().partitionId() % parts, base, None, None, None, None, ids, held.tolist(), sizes.astype(np.uint32).tobytes())
            yield from sent([[v] for v in last])
            del chunk, ids, held, sizes, last

    def sent(cols: list[list]):
        """Rows of ``blob``; without ids where the last columns are missing."""
        cols = cols + [[None] * len(cols[0])] * (9 - len(cols))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (*types, id_arrow, pa.list_(pa.bool_()), pa.binary()), strict=True)], [f.split()[0] for f in blob.split(", ")]
        )

    def dealt(base: int, held: np.ndarray, _sizes: np.ndarray, token: np.ndarray, context: np.ndarray, text: np.ndarray):
        """The tokens of a chunk as a row per part, some parts at a time."""
        where = token >> np.uint64(32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            own = np.flatnonzero(hot[at] == token)
            at = at[own]
            where[own] = (token[own] + (context[own] % shares[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            del at, own
        part = ((where * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
        del where
        order = np.lexsort((context, token, part))
        cut = np.searchsorted(part, np.arange(parts + 1), sorter=order)
        del part
        packed = (text << np.uint32(1)) | held[text].astype(np.uint32)
        cols: list[list] = [[] for _ in types]
        size = 0
        for p in range(parts):
            own = order[cut[p] : cut[p + 1]]
            if len(own):
                words, runs = np.unique(token[own], return_counts=True)
                row = (p, base, words.tobytes(), runs.astype(np.uint32).tobytes(), context[own].tobytes(), packed[own].tobytes())
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
                size += sum(map(len, row[2:]))
            if size >= params.send_bytes:
                yield from sent(cols)
                cols, size = [[] for _ in types], 0
        if size:
            yield from sent(cols)

    def merge(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() >= parts:
            nothing = [pa.nulls(group.num_rows, f.type) for f in out_arrow if f.name not in ("base", "ids", "held", "lengths")]
            return pa.table([*nothing, *(group.column(c) for c in ("base", "ids", "held", "lengths"))], schema=out_arrow)
        words, runs, contexts, texts, keys = [], [], [], [], []
        for r in group.select(["base", "words", "runs", "contexts", "texts"]).to_pylist():
            words.append(np.frombuffer(r["words"], np.uint64))
            runs.append(np.frombuffer(r["runs"], np.uint32))
            contexts.append(np.frombuffer(r["contexts"], np.uint16))
            packed = np.frombuffer(r["texts"], np.uint32)
            texts.append(packed & np.uint32(1))
            keys.append((packed >> np.uint32(1)).astype(np.int64) + r["base"])
        every, number = np.unique(np.concatenate(words), return_inverse=True)
        word = np.repeat(number, np.concatenate(runs)).astype(np.int64)
        context, held = np.concatenate(contexts).astype(np.int64), np.concatenate(texts).astype(bool)
        known, text = np.unique(np.concatenate(keys), return_inverse=True)
        order = np.argsort((word << 16) | context, kind="stable")
        word, context, held, text = word[order], context[order], held[order], text[order]
        head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        c = np.add.reduceat((~held).astype(np.int64), head)
        pw, pc = word[head], context[head]
        many, one = c > 1, c == 1
        values = {
            "words": every, "counts": np.bincount(word, ~held, len(every)).astype(np.uint32), "ones": np.bincount(pw[one], minlength=len(every)).astype(np.uint32),
            "many_word": pw[many].astype(np.uint32), "many_context": pc[many].astype(np.uint16), "many_count": c[many].astype(np.uint32),
            "pair_word": pw.astype(np.uint32), "pair_context": pc.astype(np.uint16), "pair_count": c.astype(np.uint32),
            "pair_length": np.diff(np.append(head, len(word))).astype(np.uint32), "texts": text.astype(np.uint32), "keys": known,
        }
        row = {"part": group.column("part")[0].as_py()} | {k: v.tobytes() for k, v in values.items()}
        return pa.Table.from_pylist([row], out_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    out_arrow = to_arrow_schema(out_type)
    id_arrow = out_arrow.field("ids").type
    counted = rows.mapInArrow(tidied(request), blob).groupBy("part").applyInArrow(tidied_group(merge), out_type)
    return written(counted, "lm-parts", large_rows=True), hot


# -- seating -----------------------------------------------------------------

STIRLING = 128


def closing(discount: float) -> np.ndarray:
    """P(a random customer sits alone | c customers at t tables), for c up to STIRLING:
    S(c - 1, t - 1) / S(c, t), generalised Stirling numbers of the discount."""
    log = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    log[0, 0] = 0.0
    t = np.arange(1, STIRLING + 1)
    for c in range(1, STIRLING + 1):
        stay = np.where(c - 1 - discount * t > 0, np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf) + log[c - 1, 1:]
        log[c, 1:] = np.logaddexp(log[c - 1, :-1], stay)
    out = np.zeros_like(log)
    fine = np.isfinite(log[1:, 1:])
    out[1:, 1:][fine] = np.exp(np.minimum(0.0, log[:-1, :-1][fine] - log[1:, 1:][fine]))
    return out


def alone(table_: np.ndarray, discount: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(a random customer sits alone); of large dishes by the asymptotic share of single tables."""
    far = np.where(t > 1, discount * t / np.maximum(c, 1), 0.0)
    near = c <= STIRLING
    return np.where(near, table_[np.where(near, c, 0), np.where(near, t, 0)], np.minimum(far, 1.0))


def move(rng, table_: np.ndarray, discount: float, c: np.ndarray, t: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Take a random customer out of every dish and seat it anew; ``fresh`` is the weight of a new table."""
    left = t - ((rng.random(len(c)) < alone(table_, discount, c, t)) & (c > 1))
    opens = rng.random(len(c)) * (fresh + c - 1 - discount * left) < fresh
    return np.where(c > 1, left + opens, t)


def seat(rng, discount: float, c: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Numbers of tables after c customers came one after another, late ones in small batches."""
    t, done = np.minimum(c, 1), np.minimum(c, 1)
    while True:
        more = np.minimum(c - done, np.maximum(1, done // 8))
        going = np.flatnonzero(more)
        if not len(going):
            return t
        g = going
        p = fresh[g] / (fresh[g] + done[g] - discount * t[g])
        t[g] += rng.binomial(more[g], np.clip(p, 0, 1))
        done[g] += more[g]


@dataclass(frozen=True)
class Totals:
    """What all parts share: customers per context, training tokens and words, both discounts."""

    customers: np.ndarray
    tokens: int
    words: int
    discount: float
    parent_discount: float
    hot_counts: np.ndarray  # of the hot words, in training


@dataclass(frozen=True)
class State:
    """Table totals after a sweep: per context, of the parent, and the parent's state of hot words."""

    tables: np.ndarray
    customers: int  # of the parent: all tables of contexts
    parent_tables: int
    hot_customers: np.ndarray
    hot_tables: np.ndarray


class Part:
    """The restaurants' share of one part, seated anew from the totals of past sweeps."""

    def __init__(self, row: dict, totals: Totals, hot: np.ndarray, params: PitmanYorParams):
        kinds = {"words": np.uint64, "many_context": np.uint16, "pair_context": np.uint16, "keys": np.int64}
        for name, raw in row.items():
            if isinstance(raw, bytes):
                setattr(self, name, np.frombuffer(raw, kinds.get(name, np.uint32)).astype(kinds.get(name, np.int64)))
        self.number, self.totals, self.params, self.hot = row["part"], totals, params, hot
        at = np.minimum(np.searchsorted(hot, self.words), max(0, len(hot) - 1))
        self.is_hot = hot[at] == self.words if len(hot) else np.zeros(len(self.words), bool)
        self.hot_at = at[self.is_hot]
        self.tables = np.ones(len(self.many_count), np.int64)
        self.parent = np.minimum(self.seated(), 1)

    def word_counts(self) -> np.ndarray:
        """Training occurrences of each word, in all parts."""
        out = self.counts.copy()
        out[self.is_hot] = self.totals.hot_counts[self.hot_at]
        return out

    def seated(self) -> np.ndarray:
        """Customers that each word sends to the parent from this part."""
        return self.ones + np.bincount(self.many_word, self.tables, len(self.words)).astype(np.int64)

    def parent_probability(self, state: State) -> np.ndarray:
        k, s = self.totals, self.params.strength
        c, t = self.seated(), self.parent.copy()
        c[self.is_hot], t[self.is_hot] = state.hot_customers[self.hot_at], state.hot_tables[self.hot_at]
        return parent_probability(c, t, state, k, s)

    def sweep(self, state: State, number: int, tables: tuple[np.ndarray, np.ndarray]) -> None:
        k, s = self.totals, self.params.strength
        rng = np.random.default_rng([self.number, number])
        fresh = (s + k.discount * state.tables[self.many_context]) * self.parent_probability(state)[self.many_word]
        if number == 0:
            self.tables = seat(rng, k.discount, self.many_count, fresh)
        for _ in range(self.params.moves):
            self.tables = move(rng, tables[0], k.discount, self.many_count, self.tables, fresh)
        c = self.seated()
        above = np.full(len(c), (s + k.parent_discount * state.parent_tables) / (k.words + 1))
        self.parent = seat(rng, k.parent_discount, c, above) if number == 0 else np.clip(self.parent, np.minimum(c, 1), c)
        for _ in range(self.params.moves):
            self.parent = move(rng, tables[1], k.parent_discount, c, self.parent, above)


def parent_probability(c, t, state: State, k: Totals, s: float) -> np.ndarray:
    rest = (s + k.parent_discount * state.parent_tables) / (s + state.customers)
    return (c - k.parent_discount * t) / (s + state.customers) + rest / (k.words + 1)


def rows_in(batches):
    """Rows of batches one at a time; each holds the arrays of a part."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def sweeps(part: Part, history: list[State], tables: tuple[np.ndarray, np.ndarray]) -> None:
    for number, state in enumerate(history):
        part.sweep(state, number, tables)


SWEPT = "words counts ones many_word many_context many_count".split()


@dataclass(frozen=True)
class Model:
    parts: DataFrame
    hot: np.ndarray
    totals: Totals
    history: list[State]
    params: PitmanYorParams


def rows_of(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].alias("id"), held_out.alias("held"), utf8(docs[text_col]).alias("text"))


def train(rows: DataFrame, params: PitmanYorParams = PitmanYorParams()) -> Model:
    """Count ``rows`` (id, held, text) and sample the seating of those not held out."""
    stored, hot = count(rows, params)
    own = stored.filter("words IS NOT NULL")
    k, h = params.contexts, len(hot)

    def gathered(columns: list[str], sums, *sizes: int) -> list[np.ndarray]:
        """Vectors of these sizes, added up over all parts; they are as long as contexts or hot words are many."""

        def run(batches):
            every = np.zeros(sum(sizes), np.int64)  # over the parts of a task
            for row in rows_in(batches):
                every += np.concatenate(sums(row))
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], ["at", "n"])

        got = own.select("part", *columns).mapInArrow(tidied(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(sum(sizes), np.int64)
        out[got.column("at").to_numpy()] = got.column("n").to_numpy()
        return np.split(out, np.cumsum(sizes)[:-1])

    def scattered(part: Part, of_hot: np.ndarray) -> np.ndarray:
        out = np.zeros(h, np.int64)
        out[part.hot_at] = of_hot
        return out

    def counted(row: dict) -> list[np.ndarray]:
        part = Part(row, None, hot, params)
        c, at = part.pair_count, part.pair_context
        pairs = np.bincount(part.pair_word[c > 0], minlength=len(part.words))
        scalars = [c.sum(), (part.counts[~part.is_hot] > 0).sum(), *((x == n).sum() for x in (c, pairs) for n in (1, 2))]
        of_context = [np.bincount(at, c, k), np.bincount(at[c > 0], minlength=k), np.bincount(at[c == 1], minlength=k)]
        return [x.astype(np.int64) for x in (*of_context, np.array(scalars), scattered(part, pairs[part.is_hot]), scattered(part, part.counts[part.is_hot]))]

    customers, pairs, single, scalars, hot_pairs, hot_counts = gathered([*SWEPT, "pair_word", "pair_context", "pair_count"], counted, k, k, k, 6, h, h)

    def discount(once: int, twice: int) -> float:
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else 0.5

    totals = Totals(customers, int(scalars[0]), int(scalars[1] + (hot_counts > 0).sum()), discount(*scalars[2:4].tolist()), discount(*scalars[4:].tolist()), hot_counts)
    # before the first sweep every pair has one table, and every word one at the parent
    history = [State(pairs, int(pairs.sum()), totals.words, hot_pairs, np.minimum(hot_pairs, 1))]
    above, rng = closing(totals.parent_discount), np.random.default_rng(0)
    for _ in range(params.burn_in + params.samples):

        def swept(row: dict) -> list[np.ndarray]:
            part = Part(row, totals, hot, params)
            sweeps(part, history, (closing(totals.discount), above))
            c = part.seated()
            scalars = np.array([c.sum(), part.parent[~part.is_hot].sum()], np.int64)
            return [np.bincount(part.many_context, part.tables, k).astype(np.int64), scalars, scattered(part, c[part.is_hot])]

        tables, scalars, hot_c = gathered(SWEPT, swept, k, 2, h)
        last = history[-1]
        fresh = np.full(h, (params.strength + totals.parent_discount * last.parent_tables) / (totals.words + 1))
        hot_t = seat(rng, totals.parent_discount, hot_c, fresh) if len(history) == 1 else np.clip(last.hot_tables, np.minimum(hot_c, 1), hot_c)
        for _ in range(params.moves):
            hot_t = move(rng, above, totals.parent_discount, hot_c, hot_t, fresh)
        history.append(State(tables + single, int(scalars[0]), int(scalars[1] + hot_t.sum()), hot_c, hot_t))
    return Model(stored, hot, totals, history, params)


def score(model: Model) -> DataFrame:
    """id, held, n_tokens, n_known, base_score, score of every counted row; scores are log10."""
    k, params, history, hot = model.totals, model.params, model.history, model.hot
    s, drawn = params.strength, model.history[-params.samples :]
    share = [(s + k.discount * x.tables) / (s + k.customers) for x in drawn]

    def run(batches):
        tables, held = (closing(k.discount), closing(k.parent_discount)), []
        for row in rows_in(batches):
            part = Part(row, k, hot, params)
            probability = np.zeros(len(part.pair_word))
            many = part.pair_count > 1
            for number, state in enumerate(history[:-1]):
                part.sweep(state, number, tables)
                if number + 1 < len(history) - params.samples:
                    continue
                now = history[number + 1]
                t = np.minimum(part.pair_count, 1)
                t[many] = part.tables
                above = part.parent_probability(now)[part.pair_word]
                i = number + 1 - (len(history) - params.samples)
                probability += (part.pair_count - k.discount * t) / (s + k.customers[part.pair_context]) + share[i][part.pair_context] * above
            log = np.repeat(np.log10(probability / params.samples), part.pair_length)
            counts = part.word_counts()
            base = np.log10((counts + 1) / (k.tokens + k.words + 1))
            base = np.repeat(base[part.pair_word], part.pair_length)
            known = np.repeat((counts > 0)[part.pair_word], part.pair_length)
            n = len(part.keys)
            sums = [np.bincount(part.texts, w, n) for w in (log, base, known)]
            held.append((part.keys, *sums))
            if sum(len(h[0]) for h in held) > params.chunk_tokens:
                yield packed_sums(held)
                held = []
        if held:
            yield packed_sums(held)

    def packed_sums(held: list[tuple]) -> pa.RecordBatch:
        """The sums of some parts, added up by text: a packed row per bucket of texts."""
        keys, number = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(number, np.concatenate([h[i] for h in held]), len(keys)) for i in (1, 2, 3)]
        sums[2] = sums[2].astype(np.uint32)
        at = (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[order], np.arange(buckets + 1))
        rows: list[list] = [[] for _ in range(5)]
        for bucket in np.unique(at).tolist():
            own = order[cut[bucket] : cut[bucket + 1]]
            for col, v in zip(rows, (bucket, keys[own].tobytes(), *(x[own].tobytes() for x in sums)), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "keys", "score", "base", "known"])

    def added(group: pa.Table) -> pa.Table:
        flat = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])
        every, number = np.unique(flat("keys", np.int64), return_inverse=True)
        score_, base, known = (
            np.bincount(number, flat(c, kind), len(every)) for c, kind in (("score", float), ("base", float), ("known", np.uint32))
        )
        return pa.table({"key": every, "score": score_, "base_score": base, "n_known": known.astype(np.int64)})

    own = model.parts.filter("words IS NOT NULL")
    buckets = max(1, own.count() // 4)
    packed = own.select(*[c for c in model.parts.columns if c not in ("base", "ids", "held", "lengths")])
    packed = packed.mapInArrow(tidied(run), "bucket int, keys binary, score binary, base binary, known binary")
    summed = packed.groupBy("bucket").applyInArrow(tidied_group(added), "key long, score double, base_score double, n_known long")

    id_type = model.parts.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("held", T.BooleanType()), T.StructField("n_tokens", T.LongType())])

    def texts(batches):
        for batch in batches:
            for base, ids, held, raw in zip(batch.column("base").to_pylist(), batch.column("ids"), batch.column("held"), batch.column("lengths").to_pylist(), strict=True):
                lengths = np.frombuffer(raw, np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(lengths))), ids.values, held.values, pa.array(lengths)], ["key", "id", "held", "n_tokens"])

    docs = model.parts.filter("words IS NULL").select("base", "ids", "held", "lengths").mapInArrow(texts, schema)
    return docs.join(summed.hint("merge"), "key").drop("key")


def perplexity(scored: DataFrame) -> DataFrame:
    """held, tokens, perplexity over all tokens of the rows, and that of the base."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held").agg(F.sum("n_tokens").alias("tokens"), power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))


@query()
def op3_lm_score(spark, sf_dir):
    """Every document scored by the model learnt from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(rows_of(docs, fold_of(F.col("doc_id"), 7) == 2))
    scored = score(model).withColumn("train_tokens", F.lit(model.totals.tokens).cast("long"))
    return scored.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
