"""Near duplicates: a size-aware join of word-shingle sets by Jaccard similarity.

Equal sets are one node. The frequency of every shingle over all nodes is counted
in one shuffle of packed arrays; what comes back to a node are its shingles that
another node has too. A node links only if its rarest shingles, as many as a
partner may miss plus one, hold a shared one, which leaves few nodes. Then sets
of at most ``boundary`` shingles emit a key for every subset of the size that a
partner must share, so that equal keys are links; larger sets scan the inverted
lists of their shingles within the group that shared rare shingles connect. The
boundary is where the two costs, counted over the data, add up least.

A text without words is linked with nothing. Rows with a null id are linked like
others; a component's id is its smallest id that is not null. Rows that repeat a
text are one node, and each comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import table, tidied, tidied_group, utf8
from ragloom.llm.components import components
from ragloom.llm.registry import query
from ragloom.llm.shingles import sets
from ragloom.session import broadcast_within, written


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5  # in a shingle
    percent: int = 80  # least similarity
    part_tokens: int = 1_000_000  # shingles counted together
    hot_share: float = 0.005  # of a task's nodes from which a shingle is counted apart
    subset_keys: int = 4096  # of a set at most, beyond which it is large
    boundary: int | None = None  # largest small set; None: where the costs add up least
    cell_nodes: int = 4096  # nodes compared in a task; larger groups are compared cell by cell
    id_bytes: int = 64 << 20  # sets of dropped rows up to this size are sent to the rows


def overlap(a, b, percent: int):
    """The least number of shared shingles with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def slack(n, percent: int):
    """How many shingles of a set a partner may miss."""
    return n - (-(-percent * n // 100))


def node_of(shingles: np.ndarray) -> int:
    """A set's number, by which equal sets meet."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType())]))
def _measured(text: pa.Array) -> pa.Array:
    found = sets(text, JaccardParams.words)
    return pa.array([{"n": len(s), "node": node_of(s) if len(s) else None} for s in found], pa.struct([("n", pa.int64()), ("node", pa.int64())]))


def measured(docs: DataFrame, params: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """id, n and node of every row, stored."""
    return written(docs.select(docs[id_col].alias("id"), _with(params)(utf8(docs[text_col])).alias("m")).select("id", "m.n", "m.node"), "jaccard-rows")


def _with(params: JaccardParams):
    if params.words == JaccardParams.words:
        return _measured

    @F.arrow_udf(_measured.returnType)
    def other(text: pa.Array) -> pa.Array:
        found = sets(text, params.words)
        return pa.array([{"n": len(s), "node": node_of(s) if len(s) else None} for s in found], pa.struct([("n", pa.int64()), ("node", pa.int64())]))

    return other


# -- frequencies -------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], params: JaccardParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sizes, shingles, number of the node of each shingle) of a task's distinct sets, a chunk at a time."""
    seen: set[int] = set()
    nodes, held, size = [], [], 0

    def out():
        sizes = np.array([len(s) for s in held], np.int64)
        return np.array(nodes, np.int64), sizes, np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), sizes)

    for batch in batches:
        for s in sets(batch.column("text"), params.words):
            if len(s) and (node := node_of(s)) not in seen:
                seen.add(node)
                nodes.append(node)
                held.append(s)
                size += len(s)
        if size >= params.part_tokens:
            yield out()
            nodes, held, size = [], [], 0
    if held:
        yield out()


def hot(texts: DataFrame, params: JaccardParams) -> np.ndarray:
    """Shingles that a task meets in a good share of a chunk's nodes, with rough counts, sorted.

    A shingle of ``hot_share`` of all nodes has that share in some chunk; the sum
    of sizes bounds how many there are, so they may be sent to every task.
    """

    def run(batches):
        for nodes, _, tokens, _ in chunks(batches, params):
            token, n = np.unique(tokens, return_counts=True)
            often = n >= max(2, params.hot_share * len(nodes))
            if len(nodes) >= 1 / params.hot_share:
                yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

    counts = texts.mapInArrow(tidied(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = written(counts, "jaccard-hot")
    rows = texts.agg(F.count(F.lit(1))).head()[0]
    got = found.filter(F.col("n") >= max(2.0, params.hot_share * rows)).toArrow()
    token = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return np.stack([token[order], got.column("n").to_numpy()[order].astype(np.uint64)])


PACKED = "part int, nodes binary, sizes binary, tokens binary, at binary, df binary"


def packed(part: np.ndarray, parts: int, nodes, sizes, tokens, at, df) -> pa.RecordBatch:
    """One row per part with the shingles that belong to it and the nodes that have them."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    rows: list[list] = [[] for _ in range(6)]
    for p in range(parts):
        own = order[cut[p] : cut[p + 1]]
        if len(own):
            used, place = np.unique(at[own], return_inverse=True)
            values = (p, nodes[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), tokens[own].tobytes(), place.astype(np.uint32).tobytes(), df[own].astype(np.uint32).tobytes())
            for col, v in zip(rows, values, strict=True):
                col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], [f.split()[0] for f in PACKED.split(", ")])


def unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """nodes, sizes, tokens, number of the node, df over all rows of a part."""
    cols, base = [[] for _ in range(5)], 0
    for r in rows.to_pylist():
        nodes = np.frombuffer(r["nodes"], np.int64)
        for col, v in zip(cols, (nodes, np.frombuffer(r["sizes"], np.uint32), np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["at"], np.uint32).astype(np.int64) + base, np.frombuffer(r["df"], np.uint32)), strict=True):
            col.append(v)
        base += len(nodes)
    return tuple(np.concatenate(c) for c in cols)


def spread(values: np.ndarray, parts: int) -> np.ndarray:
    return (((values.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def shared(texts: DataFrame, parts: int, params: JaccardParams) -> DataFrame:
    """node, n, tokens: the nodes that may link, with their shared shingles from rare to frequent
    (little-endian 64-bit), and how many of the first must hold one of a partner."""
    known = hot(texts, params)

    def request(batches):
        for nodes, sizes, tokens, at in chunks(batches, params):
            place = np.minimum(np.searchsorted(known[0], tokens), max(0, known.shape[1] - 1))
            often = known[0][place] == tokens if known.shape[1] else np.zeros(len(tokens), bool)
            cold = ~often
            yield packed(spread(tokens[cold], parts), parts, nodes, sizes, tokens[cold], at[cold], np.zeros(int(cold.sum()), np.int64))
            if often.any():  # their counts are known; they only pass on to their nodes
                by = np.arange(int(often.sum())) % parts
                yield packed(by, parts, nodes, sizes, tokens[often], at[often], known[1][place[often]].astype(np.int64))

    def reply(rows: pa.Table) -> pa.Table:
        nodes, sizes, tokens, at, df = unpacked(rows)
        _, first, number = np.unique(nodes, return_index=True, return_inverse=True)
        at, nodes, sizes = number[at], nodes[first], sizes[first]
        order = np.lexsort((at, tokens))
        tokens, at, df = tokens[order], at[order], df[order]
        new = np.ones(len(tokens), bool)  # a node that several tasks met counts once
        new[1:] = (tokens[1:] != tokens[:-1]) | (at[1:] != at[:-1])
        tokens, at, df = tokens[new], at[new], df[new]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.repeat(np.diff(np.append(head, len(tokens))), np.diff(np.append(head, len(tokens))))
        count = np.where(df > 0, df, count)  # a hot shingle has the same count wherever it goes
        many = count > 1
        batch = packed(spread(nodes[at[many]], parts), parts, nodes, sizes, tokens[many], at[many], count[many])
        return pa.Table.from_batches([batch])

    def gather(rows: pa.Table) -> pa.Table:
        nodes, sizes, tokens, at, df = unpacked(rows)
        _, first, number = np.unique(nodes, return_index=True, return_inverse=True)
        at, nodes, n = number[at], nodes[first], sizes[first].astype(np.int64)
        order = np.lexsort((tokens, df, at))
        tokens, at = tokens[order], at[order]
        again = np.zeros(len(tokens), bool)  # hot shingles of a node that several tasks met
        again[1:] = (tokens[1:] == tokens[:-1]) & (at[1:] == at[:-1])
        tokens, at = tokens[~again], at[~again]
        have = np.bincount(at, minlength=len(nodes))
        rare = slack(n, params.percent) + 1 - (n - have)  # of the first n - need + 1, those that are shared
        starts = np.concatenate([[0], np.cumsum(have)])
        may = np.flatnonzero(rare > 0)
        return pa.table({
            "node": pa.array(nodes[may]), "n": pa.array(n[may]), "rare": pa.array(rare[may]),
            "tokens": pa.array([tokens[starts[i] : starts[i + 1]].tobytes() for i in may], pa.binary()),
        })

    counted = texts.mapInArrow(tidied(request), PACKED).groupBy("part").applyInArrow(tidied_group(reply), PACKED)
    found = counted.groupBy("part").applyInArrow(tidied_group(gather), "node long, n long, rare long, tokens binary")
    return written(found, "jaccard-nodes")


# -- links -------------------------------------------------------------------


def subset_count(n: int, have: int, percent: int) -> int:
    """Keys that a set of ``n`` with ``have`` shared shingles emits."""
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sum(comb(have, need) for b in sizes if (need := overlap(n, b, percent)) <= have)


def subset_keys(n: int, tokens: np.ndarray, percent: int, largest: int) -> list[tuple[int, int]]:
    """(partner size, key) for each partner size and each subset that such a partner must share."""
    out, mask = [], (1 << 64) - 1
    values = [int(t) for t in tokens]
    every = sum(values)
    for b in range(-(-percent * n // 100), min(100 * n // percent, largest) + 1):
        need = overlap(n, b, percent)
        lo, hi = min(n, b), max(n, b)
        for gone in combinations(values, len(values) - need) if need <= len(values) else ():
            rest = (every - sum(gone)) & mask
            key = hashlib.blake2b(b"%d %d %d" % (lo, hi, rest), digest_size=8).digest()
            out.append((b, int.from_bytes(key, "little", signed=True)))
    return out


def boundary(nodes: DataFrame, params: JaccardParams) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    Per size: the keys that sets of the size emit, against the entries in the
    lists of their rare shingles. Sizes whose keys pass ``subset_keys`` stay large.
    """
    token = F.col("tokens")
    most = next(n for n in range(1, 1000) if subset_count(n, n, params.percent) > params.subset_keys) - 1
    small = nodes.filter(F.col("n") <= 2 * most).select("node", "n", "rare", F.length(token).alias("bytes"), token)
    lists = rare_rows(small).groupBy("token").agg(F.count(F.lit(1)).alias("entries"))
    scan = rare_rows(small).join(lists, "token").groupBy("n").agg(F.sum("entries").alias("scan"))
    keys = small.groupBy("n", (F.col("bytes") / 8).cast("int").alias("have")).agg(F.count(F.lit(1)).alias("sets"))
    cost = {r.n: r.scan for r in scan.collect()}  # at most 2 * most rows, and its square below
    emitted: dict[int, int] = {}
    for r in keys.collect():
        emitted[r.n] = emitted.get(r.n, 0) + r.sets * subset_count(r.n, r.have, params.percent)
    total = lambda x: sum(c for n, c in emitted.items() if n <= x) + sum(c for n, c in cost.items() if 100 * n >= params.percent * (x + 1))
    return min(range(most + 1), key=lambda x: (total(x), x))


def rare_rows(nodes: DataFrame) -> DataFrame:
    """token, node, n of the rare shared shingles, in which linked nodes meet."""
    cut = F.transform(F.sequence(F.lit(0), F.least(F.col("rare"), F.length("tokens") / 8).cast("int") - 1), lambda i: F.substring("tokens", i * 8 + 1, F.lit(8)))
    return nodes.select(F.explode(cut).alias("token"), "node", "n")


def small_links(nodes: DataFrame, largest: int, params: JaccardParams) -> DataFrame:
    """Edges between sets of at most ``largest`` shingles, each to the least of a key.

    Sets with a common key are linked, if it is one of equal sizes or both of its sizes are there.
    """

    def run(batches):
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for r in batch.to_pylist():
                keys = subset_keys(r["n"], np.frombuffer(r["tokens"], np.uint64), params.percent, largest)
                for b, key in keys:
                    for col, v in zip(rows, (key, r["node"], r["n"], b != r["n"]), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["key", "node", "n", "two"])

    keyed = nodes.filter(F.col("n") <= largest).select("node", "n", "tokens")
    keyed = keyed.mapInArrow(tidied(run), "key long, node long, n long, two boolean").distinct()
    groups = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most"), (~F.first("two") | (F.min("n") != F.max("n"))).alias("linked"))
    joined = keyed.join(groups.filter("v != most AND linked").hint("merge"), "key")
    return joined.filter("node != v").select(F.col("node").alias("u"), "v")


def linked(batch: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least node of each component of the links within a cell.

    ``batch``: node, n, tokens, and side (0: both, 1 or 2: only pairs between).
    """
    node, n, side = batch["node"], batch["n"], batch["side"]
    order = np.argsort(n, kind="stable")
    sets_ = [np.frombuffer(batch["tokens"][i], np.uint64) for i in order]
    node, n, side = node[order], n[order], side[order]
    sizes = np.array([len(s) for s in sets_])
    _, token = np.unique(np.concatenate(sets_), return_inverse=True)
    owner = np.repeat(np.arange(len(node)), sizes)
    by = np.argsort(token, kind="stable")
    lists, starts = owner[by], np.searchsorted(token[by], np.arange(token.max() + 2))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(len(node))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(node)):
        own = token[ends[i] : ends[i + 1]]
        scanned = np.concatenate([lists[a:b] for a, b in zip(starts[own].tolist(), starts[own + 1].tolist())])
        both = np.bincount(scanned, minlength=len(node))[:i]
        near = np.flatnonzero((100 + percent) * both >= percent * (n[:i] + n[i]))
        near = near[(side[near] != side[i]) | (side[i] == 0)]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(node))])
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, top, node)
    moved = least[top] != node
    return node[moved], least[top][moved]


def large_links(nodes: DataFrame, groups: DataFrame, params: JaccardParams) -> DataFrame:
    """Edges between sets of the same group (node, component).

    A group beyond ``cell_nodes`` is dealt to blocks, and every pair of blocks is
    a cell of its own, so no task holds a whole group.
    """
    # groups are named and sized without their sets, which then move by node alone
    named = nodes.select("node").join(groups.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "jaccard-groups")
    sizes = written(named.groupBy("component").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "jaccard-sizes")
    sizes = broadcast_within(sizes, sizes.count(), 32, params.id_bytes)
    member = nodes.join(named.join(sizes, "component").hint("merge"), "node")
    blocks = F.ceil(F.col("members") / params.cell_nodes).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = member.select("component", "node", "n", "tokens", "block", other).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node", "n", "tokens",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def run(rows: pa.Table) -> pa.Table:
        cols = {c: rows.column(c).to_numpy() for c in ("node", "n", "side")} | {"tokens": rows.column("tokens").to_pylist()}
        u, v = linked(cols, params.percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return cells.groupBy("cell").applyInArrow(run, "u long, v long")


def links(docs: DataFrame, rows: DataFrame, params: JaccardParams, text_col: str = "text") -> DataFrame:
    """Edges (u, v) between nodes whose transitive closure is that of all links."""
    total = rows.agg(F.sum("n")).head()[0] or 0
    parts = max(1, -(-total // params.part_tokens))
    texts = docs.select(utf8(docs[text_col]).alias("text"))
    nodes = shared(texts, parts, params)
    small = boundary(nodes, params) if params.boundary is None else params.boundary
    few = small_links(nodes, small, params)
    # a set below this size has no partner beyond the boundary
    large = nodes.filter(100 * F.col("n") >= params.percent * (small + 1))
    met = rare_rows(large).select("token", "node")
    least = met.groupBy("token").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v != most")
    edges = met.join(least.hint("merge"), "token").filter("node != v").select(F.col("node").alias("u"), "v")
    return large_links(large, components(edges), params).union(few)


def classes(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (size of the set), node, class (the least node of a component) and component_id (the
    least id reachable by links) of every row."""
    rows = measured(docs, params, id_col, text_col)
    found = written(components(links(docs, rows, params, text_col)), "jaccard-classes")
    named = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = named.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(named.drop("least").join(least.hint("merge"), "component").select("node", F.col("component").alias("class"), "component_id"), "jaccard-named")
    joined = rows.join(of.hint("merge"), "node", "left")
    return joined.select("id", "n", "node", "class", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def distinct_texts(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with its id, of several its smallest set number.

    Rows that repeat both id and set stay or go together; columns are unchanged.
    """
    found = classes(docs, params, id_col, text_col).filter("node IS NOT NULL")
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("class").agg(F.min("node").alias("stays"))
    gone = found.join(first.hint("merge"), "class").filter(~F.col("id").eqNullSafe(F.col("component_id")) | (F.col("node") != F.col("stays")))
    gone = written(gone.select(F.col("id").alias("_id"), F.col("node").alias("_node")).distinct(), "jaccard-gone")
    gone = broadcast_within(gone, gone.count(), 64, params.id_bytes)
    doc = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("_own"), _with(params)(utf8(docs[text_col]))["node"].alias("_set"))
    return doc.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_node")), "left_anti").select("doc.*")


@query()
def op7_jaccard_join(spark, sf_dir):
    """Every document with the component of its links at a similarity of 0.8 over five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
