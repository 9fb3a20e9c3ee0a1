"""Article tables to a searchable knowledge base."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.cells import CellIndex, build_cells
from ragloom.operators.chunking import embedding_input, in_order, number_rows, pack_chunks
from ragloom.operators.embedding import Embedder, VectorStore, embed, embed_stored
from ragloom.operators.lexical import stored_index, term_counts
from ragloom.params import Params
from ragloom.session import written


@dataclass(frozen=True)
class KnowledgeBase:
    """Chunk table and its optional lexeme index.

    ``chunks``: id, doc_title, category, source_url, content, embedding, block.
    The table is stored by ``block``, a range of ids, so a look-up of some ids
    opens their blocks only.
    ``index``: packed postings, a row per term and run of chunks, stored by ``bucket`` of
    terms (``unpacked`` gives id, term, positions, titled, bucket). ``counts``: term, df. Without an index retrieval
    runs dense only. ``cells``: the vectors once more, stored for approximate search.
    """

    chunks: DataFrame
    index: DataFrame | None = None
    counts: DataFrame | None = None
    cells: CellIndex | None = None


def chunk_articles(articles: DataFrame, order_by: list[str], params: Params = Params()) -> DataFrame:
    """Parsed articles to ``id, doc_title, category, source_url, content``.

    Articles are sorted before packing, which keeps their order: the range
    sampling then reads the texts but does not pack them twice.
    """
    numbered = number_rows(pack_chunks(in_order(articles, order_by), params))
    return numbered.select(
        "id", F.col("title").alias("doc_title"), "category", "source_url", "content"
    )


def embed_chunks(chunks: DataFrame, embedder: Embedder, task_types: bool = False, store: VectorStore | None = None) -> DataFrame:
    """Add the vector of title, category and content; the stored content stays raw.

    With a ``store`` only inputs that it has no vector of are embedded.
    """
    text = embedding_input(F.col("doc_title"), F.col("category"), F.col("content"))
    if store is not None:
        return embed_stored(chunks, embedder, text, store, "document", task_types)[0]
    return embed(chunks, embedder, text, "document", task_types)


def with_cells(kb: KnowledgeBase, params: Params = Params()) -> KnowledgeBase:
    """The same knowledge base with its inverted file."""
    return replace(kb, cells=build_cells(kb.chunks.select("id", "embedding"), params))


def build_knowledge_base(
    articles: DataFrame,
    order_by: list[str],
    embedder: Embedder,
    params: Params = Params(),
    lexical: bool = True,
    task_types: bool = False,
    store: VectorStore | None = None,
) -> KnowledgeBase:
    """Chunk, number, embed and index; every table is written once and read back."""
    embedded = embed_chunks(chunk_articles(articles, order_by, params), embedder, task_types, store)
    # ids rise along the partitions, so a task writes few blocks
    blocked = embedded.withColumn("block", F.floor(F.col("id") / params.id_block).cast("bigint"))
    chunks = written(blocked, "chunks", "block")
    if not lexical:
        return KnowledgeBase(chunks)
    index = stored_index(chunks, params=params)
    return KnowledgeBase(chunks, index, written(term_counts(index), "counts"))
