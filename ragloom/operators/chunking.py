"""Article bodies to packed, numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import BLANK_LINE, present, strip
from ragloom.params import Params
from ragloom.session import written


def paragraphs(body: Column, separator: str | None = None) -> Column:
    """Non-empty trimmed paragraphs; the separator is a pattern, a blank line by default."""
    return F.filter(F.transform(F.split(body, separator or BLANK_LINE), strip), lambda p: p != "")


def _chunk_starts(paras: Column, max_chars: int) -> Column:
    """Index of the first paragraph of every chunk.

    Only lengths travel through the fold, and the list grows once per chunk, so
    the work stays linear in the text.
    """
    start = F.struct(
        F.lit(0).alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts")
    )

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["i"] == 0) | (acc["used"] + size + 2 > max_chars)
        return F.struct(
            F.when(opens, size).otherwise(acc["used"] + size + 2).alias("used"),
            (acc["i"] + 1).alias("i"),
            F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(F.transform(paras, lambda p: F.length(p)), start, step, lambda acc: acc["starts"])


def pack_chunks(articles: DataFrame, params: Params = Params(), body_col: str = "body") -> DataFrame:
    """One row per chunk: ``chunk_no`` from 0, ``content``; ``body_col`` is dropped.

    Paragraphs are packed greedily up to ``chunk_max_chars`` with a blank line
    between them. A longer single paragraph is kept whole. No shuffle: an
    article is packed inside its own row.
    """
    keep = [c for c in articles.columns if c != body_col]
    paras, starts = F.col("_paras"), F.col("_starts")
    contents = F.transform(
        starts,
        lambda s, j: F.array_join(
            F.slice(paras, s + 1, F.coalesce(F.try_element_at(starts, j + 2), F.size(paras)) - s), "\n\n"
        ),
    )
    return (
        articles.select(*keep, paragraphs(F.col(body_col), params.paragraph_separator).alias("_paras"))
        .withColumn("_starts", _chunk_starts(paras, params.chunk_max_chars))
        .select(*keep, F.posexplode(contents).alias("chunk_no", "content"))
    )


def embedding_input(title: Column, category: Column, content: Column) -> Column:
    """Text handed to the embedder; the category part needs a non-empty category."""
    dash = F.when(present(category), F.concat(F.lit(" — "), category)).otherwise(F.lit(""))
    return F.concat(title, dash, F.lit("\n\n"), content)


def in_order(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Range-partitioned and sorted, so partition after partition is in order."""
    return df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)


def number_rows(ordered: DataFrame, id_col: str = "id") -> DataFrame:
    """Dense ids 1..n down the partitions of ``in_order``, without a single-task window.

    Each row takes its ordinal inside its partition. The table is written once,
    so partition numbers cannot move when a task is retried; then one small row
    per partition carries the offset.
    """
    placed = written(
        ordered.withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_row", F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_mid"),
        "ids",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition, so a few thousand rows at most
    up_to_here = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("_part", (F.sum("_n").over(up_to_here) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_before") + F.col("_row") + 1).alias(id_col), *ordered.columns
    )
