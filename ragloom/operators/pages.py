"""Fetched pages: admit, clean, tell pages from walls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.html import html_to_text, is_wall
from ragloom.functions.urls import BLOCKED_SITES, admission_problem, blocked_site, host
from ragloom.params import Params


def clean_pages(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Replace ``html`` by ``text``; keep sizes and whether the text was cut."""
    keep = [c for c in pages.columns if c != "html"]
    whole = html_to_text(F.col("html"))
    return pages.select(*keep, F.length("html").alias("chars_in"), whole.alias("_whole")).select(
        *keep, "chars_in",
        F.substring("_whole", 1, params.page_max_chars).alias("text"),
        (F.length("_whole") > params.page_max_chars).alias("cut"),
    )


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars_in").alias("chars_in"),
        F.sum(F.length("text")).alias("chars_out"), F.count_if("cut").alias("cut"),
    )


def admit_pages(
    pages: DataFrame,
    params: Params = Params(),
    rules: Sequence[tuple[str, str, str]] = BLOCKED_SITES,
    empty_below: int = 200,
    short_below: int = 600,
) -> DataFrame:
    """Add ``reason`` and ``text``; exactly one of them is null.

    The first problem counts: link, blocked site, HTTP status, content type,
    wall. Pages refused by their link are never cleaned. ``http_status`` and
    ``content_type`` are checked where the table has them.
    """
    site = blocked_site(F.col("_host"), rules)
    early = F.coalesce(admission_problem(F.col("url"), F.col("_host")), F.when(site.isNotNull(), F.concat(site, F.lit(" blocks page reads"))))
    if "http_status" in pages.columns:
        failed = F.when(F.col("http_status").isNull(), "could not reach that link").when(
            ~F.col("http_status").between(200, 299), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        early = F.coalesce(early, failed)
    if "content_type" in pages.columns:
        kind = F.coalesce("content_type", F.lit(""))
        early = F.coalesce(early, F.when(~kind.contains("html") & ~kind.contains("text"), "not a readable web page"))
    keep = [c for c in pages.columns if c != "html"]
    cleaned = F.when(F.col("_early").isNull(), html_to_text(F.col("html"), params.page_max_chars))
    wall = is_wall(F.col("_text"), empty_below, short_below)
    return (
        pages.withColumn("_host", host(F.col("url"))).withColumn("_early", early)
        .select(*keep, "_early", cleaned.alias("_text"))
        .withColumn("reason", F.coalesce("_early", F.when(wall, "login or anti-bot page")))
        .select(*keep, "reason", F.when(F.col("reason").isNull(), F.col("_text")).alias("text"))
    )


def admission_funnel(admitted: DataFrame) -> DataFrame:
    """``(reason, pages)``; admitted pages count under ``admitted``."""
    return admitted.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("pages")
    )
