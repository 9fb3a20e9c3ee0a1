"""Promotion of a shadow table that has to prove itself first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ragloom.plans.evaluate import EPSILON, compare_modes, first_hit_ranks, rejection_rate, rejections
from ragloom.session import written
from ragloom.sources.tables import Held, promote, reading


@dataclass(frozen=True)
class Scores:
    """What one table reaches on the labelled and the out-of-scope queries."""

    recall_dense: float
    recall_hybrid: float
    mrr_dense: float
    mrr_hybrid: float
    rejection: float


@dataclass(frozen=True)
class Decision:
    promoted: bool
    reasons: tuple[str, ...]  # why not, in order
    live: Scores | None
    shadow: Scores


#: ``answer(chunks, queries)``: dense and hybrid retrieval from a chunk table.
Answer = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def scores(chunks: DataFrame, labelled: DataFrame, negatives: DataFrame, answer: Answer, max_distance: float) -> Scores:
    """Evaluate a chunk table in both modes; ``labelled`` and ``negatives`` also have ``text``."""
    queries = labelled.select("query_id", "text").unionByName(negatives.select("query_id", "text"))
    dense, hybrid = (written(found.select("query_id", "rnk", "doc_title", "distance"), "promotion") for found in answer(chunks, queries))
    both = compare_modes(first_hit_ranks(labelled, dense), first_hit_ranks(labelled, hybrid)).filter("cls = 'overall'").head()
    rate = rejection_rate(rejections(negatives, hybrid, max_distance)).head()["rate"]
    value = lambda c: 0.0 if both is None or both[c] is None else both[c]
    return Scores(value("recall_dense"), value("recall_hybrid"), value("mrr_dense"), value("mrr_hybrid"), 1.0 if rate is None else rate)


def compared(live: Scores | None, shadow: Scores, tolerance: float = 0.0) -> tuple[str, ...]:
    """Why the shadow may not take over: hybrid below dense, or anything below what is live."""
    reasons = []
    if shadow.recall_hybrid + EPSILON < shadow.recall_dense:
        reasons.append("hybrid recall below dense recall")
    for name in ("recall_dense", "recall_hybrid", "mrr_dense", "mrr_hybrid", "rejection") if live else ():
        if getattr(shadow, name) + tolerance + EPSILON < getattr(live, name):
            reasons.append(f"{name} below live")
    return tuple(reasons)


def guarded_promotion(
    spark: SparkSession, shadow: str, live: str, labelled: DataFrame, negatives: DataFrame, answer: Answer, max_distance: float, tolerance: float = 0.0,
    known: dict[str, Scores] | None = None,
) -> Decision:
    """Let ``live`` stand for the shadow table only if that is no worse on the given queries.

    Both tables are held while they are evaluated, so what is measured is what
    is switched to, and the name changes in one statement. A refused shadow
    leaves the live name as it is. Without a live table the shadow is promoted
    if its own modes agree. ``known`` keeps scores by stored version from one call to
    the next, for the same queries.
    """
    known = {} if known is None else known

    def scored(held: Held) -> Scores:
        if held.version not in known:
            known[held.version] = scores(held.rows, labelled, negatives, answer, max_distance)
        return known[held.version]

    with reading(spark, shadow) as candidate:
        mine = scored(candidate)
        theirs = None
        if spark.catalog.tableExists(live):
            with reading(spark, live) as now:
                theirs = scored(now)
        reasons = compared(theirs, mine, tolerance)
        if not reasons:
            promote(spark, shadow, live, candidate.version)
    return Decision(not reasons, reasons, theirs, mine)
