"""All queries of this subpackage and their SQL."""

from ragloom.llm import (  # noqa: F401
    decontaminate,
    divergence,
    exact_dedup,
    idfiles,
    importance,
    jaccard_join,
    langid,
    license_scan,
    packing,
    pitman_yor,
    token_counts,
    toxicity,
    warc,
)
from ragloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
