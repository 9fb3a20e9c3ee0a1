"""Tunable defaults of the toolkit, gathered in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # ingestion
    chunk_max_chars: int = 1500
    paragraph_separator: str | None = None  # None: a blank line
    embedding_dim: int = 768
    # retrieval
    top_k: int = 5
    candidate_k: int = 12
    hybrid: bool = True
    rrf_k: int = 60
    max_distance: float = 0.52
    min_keep: int = 3
    # conversations
    max_input_chars: int = 16000
    # long-text ("fit") questions
    fit_top_k: int = 8
    fit_max_input_chars: int = 20000
    fit_embed_chars: int = 6000
    fit_min_chars: int = 80
    # pages
    page_max_chars: int = 12000
    # request control
    rate_window_seconds: int = 60
    rate_max: int = 15
    # physical bounds (Spark side only)
    broadcast_bytes: int = 64 << 20
    query_block: int = 4096  # queries sent to the tasks at once
    slab_rows: int = 50_000  # chunk vectors in a sample for bounds, and in a part of a stored cell
    salts: int = 16
    id_block: int = 1_000_000  # chunk ids per stored partition
    term_buckets: int = 64  # directories of the lexeme index
    pass_terms: int = 200_000  # query terms looked up at once
    # inverted file
    cells: int | None = None  # None: the square root of the number of chunks
    max_cells: int = 4096
    cell_train_rows: int = 256  # rows a cell of the sample that centres are trained on
    cell_rounds: int = 3
    cell_seeds: int = 4  # cells are measured at once until they hold so many times k rows
    probe_share: float = 0.4  # of all vectors, in the cells an approximate search reads
    code_bits: int = 256  # a multiple of 64
    code_slack: float = 0.75  # standard deviations

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
