"""Scan-based retrieval experiments as Spark DataFrames.

A collection is read once, every document is scored against every topic while
it passes by, and only the best k per topic and model are shuffled.
"""

from siftrank.operators.anchors import anchor_parts
from siftrank.operators.links import anchor_text_documents, extract_links
from siftrank.operators.models import (
    BASELINES,
    Model,
    bm25,
    dirichlet_lm,
    interpolated_lm,
    lambda_sweep,
    unsmoothed_lm,
)
from siftrank.plans.jobs import (
    anchor_documents,
    anchor_experiment,
    baseline_run,
    experiment,
    simple_run,
    term_statistics,
)
from siftrank.sources.text import (
    read_anchors,
    read_documents,
    read_keyval,
    read_run,
    read_topics,
    read_weighted_topics,
)
from siftrank.sources.warc import read_warc, warc_documents, warc_pages

__all__ = [
    "BASELINES",
    "Model",
    "anchor_documents",
    "anchor_experiment",
    "anchor_parts",
    "anchor_text_documents",
    "baseline_run",
    "bm25",
    "dirichlet_lm",
    "experiment",
    "extract_links",
    "interpolated_lm",
    "lambda_sweep",
    "read_anchors",
    "read_documents",
    "read_keyval",
    "read_run",
    "read_topics",
    "read_warc",
    "read_weighted_topics",
    "simple_run",
    "term_statistics",
    "unsmoothed_lm",
    "warc_documents",
    "warc_pages",
]
