"""op3: every document packed into sequences of at most 4096 tokens."""
from __future__ import annotations

from . import packing
from .catalog import register
from .common import table


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    """A row per piece with its place in the packed sequences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs)
