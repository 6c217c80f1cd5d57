"""op5: secrets in every document, through nested encodings."""
from __future__ import annotations

from . import secretscan
from .catalog import register
from .common import table


@register("op5_secret_scans")
def op5_secret_scans(spark, sf_dir):
    """Counts and digest of the base spans, and all spans with decoded layers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secretscan.secret_spans(docs)
