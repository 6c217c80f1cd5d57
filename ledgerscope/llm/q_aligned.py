"""op11: every document in two tokenizers, aligned and counted."""
from __future__ import annotations

from . import aligned
from .catalog import register
from .common import table

A = ("ranks", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
B = ("piece", "piece_bpe_32k.model")


@register("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    """Groups and links of each document, and how common its links are in the corpus."""
    return aligned.alignment(table(spark, sf_dir, "documents"), A, B)
