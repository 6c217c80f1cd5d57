"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and the next stage reads that. All but the
last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.llm import linededup, mixing, neardup, packing, q_mixing, quality
from ledgerscope.llm.common import table, written


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the cascade."""
    return quality.passing(docs)


def line_dedup(spark, docs, sf_dir):
    """Texts less the later copies of line runs of 10 words or more; a document
    of which no line with a word is left goes. n_chars follows the text."""
    out = linededup.dedup_lines(docs, min_words=10)
    out = out.where("n_deleted = 0 OR text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class."""
    return neardup.one_of_each(docs).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Documents at the target weights, as many tokens as there are, at most
    four epochs of a leaf: a document drawn in several epochs is as many rows."""
    out = mixing.mix(docs, q_mixing.TREE, q_mixing.WEIGHTS, 1.0, q_mixing.EPOCHS, q_mixing.SEED)
    return out.select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all rows with their places in sequences of 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the signatures nor the packing plan.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
