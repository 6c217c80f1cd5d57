"""op4: fingerprints of every document and of an edited version of it."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprint as fp
from .catalog import register
from .common import table

_TREE = r"""{n}p as (select doc_id, list_transform(string_split({c}, chr(10)), lambda p: sha256(p)) as pd,
    list_distinct(flatten(list_transform(string_split({c}, chr(10)), lambda p: list_transform(range(0, greatest(len(string_split(p, ' ')) - 3, 1)),
      lambda i: array_to_string(list_slice(string_split(p, ' '), i + 1, i + 4), ' ') || chr(10) || least(4, len(string_split(p, ' ')) - i))))) as tw from e),
{n} as (select doc_id, tw, sha256(len(pd) || ':' || array_to_string(list_transform(list_filter(string_split(array_to_string(
    list_transform(pd, lambda d: d || case when d[-1] in ('0', '1') then '|' else ' ' end), ''), '|'), lambda s: s <> ''),
    lambda s: sha256(s)), ' ')) as root from {n}p)"""

SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over (order by doc_id),
    first(coalesce(text, '')) over (order by doc_id)) as nt, length(coalesce(text, '')) as n from documents),
e as (select *, left(t, n - n // 4) || left(nt, n // 4) as et from d),
{_TREE.format(n='a', c='t')}, {_TREE.format(n='b', c='et')}, {_TREE.format(n='c', c='nt')}
select doc_id, n::bigint as n_chars, sha256(et) as edited_sha256, a.root as fingerprint, b.root as edited_fingerprint,
  2.0::double * len(list_intersect(a.tw, b.tw)) / (len(a.tw) + len(b.tw)) as near_edited,
  2.0::double * len(list_intersect(a.tw, c.tw)) / (len(a.tw) + len(c.tw)) as near_next
from e join a using (doc_id) join b using (doc_id) join c using (doc_id)
"""


@register("op4_document_fingerprints", SQL)
def op4_document_fingerprints(spark, sf_dir):
    """Roots of the text and its edited version, and how alike the trees are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = fp.with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substr(text, 1, int(n_chars - n_chars div 4)), substr(next_text, 1, int(n_chars div 4)))"))
    d = d.withColumn("edited_sha256", F.sha2("edited", 256))
    for col, prefix in (("text", "_a_"), ("edited", "_b_"), ("next_text", "_c_")):
        d = fp.with_tree(d, col, prefix)
    return d.select("doc_id", "n_chars", "edited_sha256", F.col("_a_root").alias("fingerprint"), F.col("_b_root").alias("edited_fingerprint"),
                    fp.likeness("_a_twigs", "_b_twigs").alias("near_edited"), fp.likeness("_a_twigs", "_c_twigs").alias("near_next"))
