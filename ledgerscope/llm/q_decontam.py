"""op12: every document against all benchmark items."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam
from .catalog import register
from .common import table

NEAR = 20      # words within which a window's words make a proximity match

SQL = r"""
with d as (select doc_id, row_number() over () as k,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select item_id, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) as g,
    least(len(w), 10) as n from b where len(w) > 0),
bg as (select distinct item_id, g, n from bw),
sizes as (select distinct n from bg),
dw as (select k, n, unnest(range(0, len(w) - n + 1)) as s, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) as g
    from d, sizes where len(w) >= n),
h as (select k, s, n, item_id from dw join bg using (g, n)),
hw as (select k, count(distinct p) as n_hit from (select k, unnest(range(s, s + n)) as p from (select distinct k, s, n from h)) group by k),
hi as (select k, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as items from h group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (k) left join hi using (k)
"""


@register("op12_benchmark_decontamination", SQL)
def op12_benchmark_decontamination(spark, sf_dir):
    """Words of each document that stand in ten-word windows of the items, and the items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontam.contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
