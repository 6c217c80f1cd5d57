"""op8: quality features and verdict of every document."""
from __future__ import annotations

from . import quality
from .catalog import register
from .common import table

SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (
  select doc_id, i, list_slice(w, i, i + 7) as k
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest(range(i, i + 8)) as p from dup) group by doc_id),
f as (
  select d.doc_id, t, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join rep using (doc_id)),
g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > word_chars or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 2 * n_dup_lines > len(string_split(t, chr(10)))
    or 2 * (length(t) - length(replace(t, '!', ''))) > n_words
    or 10 * length(regexp_replace(t, '\P{Lu}', '', 'g')) > 6 * greatest(length(regexp_replace(t, '\P{L}', '', 'g')), 1))
  as kept
from g
"""


@register("op8_quality_rules", SQL)
def op8_quality_rules(spark, sf_dir):
    """Features, base verdict and the cascade's verdict of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.FEATURES, "kept")
