"""op10: every document less the later copies of repeated line runs."""
from __future__ import annotations

from . import linededup
from .catalog import register
from .common import table

SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
x as (select doc_id, unnest(range(1, len(ls) + 1)) as i, ls from d),
n as (select doc_id, i, ls[i] as line from x where regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
l as (select doc_id, i, line, row_number() over (partition by doc_id order by i) as j,
        len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda z: z <> '')) as w from n),
c as (select *, sum(w) over (partition by doc_id order by j) as cw from l),
seq as (select doc_id, list(line order by j) as lst from l group by doc_id),
p as (select a.doc_id, a.j as s, b.j as e from c a join c b
        on a.doc_id = b.doc_id and b.j between a.j and a.j + 9 and b.cw - a.cw + a.w >= 10),
blk as (select doc_id, s, min(e) as e from p group by all union select doc_id, max(s) as s, e from p group by doc_id, e),
k as (select doc_id, s, e, list_slice(lst, s, e) as key from blk join seq using (doc_id)),
f as (select *, min(doc_id * 10000000 + s) over (partition by key) as first from k),
gone as (select distinct doc_id, unnest(range(s, e + 1)) as j from f where doc_id * 10000000 + s > first),
g as (select doc_id, list(i) as gl from gone join c using (doc_id, j) group by doc_id)
select doc_id, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda z: not list_contains(coalesce(gl, []), z)),
    lambda z: ls[z]), chr(10)) as text, len(ls) as n_lines, coalesce(len(gl), 0) as n_deleted
from d left join g using (doc_id)
"""


@register("op10_line_dedup", SQL)
def op10_line_dedup(spark, sf_dir):
    """Texts without later copies of line runs of 10 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, min_words=10)
