"""op9: licence notices in every document."""
from __future__ import annotations

from . import license as lic
from .catalog import register
from .common import table

_T = ", ".join("({}, '{}', '{}', '{}')".format(n, i, b.replace("'", "''"), f) for n, (i, b, f) in enumerate(lic.TEMPLATES))
_W = "list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_G = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"

SQL = f"""
with t as (select no, id, {_W.format(c='body')} as w, {_W.format(c='family')} as f from (values {_T}) v(no, id, body, family)),
tl as (select no, id, len(w) - 1 as length, list_distinct({_G.format(w='w')}) as g, {_G.format(w='f')} as fg from t),
tg as (select no, id, length, len(g) as m, unnest(g) as b, fg from tl),
must as (select no, b, regexp_matches(b, '[0-9]') or list_contains(fg, b) as must from tg),
need as (select no, count(*) filter (where must) as n_must from must group by no),
d as (select doc_id, {_W.format(c="coalesce(text, '')")} as w from documents),
p as (select doc_id, unnest({_G.format(w='w')}) as b, unnest(range(0, len(w) - 1)) as pos from d),
h as (select doc_id, no, id, length, m, pos, must, coalesce(lag(pos) over (partition by doc_id, no, b order by pos), -1) as before
  from p join tg using (b) join must using (no, b)),
c as (select doc_id, no from h where before = -1 group by doc_id, no, m having count(*) >= m / 1.5 - 1e-6),
hc as (select h.* from h join c using (doc_id, no)),
s as (select x.doc_id, x.no, x.id, x.m, x.pos, k.pos as till,
    sum(case when k.before < x.pos then 1 else 0 end) over w as c, sum(case when k.must and k.before < x.pos then 1 else 0 end) over w as u, row_number() over w as n
  from hc x join hc k on x.doc_id = k.doc_id and x.no = k.no and k.pos >= x.pos and k.pos - x.pos < floor(1.5 * x.length + 1e-6)
  window w as (partition by x.doc_id, x.no, x.pos order by k.pos)),
v as (select s.*, 2.0::double * c / (c + (till - pos + 1) - n + m) as dice from s join need using (no) where u = n_must),
win as (select doc_id, no, id, pos, arg_max(till, (dice, -till)) as till, max(dice) as dice from v where dice >= {lic.THRESHOLD} group by doc_id, no, id, pos)
select doc_id, id as license, no as template, pos::bigint as first_word, (till + 1)::bigint as last_word, dice from win x
where not exists (select 1 from win y where y.doc_id = x.doc_id and y.no = x.no and y.pos <= x.till and x.pos <= y.till
  and (y.dice > x.dice or (y.dice = x.dice and y.pos < x.pos)))
"""


@register("op9_license_scans", SQL)
def op9_license_scans(spark, sf_dir):
    """Every stretch of a document that matches a licence template."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lic.license_matches(docs)
