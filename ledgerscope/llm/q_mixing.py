"""op6: documents drawn to target weights of a domain-language-source tree."""
from __future__ import annotations

from . import mixing
from .catalog import register
from .common import table

#: Four domains by source number; a source without a number is a domain of its own.
DOMAIN = "coalesce(concat('domain', try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4), 'other')"
TREE = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
SHARE, EPOCHS, SEED = 0.5, 4, 6

_LEVEL = """{name} as (
  with k as (select {node}, sum(cap) as cap, any_value({w}) as w from leaf group by {node}),
  b as (select k.*, {budget} as budget from k {join}),
  s as (select *, (budget - coalesce(sum(cap) over ({part} order by cap / w rows between unbounded preceding and 1 preceding), 0))
          / sum(w) over ({part} order by cap / w rows between current row and unbounded following) as lv from b)
  select {node}, least(cap, w * max(lv) over ({part})) as got from s)"""

SQL = f"""
with d as (select doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4), 'other') as domain,
             lang, source, cast(ceil(coalesce(strlen(text), 0) / 4) as bigint) as mix_tokens from documents),
leaf as (select domain, lang, source, sum(mix_tokens)::bigint as tokens, sum(mix_tokens)::bigint * {EPOCHS} as cap,
    case domain when 'domain0' then 4.0::double when 'domain1' then 3 when 'domain2' then 2 else 1 end as w1,
    case lang when 'en' then 4.0::double when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end as w2, 1.0::double as w3
  from d group by all having sum(mix_tokens) > 0),
total as (select floor(sum(tokens) * {SHARE}) as t from leaf),
{_LEVEL.format(name="a1", node="domain", w="w1", budget="(select t from total)", join="", part="partition by 1")},
{_LEVEL.format(name="a2", node="domain, lang", w="w2", budget="a1.got", join="join a1 using (domain)", part="partition by domain")},
{_LEVEL.format(name="a3", node="domain, lang, source", w="w3", budget="a2.got", join="join a2 using (domain, lang)", part="partition by domain, lang")},
p as (select domain, lang, source, floor(got / tokens)::int as full_n, got - floor(got / tokens) * tokens as rest from leaf join a3 using (domain, lang, source)),
h as (select d.*, full_n, rest, ('0x' || substr(md5('{SEED}-' || full_n || '-' || doc_id), 1, 15))::bigint as h
      from d join p using (domain, lang, source)),
c as (select *, sum(mix_tokens) over (partition by domain, lang, source order by h) - mix_tokens as cum from h),
n as (select *, full_n + case when rest > 0 and h <= coalesce(max(case when cum + mix_tokens / 2 <= rest then h end)
        over (partition by domain, lang, source), -1) then 1 else 0 end as n from c)
select doc_id, domain, lang, source, mix_tokens, unnest(range(0, n))::int as epoch from n
"""


@register("op6_mixing", SQL)
def op6_mixing(spark, sf_dir):
    """A row per document and epoch it is drawn in, at half of all tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = mixing.mix(docs, TREE, WEIGHTS, SHARE, EPOCHS, SEED)
    return out.select("doc_id", "domain", "lang", "source", "mix_tokens", "epoch")
