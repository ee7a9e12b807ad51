"""SQL twins of the registered queries, for DuckDB, where SQL can express them."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_exact_dedup"] = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id,
  first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
  count(*) over (partition by norm) as group_size,
  row_number() over (partition by norm order by n desc, doc_id) = 1 as kept,
  sha256(norm) as text_sha256
from t"""

_SWEEP = """,
{to} as (select * replace (case when sum(weight) over (partition by {dim}) > 0
    then weight * t_{dim} / sum(weight) over (partition by {dim}) else 0 end as weight) from {of})"""


def _mix() -> str:
    sql = r"""
with r as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
    case when contains(lower(t), 'licen') then 'legal' when contains(t, ' | ') then 'table'
      when contains(t, '@') or contains(t, '://') then 'contact'
      when length(t) < 1000 then 'short' else 'prose' end as topic,
    len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) as n_tokens
  from (select *, coalesce(text, '') as t from documents)),
c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from r group by all)"""
    power = {"source": 0.7, "lang": 0.8, "topic": 0.8}
    for dim, p in power.items():
        sql += f""",
m_{dim} as (select {dim}, pow(sum(tokens)::double, {p}) as raw from c group by {dim}),
g_{dim} as (select {dim}, raw / (select sum(raw) from m_{dim}) as t_{dim} from m_{dim})"""
    sql += """,
w0 as (select *, tokens::double as weight
  from c join g_source using (source) join g_lang using (lang) join g_topic using (topic))"""
    n = 0
    for _ in range(6):
        for dim in power:
            sql += _SWEEP.format(to=f"w{n + 1}", of=f"w{n}", dim=dim)
            n += 1
    return (
        sql
        + f""",
q as (select *, case when tokens > 0 then weight / tokens else 0 end as rate from w{n}),
f as (select rate, (0.8::double * sum(tokens) over ()
      - coalesce(sum(tokens) over (order by rate desc, source, lang, topic
          rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by rate desc, source, lang, topic
        rows between current row and unbounded following) as scale
  from q where rate > 0),
p as (select source, lang, topic, weight,
    case when rate > 0 then least(1.0::double,
        rate * (select max_by(scale, rate) from f where scale * rate <= 1 + 1e-9))
      else case when tokens > 0 then 0.0::double else 1.0::double end end as probability from q)
select doc_id, source, lang, topic, n_tokens, round(weight, 6) as weight,
  round(probability, 6) as probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':0'), 1, 8))::bigint / 4294967296.0::double
    < probability as sampled
from r join p using (source, lang, topic)"""
    )


ORACLE_SQL["op2_mix_to_target_weights"] = _mix()

ORACLE_SQL["op11_lexical_search"] = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms, row_number() over () as row from documents where text is not null),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms, row_number() over () as item from benchmark where text is not null),
s as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as length from d where len(terms) > 0),
q as (select item, item_id, term, count(*)::bigint as k from (select item, item_id, unnest(terms) as term from i) group by all),
e as (select doc_id, row, n, term, count(*)::bigint as tf
  from (select doc_id, row, len(terms)::bigint as n, unnest(terms) as term from d)
  where term in (select term from q) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from e group by term), s),
p as (select doc_id, row, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // length)) as impact from e, s),
r as (select item, item_id, doc_id, row, sum(k * w * impact)::bigint as score
  from q join f using (term) join p using (term) group by all),
o as (select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score from r where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 20"""
