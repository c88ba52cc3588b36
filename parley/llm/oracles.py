"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .stupid_backoff import ALPHA
from .url_filters import BASE, rules

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(table: str, key: str) -> str:
    return f"select row_number() over () as row, {key}, regexp_extract_all(translate(coalesce(text, ''), '{ABC}', '{ABC.lower()}'), '{WORD}') as ws from {table}"


def _urls() -> str:
    fits = []
    for r in BASE:
        host, path = r.name[: r.name.index("/")], r.name[r.name.index("/") :]
        fits.append(f"case when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then {{'n': {len(r.name)}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} end")
    own = "|".join(f"(?:{r.pattern})" for r in rules() if r.rank).replace("'", "''")
    return f"""
with parsed as (
  select page_id,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ABC}', '{ABC.lower()}') as host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(url, '') as url from pages)
), judged as (
  select *, list_max(list_filter([{", ".join(fits)}], lambda x: x is not null)) as best from parsed
)
select page_id, host, path, best.rule as rule,
  coalesce(best.verdict, case when regexp_matches(host || path, '{own}') then 'block' else 'allow' end) as verdict
from judged"""


_OP4 = f"""
with docs as ({words("documents", "doc_id")}),
w as (select row, i, ws[i] as w, ws[i-1] as v, ws[i-2] as u from (select row, ws, unnest(range(1, len(ws) + 1)) as i from docs)),
g as (
  select row, i, w as g1, case when i > 1 then v || ' ' || w end as g2, case when i > 2 then u || ' ' || v || ' ' || w end as g3 from w
), c as (
  select row, i, g1, g2, g3,
    count(*) over (partition by g1) - count(*) over (partition by g1, row) as c1,
    case when g2 is not null then count(*) over (partition by g2) - count(*) over (partition by g2, row) else 0 end as c2,
    case when g3 is not null then count(*) over (partition by g3) - count(*) over (partition by g3, row) else 0 end as c3
  from g
), p as (
  select *, lag(c1) over (partition by row order by i) as p1, lag(c2) over (partition by row order by i) as p2 from c
), n as (select row, greatest((select count(*) from w) - len(ws), 1) as n from docs),
s as (
  select p.row, sum(case when c3 > 0 then ln(c3) - ln(p2)
    when c2 > 0 then ln({ALPHA}) + ln(c2) - ln(p1)
    when c1 > 0 then 2 * ln({ALPHA}) + ln(c1) - ln(n)
    else 2 * ln({ALPHA}) - ln(n) end) as s
  from p join n on n.row = p.row group by p.row
)
select doc_id, cast(len(ws) as bigint) as n_words, round(coalesce(s, 0), 4) as log_score, case when len(ws) > 0 then round(s / len(ws), 6) end as mean_score
from docs left join s on s.row = docs.row"""

_OP9 = f"""
with docs as ({words("documents", "doc_id")}), items as ({words("benchmark", "coalesce(cast(item_id as varchar), 'null') as item_id")}),
windows as (
  select distinct item_id, least(len(ws), 13) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from items where len(ws) > 0)
), lengths as (select distinct n from windows),
places as (select row, ws, n, unnest(range(1, len(ws) - n + 2)) as i from docs, lengths where len(ws) >= n),
found as (
  select p.row, p.i, p.n, w.item_id from (select row, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as g from places) p
  join windows w on w.n = p.n and w.g = p.g
), hit as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + n)) as k from found) group by row),
owners as (select row, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) as sha from found group by row),
posting as (select row, i, ws[i] as term from (select row, ws, unnest(range(1, len(ws) + 1)) as i from docs)),
freq as (select term, count(*) as df from posting group by term),
sets as (select item_id, g, list_distinct(string_split(g, ' ')) as terms from windows),
rare as (select item_id, terms, min_by(term, coalesce(df, 0)) as term from (select item_id, g, terms, unnest(terms) as term from sets) left join freq using (term) group by item_id, g, terms),
near as (
  select distinct p.row, r.item_id from rare r join posting p using (term) join docs on docs.row = p.row
  where list_has_all(list_slice(ws, greatest(p.i - 25, 1), p.i + 25), r.terms)
    and len(list_filter(range(p.i - 25, p.i + 1), lambda s: list_has_all(list_slice(ws, greatest(s, 1), s + 25), r.terms))) > 0
), close as (select row, count(*) as n_near from near anti join found using (row, item_id) group by row)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated,
  coalesce(n_near, 0) as n_near
from docs left join hit on hit.row = docs.row left join owners on owners.row = docs.row left join close on close.row = docs.row"""

ORACLES: dict[str, str] = {
    "op4_backoff_scores": _OP4,
    "op6_url_filter": _urls(),
    "op9_decontamination": _OP9,
}
