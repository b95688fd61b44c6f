"""DuckDB SQL for the registered queries whose whole result SQL can express."""

from __future__ import annotations

from riskspark.llm.url_graph import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEADS = ", ".join(f"lead(word, {k}) over (partition by rid order by pos)" for k in range(1, 10))

DECONTAMINATION = rf"""
with d as materialized (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select row_number() over () as iid, item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct item, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k+9], ' '))) as phrase from i where len(w) > 0),
t as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as words from d),
s as (select rid, pos, words, [word, {_LEADS}] as next from t),
p as (select rid, pos, n, array_to_string(next[1:n], ' ') as phrase from s, (select distinct n from g) where pos + n - 1 <= words),
m as materialized (select rid, pos, n, item from p join g using (n, phrase)),
hit as (select rid, count(distinct spot) as n_hit from (select rid, unnest(range(pos, pos + n)) as spot from m) group by rid),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from m) group by rid),
r as (
  select iid, item, word, 2 * len(w) as span, least(4, len(list_distinct(w))) as need from (select iid, item, w, unnest(list_distinct(w)) as word from i)
  join (select word, count(*) as n from t group by word) using (word) qualify row_number() over (partition by iid order by n, word) <= 4),
u as materialized (select iid, item, span, need, rid, pos, word from r join t using (word)),
closer as (
  select distinct a.rid, a.item from u a join u b on a.iid = b.iid and a.rid = b.rid and b.pos between a.pos and a.pos + a.span - 1
  group by a.iid, a.item, a.rid, a.pos, a.need having count(distinct b.word) = a.need),
near as (select rid, count(*) as n_near, string_agg(item, ',' order by item) as near_items from closer group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near, 0) as n_near, coalesce(near_items, '') as near_items
from d left join hit using (rid) left join found using (rid) left join near using (rid)
"""

NEAR_DEDUP = rf"""
with recursive w as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
d as materialized (
  select rid, doc_id, list_sort(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k+2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
k as materialized (select rid, doc_id, len(s) as n, md5(array_to_string(s, ' / ')) as class, s from d),
c as materialized (select class, min(doc_id) as id, any_value(s) as s, any_value(n) as n from k where n > 0 group by class),
e as (select class, n, unnest(s) as shingle from c),
linked as (select a.class as a, b.class as b from e a join e b on a.shingle = b.shingle and a.class <> b.class group by a.class, b.class, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select class, id as root from c union select l.b, r.root from reach r join linked l on l.a = r.class),
best as (select class, min(root) as root from reach group by class)
select doc_id, n as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept from k left join best using (class)
"""

LINE_DEDUP = r"""
with d as materialized (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as materialized (
  select rid, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d)),
common as (select key, max(doc_id) as last from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select rid, line, pos, last is not null and doc_id <> last as gone from l left join common using (key))
select doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d join (select rid, count(*) as n_lines, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by pos) filter (not gone) as kept from marked group by rid) using (rid)
"""

_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b::bigint))"
SHARDING = f"""
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes from documents),
s as materialized (
  select doc_id, size::bigint as size, xor(4294967295, list_reduce(list_transform(bytes, lambda h: ('0x' || h)::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint)) as text_crc32
  from d, (select {_TABLE} as tab)),
p as (select *, 2 * sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as middle, sum(size) over () as total from s),
placed as (select *, least(39, middle * 40 // (2 * total))::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, null::int as grown_shard from placed
"""

_ROUNDS = 15


def _trust() -> str:
    """Rules by longest match, then both walks, one common table expression for each round."""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    above = "list_transform(range(1, len(string_split({0}, '.')) + 1), lambda k: array_to_string((string_split({0}, '.'))[k:], '.'))"
    walk = "\n".join(
        f"r{k} as materialized (select kind, host, sum(r) as r from (select kind, dst as host, 0.85 * r * p as r from ways join r{k - 1} on r{k - 1}.host = src and r{k - 1}.kind = ways.kind_ union all select kind, host, (1 - 0.85) * r from r0) group by kind, host),"
        for k in range(1, _ROUNDS + 1)
    )
    return rf"""
with rules(action, rh, rp) as (values {rules}),
u as (select row_number() over () as rid, page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as materialized (select rid, page_id, html, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select rid, max_by({{'action': action, 'rule': rh || rp}}, length(rh || rp)) as best from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rid),
ruled as materialized (select h.*, best.action as action, best.rule as rule from h left join f using (rid)),
seeds as (select host, count(*) filter (action = 'allow') as trusted, count(*) filter (action = 'block') as blocked from ruled where host <> '' group by host),
raw as (select host as src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)) as raw from h where host <> ''),
l as (select src, dst, count(*)::double as w from (select src, rtrim({low.format("regexp_extract(raw, '^(?:[^@]*@)?([^:]*)', 1)")}, '.') as dst from raw) where dst <> '' and dst <> src group by src, dst),
hosts as (select host from h where host <> '' union select dst from l),
tree as (select distinct unnest(list_filter({above.format("host")}, lambda s: instr(s, '.') > 0)) as host from hosts),
up as (select host, regexp_replace(host, '^[^.]*\.', '') as parent from tree where instr(regexp_replace(host, '^[^.]*\.', ''), '.') > 0),
edges as (select src, dst, sum(w) as w from (select * from l union all select host, parent, 1.0 from up union all select parent, host, 1.0 from up) group by src, dst),
both_ as (select 't' as kind_, src, dst, w from edges union all select 'd', dst, src, w from edges),
ways as materialized (select kind_, src, dst, w / sum(w) over (partition by kind_, src) as p from both_),
begin_ as (select 't' as kind, host, trusted::double as r from seeds where trusted > 0 union all select 'd', host, blocked::double from seeds where blocked > 0),
r0 as materialized (select kind, host, r / sum(r) over (partition by kind) as r from begin_),
{walk}
scores as (select host, sum(case when kind = 't' then r else 0 end) as trust, sum(case when kind = 'd' then r else 0 end) as distrust from r{_ROUNDS} group by host)
select page_id, host, path, rule, coalesce(action, case when trust + distrust > 0 and round(distrust / (trust + distrust), 9) > 0.5 then 'block' else 'allow' end) as verdict
from ruled left join scores using (host)
"""


def _centroids(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    near = """a{i} as materialized (select r, arg_min(c, d * {k} + c) as c, min(d) as d from (select r, c, sum((x - m) * (x - m)) as d from x join c{i} using (i) group by r, c) group by r)"""
    mean = """c{j} as materialized (select c{i}.c, c{i}.i, case when n is null then m else (s - ((s % n) + n) % n) // n end as m from c{i} left join (select c, i, sum(x) as s, count(*) as n from a{i} join x using (r) group by c, i) using (c, i))"""
    steps = ",\n".join(t.format(i=i, j=i + 1, k=k) for i in range(rounds) for t in (near, mean))
    return f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({scale}e0 * e::double)::bigint) as e from embeddings
 where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
x as materialized (select r, unnest(e) as x, unnest(range({dims})) as i from v),
c0 as materialized (select c, unnest(e) as m, unnest(range({dims})) as i from (select row_number() over (order by h, e) - 1 as c, e from (select sha256('{seed}:' || coalesce(vec_id::varchar, '')) as h, e from v order by h, e limit {k}))),
{steps},
{near.format(i=rounds, k=k)},
z as (select c, sha256(string_agg(m::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select vec_id, c::int as cluster, d::bigint as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, centroid_sha256 from v join a{rounds} using (r) join z using (c)
"""


ORACLE_SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op6_minmax_near_dedup": NEAR_DEDUP,
    "op7_line_dedup": LINE_DEDUP,
    "op8_byte_shards": SHARDING,
    "op9_host_trust": _trust(),
    "op11_va_centroids": _centroids(),
}
