"""SQL for the queries of this subpackage, where SQL can say what they return."""

from __future__ import annotations

from . import linededup
from .secrets import BASE, MORE, Rule

_LINKED = """
reach as (select id as a, id as b from nodes union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a as id, min(b) as root from reach group by a)"""

MIXING_TARGETS = r"""
with sized as (select source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sources as (select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sized group by source),
levels as (select 2.0 * a.source_size / a.weight as ratio,
    (1.5 * (select sum(source_size) from sources) - coalesce((select sum(2.0 * b.source_size) from sources b where 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0))
    / (select sum(b.weight) from sources b where 2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight) as level from sources a),
known as (select arg_min(level, ratio) as level from levels where level <= ratio)
select source, source_size, round(least(2.0 * source_size, coalesce(level * weight, 2.0 * source_size)), 3)::double as target from sources, known
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, upper(sha1(html)) as hex, first_value(page_id) over (partition by html order by page_id) as first from p),
groups as (select *, list_transform(range(4), lambda g: ('0x' || substr(hex, (1 + 10 * g)::int, 10))::bigint) as g from d)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[(i // 8 + 1)::int] >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from groups
"""

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0 * x::double)) as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

PQ = f"""
with recursive v as (select vec_id, embedding::double[] as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes as (select vec_id as id from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.9 - 1e-12),
{_LINKED},
counts as (select a as id, count(*) as n from links group by a)
select c.id as vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, c.id = root as kept from component c left join counts using (id)
"""

#: Links by the shingles that two documents share, each counted once; lengths bound which pairs can be links.
NEARDUP = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i::int] || ' ' || w[(i + 1)::int]) end) as s from w),
one as (select doc_id, len(s)::bigint as size, unnest(s) as shingle from s),
often as (select shingle, count(*) as n from one group by shingle),
placed as (select one.*, row_number() over (partition by doc_id order by n, shingle) as place from one join often using (shingle)),
-- Of two linked documents one of the first shingles, the rarest, is the same: as many as a link may lack, and one.
rare as (select * from placed where place <= size - (4 * size + 4) // 5 + 1),
pairs as (select distinct a.doc_id as a, b.doc_id as b from rare a join rare b on a.shingle = b.shingle and a.doc_id < b.doc_id and 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)),
shared as (select p.a, p.b, len(list_intersect(x.s, y.s)) as same, len(x.s) + len(y.s) as total from pairs p join s x on x.doc_id = p.a join s y on y.doc_id = p.b),
link as (select a, b from shared where 100 * same >= 80 * (total - same)),
links as (select a, b from link union all select b, a from link),
nodes as (select doc_id as id from documents),
{_LINKED}
select c.id as doc_id, len(s.s)::bigint as n_shingles, root as component_id, c.id = root as kept from component c join s on s.doc_id = c.id
"""


def _either_case(pattern: str) -> str:
    """(?i:...) with letters of both cases spelt out, as only A-Z count."""
    at = pattern.find("(?i:")
    if at < 0:
        return pattern
    end = pattern.index(")", at)
    spelt = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern[at + 4 : end])
    return pattern[:at] + "(?:" + spelt + ")" + _either_case(pattern[end + 1 :])


def secrets_sql(rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> str:
    """Matches by the text between them: the lengths of both add up to where each match stands."""
    parts = []
    for k, r in enumerate(rules):
        p = _either_case(r.pattern.decode()).replace("'", "''")
        parts.append(f"""select doc_id, {k} as kind, '{r.kind}' as name, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as part, string_split_regex(t, '{p}') as gap, {r.least} as least from d""")
    counts = "".join(f"count(*) filter (where kind = {k}) as n_{r.kind}, " for k, r in enumerate(rules[:base]))
    told = "string_agg(name || ':' || s || ':' || e, ',' order by s, kind)"
    zero = "".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}, " for r in rules[:base])
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(parts)}),
each as (select *, unnest(range(1, len(m) + 1)) as i from found),
stood as (select doc_id, kind, name, least, len(part[i::int]) as size, coalesce(list_sum(list_transform(gap[1:i::int], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:(i - 1)::int], lambda x: len(x))), 0) as start, len(m[i::int]) as long from each),
kept as (select doc_id, kind, name, start::bigint as s, (start + long)::bigint as e from stood where size >= least),
told as (select doc_id, {counts}{told} as spans, {told} filter (where kind < {base}) as base from kept group by doc_id)
select d.doc_id, {zero}sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join told on d.doc_id = told.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_linededup": linededup.ORACLE, "op4_secrets": secrets_sql(), "op5_warc": WARC, "op7_topk": TOP_K, "op9_pq": PQ, "op10_neardup": NEARDUP, "mixing_targets": MIXING_TARGETS}
