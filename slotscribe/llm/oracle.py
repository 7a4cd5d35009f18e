"""SQL for the queries of this package that SQL can express, for whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"select {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') as w from {table}"


CONTAMINATED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLED_WORD = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op1_decontaminate": f"""
with d as ({_words("documents", "doc_id", CONTAMINATED_WORD)}),
b as ({_words("benchmark", "item_id", CONTAMINATED_WORD)}),
spread as (select item_id, w, least(len(w), 10) as n, unnest(range(greatest(len(w) - 9, 1))) as i from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') as g from spread),
sizes as (select distinct n from windows),
places as (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, sizes where len(w) >= n),
hits as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on p.n = x.n and array_to_string(p.w[p.i + 1:p.i + p.n], ' ') = x.g),
hit_words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
""",
    "op3_jaccard": f"""
with recursive d as ({_words("documents", "doc_id", SHINGLED_WORD)}),
sets as (
  select doc_id, list_distinct([array_to_string(w[i + 1:i + 5], ' ') for i in range(greatest(len(w) - 4, least(len(w), 1)))]) as s from d),
flat as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select x.doc_id as a, y.doc_id as b, x.n as p, y.n as q, count(*) as c
  from flat x join flat y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (select a, b from pairs where 100 * c >= 80 * (p + q - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select distinct a as doc_id, a as r from both_ways
  union
  select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
least_of as (select doc_id, min(r) as r from reach group by doc_id)
select sets.doc_id, len(s)::bigint as n_shingles, coalesce(r, sets.doc_id) as component_id from sets left join least_of using (doc_id)
""",
    "op5_repeats": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
places as (select doc_id, unnest(range(greatest(len(h) // 2 - 49, 0))) as i from d),
grams as (select doc_id, i, hash(substr(h, 2 * i + 1, 100)) as g, hash(substr(h, 2 * i + 1, 100) || 'x') as g2 from places join d using (doc_id)),
firsts as (select g, g2, min(doc_id) as f from grams group by all),
dup as (select doc_id, i from grams join firsts using (g, g2) where f < doc_id),
islands as (
  select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k
  from (select doc_id, i, (i > coalesce(lag(i) over (partition by doc_id order by i), -100) + 50)::int as fresh from dup)),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from islands group by doc_id, k),
counts as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from spans group by doc_id),
edges as (
  select doc_id, coalesce(lag(b) over w, 0) as a, a as b from spans window w as (partition by doc_id order by a)
  union all
  select d.doc_id, coalesce(max(b), 0), len(any_value(h)) // 2 from d left join spans using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * e.a + 1, 2 * (e.b - e.a)), '' order by e.a) as k from edges e join d using (doc_id) group by doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(k)) as kept_sha256
from d join kept using (doc_id) left join counts using (doc_id)
""",
    "op11_warc": """
with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as m from pages),
marked as (select page_id, h, case when strlen(h) >= 1000 and page_id is distinct from m then m end as refers_to from p)
select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from marked
""",
    "op13_prefix_trie": """
with recursive bits(i, c, k) as (
  select i, i::ubigint, 0 from range(256) r(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as place
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
sums as (
  select conv_id, max(place) as own, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: xor(a >> 8, any_value(crc.t)[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint) as sum
  from t, crc group by conv_id),
convs as (
  select s.conv_id, (sum % 6)::bigint as h, s.conv_id - s.conv_id % 100 as base, least((sum % 6)::bigint, coalesce(b.own, 0)) as lent
  from sums s left join (select conv_id, own from sums) b on b.conv_id = s.conv_id - s.conv_id % 100),
rebuilt as (
  select c.conv_id, t.place, role, text from convs c join t on t.conv_id = c.base and t.place <= c.h
  union all
  select c.conv_id, t.place - c.h + c.lent, role, text from convs c join t on t.conv_id = c.conv_id and t.place > c.h),
paths as (
  select conv_id, place as depth, list(length(role) || ':' || role || text) over (partition by conv_id order by place) as p, length(text) as n from rebuilt
  union all
  select conv_id, 0, []::varchar[], 0 from convs),
nodes as (select p, depth, min(conv_id) as conv_id, count(*) as n_convs, max(n) as n from paths group by p, depth),
members as (select m.conv_id as member, depth, nodes.conv_id as node from paths m join nodes using (p, depth)),
named as (
  select nodes.conv_id, nodes.depth, members.node as parent, n_convs, (n_convs - 1) * n as saved
  from nodes left join members on members.member = nodes.conv_id and members.depth = nodes.depth - 1),
children as (select parent as conv_id, depth - 1 as depth, count(*) as n_children from named where depth > 0 group by all),
counted as (select named.*, coalesce(n_children, 0) as n_children from named left join children using (conv_id, depth)),
totals as (
  select a.node as conv_id, a.depth, sum((d.n_children = 0)::int)::bigint as n_leaves, sum(d.saved)::bigint as saved_tokens
  from counted d join members a on a.member = d.conv_id and a.depth <= d.depth group by all),
lengths as (select member, max(depth) as depth from members group by member),
ends as (
  select node as conv_id, depth, sha256(string_agg(member::varchar, ',' order by member)) as ends_sha256
  from members join lengths using (member, depth) group by all)
select conv_id, depth::bigint as depth, parent as parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) as ends_sha256
from counted join totals using (conv_id, depth) left join ends using (conv_id, depth)
""",
}
