"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations


def _pick(key: str, *values: str | None) -> str:
    lit = ["null" if v is None else v for v in values]
    return f"case ({key}) % {len(lit)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(lit)) + " end"


def _s(*values: str | None) -> list[str | None]:
    return [None if v is None else f"'{v}'" for v in values]


ORACLES: dict[str, str] = {}

ORACLES["f1_parse_locale_number"] = """
select c_custkey, round(c_acctbal, 2) as us, case when abs(round(c_acctbal, 2)) < 1000 then round(c_acctbal * 100) else round(c_acctbal, 2) end as eu, cast(null as double) as bad from customer"""

ORACLES["f2_number_tokens"] = """
select l_orderkey, l_linenumber, cast(3 as bigint) as n, cast(-l_linenumber as double) as first, l_quantity as second, cast(l_orderkey as double) as third from lineitem"""

ORACLES["f5_normalize_unit"] = """
select o_orderkey, case o_orderkey % 8 when 0 then o_totalprice * 1e7 when 1 then o_totalprice * 1e6 when 2 then o_totalprice when 3 then o_totalprice * 0.01
    when 4 then o_totalprice * 1e5 when 5 then o_totalprice * 1e6 when 6 then o_totalprice end as value,
    case o_orderkey % 8 when 0 then 'inr' when 1 then 'inr' when 2 then 'us usd' when 3 then '%' when 4 then 'unit' when 5 then 'tons' when 6 then 'hours' end as base_unit from orders"""

ORACLES["f6_compare_values"] = """
with p as (select o_orderkey, o_orderkey % 9 as k, o_totalprice * 1e6 as a, case when o_orderkey % 9 = 8 then o_totalprice / 1e6 else o_totalprice * (100 + o_orderkey % 9) / 100 / 10 end * 1e7 as b from orders),
d as (select *, case when a = b then 0 else abs(a - b) / greatest(abs(a), abs(b)) * 100 end as diff from p)
select o_orderkey, k not in (6, 7) as comparable, case when k not in (6, 7) then diff <= 2 end as agree,
    k not in (6, 7) and least(abs(a), abs(b)) > 0 and greatest(abs(a), abs(b)) / least(abs(a), abs(b)) >= 100 as suspect, case when k not in (6, 7) then round(diff, 2) end as diff_pct from d"""

ORACLES["f8_numeric_fallback"] = """
select o_orderkey, case o_orderkey % 4 when 1 then cast(o_orderkey as double) when 2 then cast(-o_orderkey as double) end as number from orders"""

ORACLES["f9_power_of_ten"] = """
select p_partkey, case when p_partkey % 2 = 0 and p_size % 12 <> 6 then cast(p_size % 12 - 6 as bigint) end as exponent from part"""

ORACLES["f10_parse_period"] = """
with o as (select o_orderkey, o_orderkey % 10 as k, year(o_orderdate) as y, quarter(o_orderdate) as q, case when month(o_orderdate) <= 6 then 1 else 2 end as h, month(o_orderdate) as m, day(o_orderdate) as d from orders)
select o_orderkey, case k when 0 then 'quarter' when 1 then 'half_year' when 2 then 'fiscal_year' when 3 then 'as_of' when 4 then 'period_end' when 5 then 'calendar_year' when 6 then 'relative' when 7 then 'fiscal_year' end as kind,
    case when k in (0, 1, 2, 3, 4, 5, 7) then y end as year, case when k = 0 then q end as quarter, case when k = 1 then cast(h as bigint) end as half,
    case when k in (3, 4) then m end as month, case when k in (3, 4) then d end as day, case when k = 0 then 'Q' || q || ' ' || y end as quarter_name from o"""

ORACLES["f13_compare_periods"] = """
select o_orderkey, case o_orderkey % 6 when 0 then 'same' when 1 then 'different' when 2 then 'overlapping' when 3 then 'overlapping' else 'unknown' end as relation from orders"""

ORACLES["f15_compare_scopes"] = """
with expected(a, b, relation, dimension) as (values
    (0, 0, 'same', 'scope'), (0, 1, 'same', 'scope'), (0, 2, 'different', 'scope'), (0, 3, 'different', 'scope'), (0, 4, 'different', 'scope'),
    (1, 0, 'different', 'scope'), (1, 1, 'different', 'scope'), (1, 2, 'different', 'scope'), (1, 3, 'different', 'scope'), (1, 4, 'different', 'scope'),
    (2, 0, 'different', 'scope'), (2, 1, 'different', 'scope'), (2, 2, 'same', 'basis'), (2, 3, 'different', 'scope'), (2, 4, 'different', 'scope'),
    (3, 0, 'different', 'scope'), (3, 1, 'different', 'scope'), (3, 2, 'different', 'scope'), (3, 3, 'overlapping', 'scope'), (3, 4, 'different', 'scope'),
    (4, 0, 'unknown', 'scope'), (4, 1, 'unknown', 'scope'), (4, 2, 'unknown', 'scope'), (4, 3, 'unknown', 'scope'), (4, 4, 'unknown', 'scope'))
select n_nationkey, relation, dimension from nation join expected on a = n_nationkey % 5 and b = n_nationkey // 5"""

ORACLES["f17_hash_text"] = """
select p_partkey, sha256(encode(p_name) || '\\x00'::blob || case when p_partkey % 3 > 0 then encode(p_brand) else ''::blob end || '\\x00'::blob) as hash from part"""

_TOKENS = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 1 and w not in ('the', 'a', 'of'))"
_JACCARD = "case when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end"

ORACLES["f20_jaccard"] = f"""
with k as (select p_partkey, {_TOKENS.format('p_name')} as x, {_TOKENS.format("'The ' || p_type || ' of a ' || string_split(p_name, ' ')[1]")} as y from part)
select p_partkey, round({_JACCARD}, 9) as jaccard from k"""

ORACLES["c1_entity_similarity"] = f"""
with k as (select p_partkey, p_name, 'zz ' || string_split(p_name, ' ')[1] as b, {_TOKENS.format('p_name')} as x, {_TOKENS.format("'zz ' || string_split(p_name, ' ')[1]")} as y from part)
select p_partkey, round(case p_partkey % 4 when 0 then 1.0 when 1 then 0.85 when 2 then {_JACCARD} else 0.0 end, 9) as similarity from k"""

ORACLES["c3_score_pair"] = """
with k as (select p_partkey, p_partkey % 2 = 0 as entity, (p_partkey // 2) % 2 = 0 as lexical, (p_partkey // 4) % 2 = 0 as near, (p_partkey // 8) % 2 = 0 as vec from part)
select p_partkey, array_to_string(list_filter([case when vec then 'embedding' end, case when entity and lexical then 'entity+lexical' end, case when entity and near then 'numeric' end], lambda x: x is not null), '+') as triggers from k"""

ORACLES["f21_grounding"] = """
with d as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat, case doc_id % 4 when 0 then substr(text, 5, 40) when 1 then replace(substr(text, 5, 40), ' ', '  ') when 2 then 'no such quote anywhere' else '' end as q from documents)
select doc_id, case when trim(q, ' ' || chr(10)) = '' then false else contains(text, q) or contains(flat, trim(regexp_replace(q, '\\s+', ' ', 'g'))) end as grounded from d"""

ORACLES["p1_search"] = "select p_partkey, p_name from part where contains(lower(p_name), 'an') or contains(lower(p_type), 'an')"

ORACLES["v4_check_evidence"] = """
with o as (select o_orderkey, o_orderkey % 4 as q, o_orderkey % 5 > 0 as g, o_orderkey % 7 > 0 as has, length(cast(o_orderkey as varchar)) < 12 as short from orders),
s as (select *, case when not has then null when q in (0, 2) then true else false end as supported from o)
select o_orderkey, case when not g then 'ungrounded' when supported is false then 'quote_grounded' when q = 2 and short then 'quote_grounded' else 'fact_validated' end as status, supported as value_supported from s"""

ORACLES["v7_confidence"] = "select c_custkey, case c_custkey % 7 when 0 then 0.5::double when 4 then 1.0::double end as confidence from customer"

ORACLES["v8_v9_judgments"] = """
select c_custkey, case c_custkey % 4 when 0 then true when 1 then false when 3 then true end as same_metric,
    case c_custkey % 6 when 0 then 'reconciled' when 1 then 'corroborates' when 2 then 'contradicts' when 3 then 'unrelated' else 'uncertain' end as relation from customer"""

ORACLES["x_adjudicate"] = """
with l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as b from lineitem group by 1),
p as (select o_orderkey, o_orderkey as k, o_totalprice as a, b from orders left join l on l_orderkey = o_orderkey),
c as (select *, b is not null and k % 13 <> 0 as comparable, case when a = b then 0 else abs(a - b) / greatest(abs(a), abs(b)) * 100 end as diff,
    case when k % 5 = 0 then 'overlapping' when k % 7 = 0 then 'unknown' else 'same' end as per, case when k % 17 = 0 then 'different' else 'same' end as sc, k % 11 = 0 as caveat from p),
f as (select *, comparable and least(abs(a), abs(b)) > 0 and greatest(abs(a), abs(b)) / least(abs(a), abs(b)) >= 100 as suspect from c),
g as (select *, comparable and not suspect and not caveat and diff <= 2 as agree, comparable and not suspect and not caveat and diff > 2 as differ from f),
r as (select *, case when b is not null and not comparable then 1 when comparable and suspect then 2 when comparable and not suspect and caveat then 3
    when agree and per <> 'overlapping' and sc <> 'different' then 4 when differ and per = 'same' and sc = 'same' then 5
    when differ and (per = 'overlapping' or sc = 'different') then 6 when differ and per = 'unknown' then 7 else 8 end as rule from g)
select o_orderkey, cast(rule as bigint) as rule, case rule when 1 then 'related_but_not_comparable' when 2 then 'uncertain' when 3 then 'uncertain' when 4 then 'corroborates' when 5 then 'contradicts' when 6 then 'reconciled' when 7 then 'insufficient_context' else 'corroborates' end as relation_type,
    case rule when 4 then 'deterministic_confirmed' when 8 then 'llm_unchecked' else 'deterministic_override' end as decision_source, rule not in (4, 8) as disagreement, case when rule = 8 then 0.6::double else 1.0::double end as confidence from r"""

ORACLES["flagship_order_reconciliation"] = f"select relation_type, decision_source, count(*) as n from ({ORACLES['x_adjudicate']}) group by 1, 2"

ORACLES["s4_page_selector"] = "select l_linenumber as page_number, count(*) as n from lineitem where l_linenumber in (1, 3, 5, 6) group by 1"

ORACLES["s6_chunks"] = """
with n as (select doc_id, text, case when length(text) <= 1200 then 1 else 1 + cast(ceil((length(text) - 1200) / 1050.0) as bigint) end as n from documents),
e as (select doc_id, text, unnest(range(0, n)) as chunk from n)
select doc_id, chunk, chunk * 1050 as start, md5(substr(text, chunk * 1050 + 1, 1200)) as text_md5, chunk > 0 as has_context from e"""

ORACLES["s7_page_context"] = """
with h as (select doc_id, length(text) as n, substr(text, 1, 260) as head from documents), c as (select *, length(head) - strpos(reverse(head), chr(10)) as cut from h)
select doc_id, md5(trim(case when n > 260 and contains(head, chr(10)) and cut > 40 then substr(head, 1, cut) else head end, ' ' || chr(10))) as context_md5 from c"""

ORACLES["j7_list_documents"] = """
with f as (select o_custkey, count(*) as n from orders group by 1)
select c_custkey as id, coalesce(n, 0) as fact_count from customer left join f on o_custkey = case when c_custkey % 10 = 0 then c_custkey - 1 else c_custkey end"""

ORACLES["a1_corpus_stats"] = """
select * from (select count(*) as documents, count(*) filter (c_acctbal > 0) as documents_done from customer),
    (select count(*) as facts, count(*) filter (o_orderkey % 4 = 0) as ungrounded_facts, count(*) filter (o_orderkey % 4 = 2) as fact_validated, count(*) filter (o_orderkey % 4 = 1) as quote_grounded_only, cast(round(100 * avg(case when o_orderkey % 4 > 0 then 1 else 0 end)) as bigint) as grounded_pct from orders),
    (select count(*) as relationships from supplier), (select count(*) as issues from part where p_size < 10)"""

ORACLES["a4_top_values"] = "select trim(p_brand) as p_brand, count(*) as n from part group by 1 order by n desc, 1 limit 7"
ORACLES["a25_shares"] = "select o_orderstatus, count(*) as n, cast(round(100 * count(*) / sum(count(*)) over ()) as bigint) as pct from orders group by 1"
ORACLES["a24_upper_median"] = "select c_nationkey, list_sort(list(c_acctbal))[count(*) // 2 + 1] as median from customer group by 1"

ORACLES["t_page_layout"] = """
with r as (select r.range as r from range(0, 7) r)
select cast(n_nationkey as bigint) as document_id, case when n_nationkey % 2 = 0 then (select string_agg('w' || r || '0 | w' || r || '1 | w' || r || '2 | w' || r || '3', chr(10) order by r) from r) else 'plain text of ' || n_name end as text,
    case when n_nationkey % 2 = 0 then 'reconstructed' else 'plain_not_tabular' end as table_context from nation"""

_NEAR = """
with v as (select vec_id as id, cast(embedding as double[]) as e from embeddings),
s as (select a.id, b.id as other_id, list_inner_product(a.e, b.e) as score from v a join v b on a.id <> b.id),
n as (select id, other_id, score, row_number() over (partition by id order by score desc, other_id) as rank from s)"""
ORACLES["j1_top_k_similar"] = f"{_NEAR} select id, other_id, rank from n where rank <= 4"
ORACLES["j2_unordered_pairs"] = f"{_NEAR} select distinct least(id, other_id) as lo, greatest(id, other_id) as hi from n where rank <= 4"
ORACLES["e4_recall_at_k"] = f"""{_NEAR}, p as (select * from n where rank <= 20 and rank % 3 = 0)
select cast(k as bigint) as k, count(*) as pairs, count(*) filter (rank <= k) as hits, round(count(*) filter (rank <= k) / count(*), 6) as recall from p, (values (4), (8), (16), (32)) t(k) group by k"""

_GRAPH = """
with recursive c as (select c_custkey as k, c_nationkey as g, c_custkey // 50 as b from customer),
e0 as (select x.k as i, y.k as j, (x.k * 7 + y.k * 3) % 10 as s from c x join c y on x.g = y.g and x.b = y.b and x.k < y.k),
e as (select i * 1000000 + j as id, i, j, s, case (i + j) % 7 when 0 then 'corroborates' when 1 then 'corroborates' when 2 then 'reconciled' when 3 then 'corroborates' when 4 then 'contradicts' when 5 then 'unrelated' else 'uncertain' end as relation_type,
    s / 10 as conf, s % 3 as src from e0),
q as (select *, case when relation_type = 'corroborates' then 'E' else 'N' end as kind from e where relation_type in ('corroborates', 'contradicts', 'reconciled')),
tri as (select x.i as a, x.j as b, y.j as c, [x, y, z] as es from q x join q y on y.i = x.j join q z on z.i = x.i and z.j = y.j),
vio as (select a, b, c, es, list_min(list_transform(es, lambda x: x.conf)) as lo, list_max(list_transform(es, lambda x: x.conf)) as hi from tri where len(list_filter(es, lambda x: x.kind = 'E')) = 2),
imp as (select distinct unnest(list_transform(es, lambda x: x.id)) as edge_id from vio)"""
ORACLES["g1_violations"] = f"""{_GRAPH}
select a, b, c, case when lo = hi then list_min(list_transform(es, lambda x: x.id)) else list_min(list_transform(list_filter(es, lambda x: x.conf = lo), lambda x: x.id)) end as suspect_edge_id,
    case when lo = hi then 'undetermined' else 'least_confident' end as basis, len(list_filter(es, lambda x: x.relation_type = 'corroborates' and x.src <> 0)) = 0 as is_strict_proof from vio"""
ORACLES["g3_inferences"] = f"""{_GRAPH},
b as (select i as x, j as via, id, kind, relation_type, conf from q union all select j, i, id, kind, relation_type, conf from q),
w as (select least(l.x, r.x) as b, greatest(l.x, r.x) as c, l.via, case when r.kind = 'E' then 'corroborates' else r.relation_type end as relation_type, round(least(l.conf, r.conf), 3) as confidence, l.id as e1, r.id as e2
    from b l join b r on l.via = r.via and l.kind = 'E' and l.x <> r.x and (r.kind = 'N' or l.x < r.x)),
o as (select *, row_number() over (partition by b, c order by via, relation_type, confidence) as n from w where not exists (select 1 from q where q.i = w.b and q.j = w.c))
select b, c, relation_type, via, confidence from o where n = 1 and e1 not in (select edge_id from imp) and e2 not in (select edge_id from imp)"""
ORACLES["g8_coherence_summary"] = f"""{_GRAPH}
select (select count(*) from q) as edges, (select count(distinct n) from (select i as n from q union all select j from q)) as nodes, (select count(*) from tri) as triangles_checked, (select count(*) from vio) as violations,
    (select count(*) from imp) as implicated_edges, round((select count(*) from vio) / (select count(*) from tri), 6) as violation_rate"""

ORACLES["w4_best_edge"] = """
with e as (select o_orderkey as id, o_custkey % 20 as a, o_orderkey % 20 as b, case o_orderkey % 3 when 0 then 'E' when 1 then 'N' end as kind, case when o_orderkey % 5 > 0 then (o_orderkey % 97) / 100 else 0.5 end as conf from orders),
r as (select least(a, b) as lo, greatest(a, b) as hi, id, kind, row_number() over (partition by least(a, b), greatest(a, b) order by conf desc, id) as n from e where a <> b and kind is not null)
select lo, hi, id, kind from r where n = 1"""

ORACLES["g10_components"] = """
with recursive e as (select s_suppkey as a, case s_suppkey % 4 when 0 then s_suppkey when 1 then s_suppkey + 1 else s_suppkey // 3 end as b from supplier),
u as (select a, b from e where a <> b union select b, a from e where a <> b),
r as (select a as node, a as reach from u union select r.node, u.b from r join u on u.a = r.reach)
select node, min(reach) as component from r group by 1"""

ORACLES["j16_graph_view"] = f"{_GRAPH}, d as (select n, count(*) as degree from (select i as n from e union all select j from e) group by 1) select c_custkey as id, coalesce(degree, 0) as degree from customer left join d on n = c_custkey"
ORACLES["a6_cross_document_edges"] = f"{_GRAPH} select count(*) filter (i % 3 <> j % 3) as cross_document from e"

_LEVEL = "case when score >= 80 then 'critical' when score >= 35 then 'high' when score >= 15 then 'medium' else 'low' end"
ORACLES["r2_relationships"] = f"""{_GRAPH},
sc as (select id, cast(case when id in (select edge_id from imp) then 100 else 0 end + case relation_type when 'contradicts' then 40 + case when conf >= 0.85 then 10 else 0 end when 'uncertain' then 25 when 'reconciled' then 4 else 0 end + case when s = 3 then 35 else 0 end as double) as score from e)
select id, score, {_LEVEL} as level from sc"""
_R3 = f"""{_GRAPH},
ends as (select id, relation_type, i as n from e union all select id, relation_type, j from e),
cnt as (select n, count(*) as degree, count(*) filter (relation_type = 'contradicts') as contra, count(*) filter (id in (select edge_id from imp)) as hit from ends group by 1),
sc as (select c_custkey as id, cast(case c_custkey % 4 when 1 then 30 when 2 then 15 else 0 end + case when c_custkey % 11 = 0 then 35 else 0 end + 80 * least(coalesce(hit, 0), 2) + 20 * least(coalesce(contra, 0), 3) + case when coalesce(degree, 0) >= 5 then 5 else 0 end as double) as score from customer left join cnt on n = c_custkey)"""
ORACLES["r3_facts"] = f"{_R3} select id, score, {_LEVEL} as level from sc"
ORACLES["a10_level_counts"] = f"{_R3} select {_LEVEL} as level, count(*) as n from sc group by 1"

_TRIPLES = """
with f as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as g, l_quantity * case when l_linenumber % 3 = 0 then 1000 else 1 end as v, l_linenumber % 3 = 0 as big, row_number() over (partition by l_orderkey order by l_linenumber) as i
    from (select l_orderkey, l_linenumber, min(l_quantity) as l_quantity from lineitem group by 1, 2) where l_orderkey % 10 <> 0 and l_quantity <> 0),
tr as (select a.id as a_id, b.id as b_id, c.id as c_id, a.v as av, b.v as bv, c.v as cv, a.big as ab, b.big as bb, c.big as cb, a.i as ai, b.i as bi, c.i as ci, abs(a.v + b.v - c.v) as gap
    from f a join f b on a.g = b.g and a.i < b.i join f c on c.g = a.g and c.i <> a.i and c.i <> b.i where a.v + b.v <> 0),
m as (select *, gap / abs(cv) * 100 <= 0.5 and gap / least(abs(av), abs(bv)) * 100 <= 5 as holds from tr),
k as (select *, row_number() over (partition by holds, list_sort([a_id, b_id, c_id]) order by ai, bi, ci) as n from m where holds or ((ab <> bb or bb <> cb) and list_bool_or(list_transform([-9,-8,-7,-6,-5,-4,-3,-2,-1,1,2,3,4,5,6,7,8,9], lambda x: abs(abs((av + bv) / cv) / pow(10.0, x) - 1) <= 0.005))))"""
ORACLES["g14_identities"] = f"{_TRIPLES} select a_id, b_id, c_id, round(gap / abs(cv) * 100, 2) as error_pct from k where holds and n = 1"
ORACLES["g18_scale_anomalies"] = f"""{_TRIPLES} select a_id, b_id, c_id, round(pow(10.0, round(log10(abs((av + bv) / cv)))), 4) as factor, case when ab <> bb and ab <> cb then a_id when bb <> ab and bb <> cb then b_id else c_id end as suspect_id from k where not holds and n = 1"""

ORACLES["a11_arithmetic_groups"] = """
with g as (select year(o_orderdate), o_custkey % 50, count(*) as n from orders where o_orderkey % 4 <> 0 group by 1, 2)
select count(*) filter (n >= 3) as groups_checked, count(*) filter (n > 60) as groups_truncated, cast(sum(n) as bigint) as facts_considered from g"""

ORACLES["g9_timelines"] = """
with f as (select c_nationkey as n, year(o_orderdate) as y, count(*)::double as v from orders join customer on o_custkey = c_custkey group by 1, 2),
p as (select n, y, v, lag(v) over (partition by n order by y) as prev, count(*) over (partition by n) as n_points, min(y) over (partition by n) as y0 from f)
select cast(n * 10000 + y0 as bigint) as timeline, cast(n * 10000 + y as bigint) as fact_id, 'FY' || y as period_label, v as value, case when prev <> 0 then round((v - prev) / abs(prev) * 100, 2) end as pct_change, n_points from p where n_points >= 2"""

_LABELS = "with l as (select 'c' || quality as expected, 'c' || toxic as predicted, quality = 1 as e, toxic = 1 as p from labels)"
_CLASS = f"""{_LABELS}, u as (select expected as label, 1 as s, 0 as p, case when expected = predicted then 1 else 0 end as t from l union all select predicted, 0, 1, 0 from l),
k as (select label, cast(sum(s) as bigint) as support, cast(sum(p) as bigint) as predicted, cast(sum(t) as bigint) as tp from u group by 1),
m as (select *, case when predicted > 0 then tp / predicted end as pr, case when support > 0 then tp / support end as rc from k),
z as (select *, case when pr > 0 and rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f from m)"""
ORACLES["a16_confusion"] = f"{_LABELS} select expected, predicted, count(*) as n from l group by 1, 2"
ORACLES["a17_per_class"] = f"{_CLASS} select label, support, predicted, tp, round(pr, 6) as precision, round(rc, 6) as recall, round(f, 6) as f1 from z"
ORACLES["a18_macro"] = f"{_CLASS} select round(coalesce(avg(pr) filter (support >= 3), 0), 6) as macro_precision, round(coalesce(avg(rc) filter (support >= 3), 0), 6) as macro_recall, round(coalesce(avg(f) filter (support >= 3), 0), 6) as macro_f1 from z"
ORACLES["a20_binary"] = f"""{_LABELS}, c as (select count(*) filter (e and p) as tp, count(*) filter (not e and p) as fp, count(*) filter (e and not p) as fn, count(*) filter (not e and not p) as tn from l),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as rc from c)
select tp, fp, fn, tn, round(pr, 6) as precision, round(rc, 6) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end, 6) as f1 from r"""

ORACLES["e1_categories"] = """
select c_custkey, case c_custkey % 7 when 0 then case when (c_custkey // 7) % 2 = 0 then 'EXACT_CORROBORATION' else 'SEMANTIC_CORROBORATION' end when 1 then 'CONTRADICTION' when 2 then 'CONTEXTUAL_RECONCILIATION' when 3 then 'UNRELATED' when 4 then 'UNCERTAIN' when 5 then 'RELATED_NOT_COMPARABLE' else 'INSUFFICIENT_CONTEXT' end as category from customer"""

ORACLES["e6_root_causes"] = f"""
with r as (select c_custkey as k, {_pick('c_custkey', *_s('CONTRADICTION', 'UNRELATED', 'UNCERTAIN'))} as x, {_pick('c_custkey // 3', *_s('UNCERTAIN', 'CONTRADICTION'))} as y, {_pick('c_custkey // 6', *_s('llm_unchecked', 'deterministic_override'))} as src from customer)
select case when k % 5 = 0 and k % 2 = 0 then 'unit_normalization' when k % 7 = 0 then 'context_ambiguity' when y = 'UNCERTAIN' and x <> 'UNCERTAIN' then 'safe_but_imprecise_hedge' when src = 'llm_unchecked' then 'llm_semantic' when x = 'UNRELATED' then 'metric_matching' else 'other' end as root_cause, count(*) as n from r where x <> y group by 1"""

ORACLES["a22_audit"] = f"""{_GRAPH},
st as (select id, relation_type, case id % 4 when 1 then 'unrelated' when 2 then 'contradicts' when 3 then relation_type end as fresh from e where relation_type <> 'unrelated')
select count(*) as audited, count(*) filter (fresh = relation_type) as kept, count(*) filter (fresh <> 'unrelated' and fresh <> relation_type) as relabelled, count(*) filter (fresh is null or fresh = 'unrelated') as dropped from st"""

ORACLES["i_windowed_events"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2"
