"""Views that give the driver's tables the shapes the operators read.

Each view is column arithmetic over whole tables. The same text serves both engines, with the type
name ``string`` swapped and table names in braces.
"""

from __future__ import annotations

import re

VIEWS = {
    "judgments": """
select cast(l_partkey as string) as item_id,
  concat('j', cast(l_suppkey % 4 as string)) as judge,
  case l_returnflag when 'A' then 'vague' when 'N' then 'rubric' else 'cot' end as config,
  case l_linenumber % 5 when 0 then 'omission' when 1 then 'fabrication'
    when 2 then 'numeric_swap' when 3 then 'topic_drift' else 'hedging' end as degradation,
  case l_orderkey % 3 when 0 then cast(0.2 as double) when 1 then cast(0.5 as double)
    else cast(0.9 as double) end as severity,
  row_number() over (partition by l_partkey, l_suppkey % 4, l_returnflag
    order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_shipdate) - 1 as replicate,
  case when l_quantity < 5 then null else l_quantity / 5 end as score,
  cast(l_quantity * 20 as int) as prompt_tokens,
  cast(l_quantity * 3 as int) as completion_tokens,
  l_extendedprice / 100 as latency_ms,
  1 + cast(l_discount * 10 as double) as len_ratio,
  case when l_tax >= 0.08 then 'TimeoutError: slow' when l_tax <= 0.005 then 'QuotaExhaustedError: day'
    else '' end as error,
  l_shipdate as ts
from {lineitem}""",
    "reference_scores": """
select cast(p_partkey as string) as item_id, concat('j', cast(n as string)) as judge,
  case when (p_partkey + n) % 29 = 0 then null
    else cast((p_partkey * 7 + n * 13) % 91 as double) / 10 + 1 end as score,
  cast(40 + p_size as int) as prompt_tokens, cast(p_size as int) as completion_tokens
from (select p_partkey, p_size, <each 0, 1, 2, 3> as n from {part}) j""",
    "pair_raw": """
select cast(o_orderkey as string) as uid, concat('j', cast(o_custkey % 4 as string)) as judge,
  o_orderpriority as degradation, cast(o_custkey % 20 as string) as source_id,
  case o_orderkey % 3 when 0 then cast(0.2 as double) when 1 then cast(0.5 as double)
    else cast(0.9 as double) end as severity,
  case o_orderkey % 5 when 0 then 'VERDICT: B' when 1 then 'verdict: tie' when 2 then 'no opinion'
    else 'VERDICT: A' end as fwd_text,
  case (o_orderkey + o_custkey) % 4 when 0 then 'VERDICT: A'
    when 1 then '<think>A</think>VERDICT: B' else 'Answer B is better' end as rev_text,
  cast(100 + o_custkey % 50 as int) as prompt_tokens,
  cast(10 + o_orderkey % 40 as int) as completion_tokens,
  o_totalprice / 1000 as latency_ms
from {orders}""",
    "order_items": """
select cast(o_orderkey as string) as item_id, o_orderpriority as domain,
  cast(o_totalprice as decimal(15,2)) as price, o_orderstatus as status,
  count(*) as n_lines, cast(sum(l_quantity) as bigint) as qty,
  cast(max(l_discount) as decimal(6,2)) as max_disc, cast(max(l_tax) as decimal(6,2)) as max_tax
from {orders} join {lineitem} on o_orderkey = l_orderkey
group by o_orderkey, o_orderpriority, o_totalprice, o_orderstatus""",
    "trace_calls": """
select cast(conv_id as string) as trace_id, turn + 1 as step,
  case turn % 5 when 0 then 'lookup' when 1 then 'unit_convert' when 2 then 'date_diff'
    when 3 then 'calculator' else 'web_search' end as tool,
  case turn % 5 when 0 then 'key' when 1 then 'value' when 2 then 'd1' when 3 then 'expr'
    else 'query' end as name1,
  case turn % 5 when 0 then (case when conv_id % 2 = 0 then 'fleet_size' else 'no_such_key' end)
    when 1 then cast(conv_id % 7 as string) when 2 then '2026-01-01'
    when 3 then concat(cast(conv_id as string), ' * 2.5 + ', cast(conv_id % 9 as string))
    else 'q' end as arg1,
  case turn % 5 when 1 then 'frm' when 2 then 'd2' else null end as name2,
  case turn % 5 when 1 then 'kg'
    when 2 then (case when conv_id % 4 = 3 then '2026-02-30' else '2026-03-01' end)
    else null end as arg2,
  case turn % 5 when 1 then 'to' else null end as name3,
  case turn % 5 when 1 then (case when conv_id % 3 = 0 then 'LB' else 't' end) else null end as arg3,
  case turn % 5 when 0 then '58'
    when 1 then (case conv_id % 7 when 3 then '6.6139' when 5 then ' 0.005' else '0' end)
    when 2 then (case when conv_id % 3 = 0 then '60' else '59' end)
    when 3 then (case when conv_id % 8 = 0 then '20' else '12.5' end) else 'x' end as recorded,
  conv_id % 5 as answer_kind, length(text) as weight
from {conversations}""",
    "student": """
select cast(d.doc_id as string) as uid, d.source as item_group, d.text as answer,
  d.lang as degradation, l.quality as teacher_label, 1 - l.toxic as truth_label,
  cast((d.doc_id * 37 + l.quality * 300) % 1000 as double) / 1000 as p
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "requests": """
select event_id, event_type as endpoint, value as ms, event_type = 'error' as is_error, ts
from {events}""",
    "models": """
select concat('provider', cast(s_suppkey % 4 % 3 as string)) as provider,
  concat('model-', cast(s_suppkey % 4 as string)) as id,
  concat('j', cast(s_suppkey % 4 as string)) as alias,
  concat('f', cast(s_suppkey % 4 % 3 as string)) as family,
  case when s_suppkey % 4 in (0, 2) then 'open-weight' else 'frontier' end as tier,
  s_suppkey % 4 = 2 as reasoning,
  cast(2 + s_suppkey % 4 as double) as rpm, cast(900 as double) as tpm,
  cast(count(*) * 3 as int) as rpd,
  cast(0.05 * (1 + s_suppkey % 4) as double) as usd_per_mtok_in,
  cast(0.2 * (1 + s_suppkey % 4) as double) as usd_per_mtok_out,
  cast(0.1 * (1 + s_suppkey % 4) as double) as list_usd_per_mtok_in,
  cast(0.4 * (1 + s_suppkey % 4) as double) as list_usd_per_mtok_out
from {supplier} group by s_suppkey % 4""",
    "generated": """
select cast(l_orderkey as string) as item_id, concat('j', cast(l_suppkey % 4 as string)) as judge,
  concat('j', cast(l_linenumber % 4 as string)) as generator, max(l_quantity) / 5 as score
from {lineitem} group by l_orderkey, l_suppkey % 4, l_linenumber % 4""",
    "evidence_pairs": """
select cast(o_orderkey as string) as id, cast(o_custkey % 20 as string) as source_id,
  o_orderstatus as question, o_orderpriority as context, 'right' as reference, 'wrong' as candidate
from {orders}""",
    "evidence_log": """
select cast(o_orderkey as string) as pair_id, cast(o_custkey % 20 as string) as source_id, case n when 0 then 'reference' else 'candidate' end as role,
  case when (o_orderkey + n) % 17 = 0 then 'no number'
    else concat('SCORE: ', cast(1 + (o_orderkey * 3 + o_custkey * (1 + n)) % 10 as string)) end
    as text,
  case when (o_orderkey + n) % 17 = 0 then null
    else cast(1 + (o_orderkey * 3 + o_custkey * (1 + n)) % 10 as double) end as score,
  cast(o_orderkey % 300 as int) as prompt_tokens, cast(o_custkey % 60 as int) as completion_tokens,
  concat('served-', cast(o_custkey % 3 as string)) as model_served,
  o_orderkey % 1013 = 5 as simulated, false as cached,
  case when o_orderkey % 907 = 3 then 'length' else 'stop' end as finish_reason,
  o_orderdate as created_at
from (select o_orderkey, o_custkey, o_orderdate, <each 0, 1> as n from {orders}) r
where o_orderkey % 19 <> 7 or n = 0""",
}

BRACED = re.compile(r"\{(\w+)\}")
EACH = re.compile(r"<each ([^>]+)>")


def spark_text(name: str) -> tuple[str, list[str]]:
    text = EACH.sub(r"explode(array(\1))", VIEWS[name])
    return text, sorted(set(BRACED.findall(text)))


def oracle_text(name: str) -> str:
    text = EACH.sub(r"unnest([\1])", VIEWS[name])
    return BRACED.sub(r"\1", text).replace("as string)", "as varchar)")


def with_views(names: list[str], sql: str) -> str:
    """The SQL with its fixture views inlined as common table expressions."""
    if not names:
        return sql
    parts = [f"fx_{n} as ({oracle_text(n)}\n)" for n in names]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
