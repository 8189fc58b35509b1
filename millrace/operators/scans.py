"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.catalogue import Query, frame, pair, same
from millrace.plans.text import VERSION

QUERIES: dict[str, Query] = {
    "scan_table": frame(lambda n: n, "select * from nation", "nation"),
    "scan_filtered": frame(lambda o: o.filter(F.col("o_totalprice") > 300000).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders where o_totalprice > 300000", "orders"),
    "scan_eq_fast": frame(lambda c: c.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'", "customer"),
    "scan_cte": same("with nation as (select r_regionkey as k, r_name as n from region) select k, n from nation"),
    "scan_subquery": same("select s.k, s.n from (select n_regionkey as k, count(*) as n from nation group by n_regionkey) s where s.n > 2"),
    "scan_no_from": same("select 1 as one, 'a' as a, cast(null as bigint) as nothing"),
    "source_values": same("select k, v from (values (1, 'a'), (2, 'b'), (3, cast(null as varchar(10)))) as t(k, v)"),
    "schema_qualified": pair("select public.region.r_name from public.region", "select r_name from region"),
    "sink_result": frame(lambda r: r.select(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name").alias("line")), "select r_regionkey || '|' || r_name as line from region", "region"),
    "file_segment_read": frame(lambda p: p.select("p_partkey", "p_size"), "select p_partkey, p_size from part", "part"),
    "zone_map": frame(lambda o: o.filter(F.col("o_orderkey").between(100, 200)).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")), "select count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from orders where o_orderkey between 100 and 200", "orders"),
    "wire_extended": pair("select n_name from nation where n_regionkey = :r and n_name <> :x", "select n_name from nation where n_regionkey = 1 and n_name <> 'NATION_1'", {"r": 1, "x": "NATION_1"}),
    "system_funcs": pair("select version() as v, current_database() as d, current_schema() as s", f"select '{VERSION}' as v, 'millrace' as d, 'public' as s"),
    "project_columns": frame(lambda c: c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "select c_custkey as id, c_name as name from customer", "customer"),
    "project_star": same("select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey"),
    "project_expr": same("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_quantity + 1 as q from lineitem"),
    "filter_where": same("select c_custkey from customer where c_acctbal > 0 and nullif(c_nationkey, 3) < 10"),
    "pred_compare": same("select n_nationkey, n_nationkey = 3 as eq, n_nationkey <> 3 as ne, n_nationkey < 3 as lt, n_nationkey > 3 as gt, n_nationkey <= 3 as le, n_nationkey >= 3 as ge from nation"),
    "pred_and_or_not": same("select n_nationkey, (nullif(n_nationkey, 1) > 5 and n_regionkey = 1) as a, (nullif(n_nationkey, 1) > 5 or n_regionkey = 1) as o, not (nullif(n_nationkey, 1) > 5) as x from nation"),
    "pred_is_null": same("select n_nationkey, nullif(n_regionkey, 2) is null as a, nullif(n_regionkey, 2) is not null as b from nation"),
    "pred_in_list": same("select n_name, n_nationkey not in (1, 2, cast(null as int)) as x from nation where n_nationkey in (1, 2, 3, 4)"),
    "pred_between": same("select l_orderkey, l_linenumber from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 5 and l_linenumber not between 2 and 3"),
    "pred_like": pair(r"select p_partkey from part where p_name like '%ring' and p_type not like 'E_ON%' and p_brand like 'Brand\#_' escape '\\'".replace(r"\#", "#").replace(r" escape '\\'", ""), "select p_partkey from part where p_name like '%ring' and p_type not like 'E_ON%' and p_brand like 'Brand#_'"),
    "pred_ilike": same("select p_partkey from part where p_name ilike '%A%' and p_type not ilike 'x%'"),
    "pred_bool_const": same("select r_name, true as t, false as f from region where true"),
}
