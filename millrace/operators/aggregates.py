"""Aggregation: partial before the shuffle and final after it, whatever the grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.catalogue import Query, frame, pair, same

QUERIES: dict[str, Query] = {
    "agg_global": same("select count(*) as n, max(o_totalprice) as hi, min(o_orderkey) as lo from orders where o_totalprice < 0"),
    "agg_group_by": frame(
        lambda l: l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi")),
        "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q, round(avg(l_discount), 6) as d, min(l_tax) as lo, max(l_tax) as hi from lineitem group by l_returnflag, l_linestatus", "lineitem"),
    "agg_group_null": same("select nullif(n_regionkey, 2) as k, count(*) as n from nation group by nullif(n_regionkey, 2)"),
    "agg_count_star": frame(lambda o: o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "select o_orderstatus, count(*) as n from orders group by o_orderstatus", "orders"),
    "agg_count": same("select n_regionkey, count(nullif(n_nationkey, 3)) as n from nation group by n_regionkey"),
    "agg_count_distinct": frame(lambda o: o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n")), "select o_orderpriority, count(distinct o_custkey) as n from orders group by o_orderpriority", "orders"),
    "agg_sum": pair("select l_returnflag, sum(l_linenumber) as s, sum(l_orderkey) as k from lineitem group by l_returnflag", "select l_returnflag, sum(l_linenumber)::bigint as s, sum(l_orderkey)::bigint as k from lineitem group by l_returnflag"),
    "agg_sum_distinct": pair("select l_returnflag, sum(distinct l_linenumber) as s from lineitem group by l_returnflag", "select l_returnflag, sum(distinct l_linenumber)::bigint as s from lineitem group by l_returnflag"),
    "agg_avg": same("select l_suppkey, avg(l_linenumber) as a, avg(distinct l_linenumber) as d from lineitem group by l_suppkey"),
    "agg_min": same("select o_orderstatus, min(o_totalprice) as p, min(o_orderpriority) as t, min(o_orderkey) as k from orders group by o_orderstatus"),
    "agg_max": same("select o_orderstatus, max(o_totalprice) as p, max(o_orderpriority) as t, max(o_orderkey) as k from orders group by o_orderstatus"),
    "agg_string_agg": pair("select n_regionkey, string_agg(n_nationkey::text order by n_nationkey::text) as names, (select string_agg(n_name) from nation where n_nationkey = 3) as one from nation group by n_regionkey", "select n_regionkey, string_agg(n_nationkey::varchar, ', ' order by n_nationkey::varchar) as names, 'NATION_3' as one from nation group by n_regionkey"),
    "agg_string_agg_ordered": pair("select n_regionkey, string_agg(n_name, ',' order by n_name desc) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name desc) as names from nation group by n_regionkey"),
    "agg_bool_and": same("select c_mktsegment, bool_and(c_acctbal > -900) as a from customer group by c_mktsegment"),
    "agg_bool_or": same("select c_mktsegment, bool_or(c_acctbal > 9900) as o, bool_or(cast(null as boolean)) as x from customer group by c_mktsegment"),
    "agg_expr_arg": frame(lambda l: l.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("s")), "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as s from lineitem group by l_returnflag", "lineitem"),
    "agg_having": same("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15 and (max(o_totalprice) > 100000 or o_custkey = 1)"),
    "agg_order_by": same("select o_orderpriority, count(*) as n from orders group by o_orderpriority order by count(*) desc, 1"),
    "agg_limit": same("select o_custkey, count(*) as n from orders group by o_custkey order by n desc nulls last, o_custkey limit 7 offset 2"),
    "agg_distinct_rows": same("select distinct count(*) as n from customer group by c_nationkey"),
    "agg_over_join": same("select r_name, count(*) as n, round(sum(s_acctbal), 2) as b from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name"),
    "distinct_rows": frame(lambda l: l.select("l_returnflag", "l_linestatus").distinct(), "select distinct l_returnflag, l_linestatus from lineitem", "lineitem"),
    "agg_rollup": same("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)"),
    "agg_cube": same("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)"),
    "agg_grouping_sets": same("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())"),
    "agg_filter": same("select o_orderstatus, count(*) filter (where o_totalprice > 200000) as n, max(o_orderkey) filter (where o_custkey < 100) as k from orders group by o_orderstatus"),
}
