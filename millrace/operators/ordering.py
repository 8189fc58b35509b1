"""Sorts, limits and set operations. Nulls come last in either direction unless the query says otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.catalogue import Query, frame, same

QUERIES: dict[str, Query] = {
    "sort_columns": frame(lambda n: n.orderBy(F.asc_nulls_last("n_regionkey"), F.desc_nulls_last("n_name")), "select * from nation order by n_regionkey, n_name desc", "nation"),
    "sort_nulls": same("select n_nationkey, nullif(n_regionkey, 2) as k from nation order by k desc nulls last, n_nationkey limit 21"),
    "sort_ordinal": same("select n_regionkey, n_name from nation order by 1 desc nulls last, 2 nulls last limit 9"),
    "sort_expr": same("select o_orderkey from orders order by o_totalprice % 1000 desc nulls last, o_orderkey limit 12"),
    "sort_hidden_col": same("select c_name from customer order by c_acctbal nulls last, c_custkey limit 15"),
    "sort_alias": same("select o_orderkey, o_totalprice * 2 as twice from orders order by twice desc nulls last, o_orderkey limit 5"),
    "limit": same("select n_name from nation order by n_name limit 4"),
    "offset": same("select n_name from nation order by n_name limit 4 offset 20"),
    "topk": frame(lambda o: o.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(15).offset(5), "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 10 offset 5", "orders"),
    "distinct_on": same("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) as rn from orders) t where rn = 1"),
    "topk_revenue": frame(
        lambda c, o, l: c.filter("c_mktsegment = 'BUILDING'").join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc_nulls_last("revenue"), "o_orderkey").limit(10),
        "select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by o_orderkey, o_orderdate order by revenue desc nulls last, o_orderkey limit 10", "customer", "orders", "lineitem"),
    "set_union_all": frame(lambda c, s: c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")), "select c_nationkey as k from customer union all select s_nationkey from supplier", "customer", "supplier"),
    "set_union": same("select n_regionkey as k, 'n' as s from nation union select r_regionkey, 'n' from region"),
    "set_intersect": same("select l_partkey as k from lineitem where l_quantity > 45 intersect select l_partkey from lineitem where l_quantity < 3"),
    "set_intersect_all": same("select c_nationkey as k from customer intersect all select s_nationkey from supplier"),
    "set_except": same("select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 200000"),
    "set_except_all": same("select o_custkey as k from orders except all select c_custkey from customer"),
    "set_order_limit": same("select n_name as x from nation union all select r_name from region order by x desc nulls last limit 6 offset 1"),
    "set_nested": same("(select n_nationkey as k from nation union all select r_regionkey from region) except (select s_nationkey from supplier where s_acctbal < 0 intersect select c_nationkey from customer)"),
}
