"""Joins. Equi keys go to hash or sort-merge joins, broadcast where statistics prove a side small."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.catalogue import Query, frame, same
from millrace.operators.ranges import range_join

QUERIES: dict[str, Query] = {
    "join_inner_hash": frame(lambda c, o: c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey"), "select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey", "customer", "orders"),
    "join_left_hash": frame(
        lambda c, o: c.join(o.filter("o_totalprice > 200000"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")),
        "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 group by c_custkey", "customer", "orders"),
    "join_right_hash": same("select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey"),
    "join_full_hash": frame(lambda s, p: s.join(p, s.s_suppkey == p.p_partkey, "full").select("s_suppkey", "p_partkey"), "select s_suppkey, p_partkey from supplier full join part on s_suppkey = p_partkey", "supplier", "part"),
    "join_null_keys": same("select a.n_nationkey as a, b.n_nationkey as b from (select n_nationkey, nullif(n_regionkey, 1) as k from nation) a left join (select n_nationkey, nullif(n_regionkey, 1) as k from nation) b on a.k = b.k"),
    "join_theta_nlj": same("select a.n_nationkey as a, b.r_regionkey as b from nation a left join region b on a.n_regionkey < b.r_regionkey or a.n_nationkey = b.r_regionkey * 2"),
    "join_multi_key": same("select l.l_orderkey, l.l_linenumber, m.l_partkey from lineitem l join lineitem m on l.l_orderkey = m.l_orderkey and l.l_linenumber = m.l_linenumber and l.l_quantity > 49"),
    "join_range": frame(
        lambda a, b: range_join(b, F.col("s_acctbal"), a, F.col("n_nationkey") * 100.0, F.col("n_nationkey") * 100.0 + 500, 500).agg(F.count("*").alias("n")),
        "select count(*) as n from nation a join supplier b on b.s_acctbal between a.n_nationkey * 100.0 and a.n_nationkey * 100.0 + 500", "nation", "supplier"),
    "join_cross": frame(lambda r, n: r.crossJoin(n).select("r_name", "n_name"), "select r_name, n_name from region cross join nation", "region", "nation"),
    "join_comma": same("select n_name, r_name, s_name from nation, region, supplier where n_regionkey = r_regionkey and s_nationkey = n_nationkey"),
    "join_multiway": same("select c_custkey, n_name, r_name, o_orderkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey where o_totalprice > 250000"),
    "join_self": frame(lambda n: n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")), "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "nation"),
    "join_derived": same("with t as (select o_custkey, max(o_totalprice) as m from orders group by o_custkey) select c_name, t.m, d.n from customer join t on c_custkey = t.o_custkey join (select c_nationkey as k, count(*) as n from customer group by c_nationkey) d on d.k = c_nationkey"),
    "join_using": same("select k, a.x, b.y from (select n_regionkey as k, n_nationkey as x from nation) a join (select r_regionkey as k, r_name as y from region) b using (k)"),
    "join_natural": same("select k, x, y from (select n_regionkey as k, n_nationkey as x from nation) a natural join (select r_regionkey as k, r_name as y from region) b"),
    "join_lateral": same("select r_name, t.m from region, lateral (select max(n_nationkey) as m from nation where n_regionkey = r_regionkey) t"),
    "semi_in": same("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)"),
    "semi_exists": frame(lambda c, o: c.join(o.filter("o_totalprice > 250000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey"), "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)", "customer", "orders"),
    "anti_not_exists": frame(lambda c, o: c.join(o.filter("o_totalprice > 250000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"), "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)", "customer", "orders"),
    "anti_not_in": same("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)"),
}
