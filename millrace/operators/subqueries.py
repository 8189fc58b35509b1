"""Subqueries and common table expressions; Catalyst turns them into joins."""

from __future__ import annotations

from millrace.operators.catalogue import Query, pair, same

QUERIES: dict[str, Query] = {
    "subq_scalar": same("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)"),
    "subq_scalar_corr": same("select c_custkey, (select round(max(o_totalprice), 2) from orders where o_custkey = c_custkey) as m from customer"),
    "subq_in": same("select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)"),
    "subq_not_in": same("select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 2)"),
    "subq_exists": same("select n_name from nation where exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > n_nationkey * 300)"),
    "subq_not_exists": same("select n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey)"),
    "subq_any": pair(
        "select o_orderkey from orders o where o_totalprice < any (select n_nationkey * 15000.0 from nation)",
        "select o_orderkey from orders o where o_totalprice < any (select n_nationkey * 15000.0 from nation)"),
    "subq_all": pair(
        "select o_orderkey from orders o where o_totalprice >= all (select o_totalprice from orders i where i.o_custkey = o.o_custkey)",
        "select o_orderkey from orders o where o_totalprice >= all (select o_totalprice from orders i where i.o_custkey = o.o_custkey)"),
    "subq_all_alone": same("select s_suppkey, s_nationkey > all (select n_nationkey from nation where n_regionkey = 3) as a, s_nationkey <= all (select nullif(n_nationkey, 3) from nation) as b, s_nationkey >= any (select n_nationkey from nation where n_nationkey > 99) as c from supplier"),
    "subq_not_in_null": same("select s_suppkey, s_nationkey not in (select nullif(n_nationkey, 3) from nation where n_regionkey < 3) as a, nullif(s_nationkey, 5) not in (select n_nationkey from nation where n_regionkey = 1) as b, nullif(s_nationkey, 5) not in (select n_nationkey from nation where n_regionkey > 9) as c from supplier"),
    "subq_in_select": same("select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 200000) as rich, exists (select 1 from supplier where s_nationkey = c_nationkey) as near from customer"),
    "subq_from": same("select t.k, t.n * 2 as m from (select c_nationkey as k, count(*) as n from customer group by c_nationkey) as t"),
    "cte_basic": same("with t as (select o_custkey, count(*) as n from orders group by o_custkey) select o_custkey, n from t where n > 12"),
    "cte_multi": same("with a as (select n_nationkey, n_name from nation), b as (select s_suppkey, s_nationkey from supplier) select n_name, s_suppkey from a join b on n_nationkey = s_nationkey"),
    "cte_chained": same("with a(k, n) as (select o_custkey, count(*) from orders group by o_custkey), b as (select max(n) as m from a) select k from a join b on n = m"),
    "cte_col_alias": same("with t(x, y) as (select r_regionkey, r_name from region) select y, x from t"),
    "cte_shadow": same("with region as (select n_name from nation) select count(*) as n from region"),
    "cte_scope": same("select (select count(*) from (with region as (select 1 as x) select * from region) t) as a, (select count(*) from region) as b"),
    "cte_reuse": same("with t as (select c_nationkey as k, count(*) as n from customer group by c_nationkey) select a.k, b.n from t a join t b on a.k = b.k + 1"),
    "cte_recursive": same("with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t"),
}
