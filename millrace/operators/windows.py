"""Window functions under the default frame: from the partition's start to the current row and its peers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.catalogue import Query, frame, pair, same



def _by_customer():
    return Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("o_orderkey"))


def _running(name: str, sql: str, column):
    return frame(lambda o: o.select("o_orderkey", column().over(_by_customer()).alias(name)), f"select o_orderkey, {sql} over (partition by o_custkey order by o_orderkey) as {name} from orders", "orders")


def _totals(n):
    """Aggregates without an order: combined in each task and joined back, so that no task gets all rows or a hot key's."""
    most = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("m"), F.count("*").alias("c"))
    whole = most.agg(F.sum("c").alias("n"))
    # one row, whatever the table's size
    return n.join(most.drop("c"), "n_regionkey").crossJoin(F.broadcast(whole)).select("n_nationkey", "n", "m")


def _several(o):
    per = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    ranked = o.select("o_orderkey", "o_orderstatus", F.row_number().over(_by_customer()).cast("long").alias("rn"), F.lag("o_orderkey").over(_by_customer()).alias("p"))
    return ranked.join(per, "o_orderstatus").select("o_orderkey", "rn", "n", "p")


QUERIES: dict[str, Query] = {
    "win_row_number": frame(lambda o: o.select("o_orderkey", F.row_number().over(_by_customer()).cast("long").alias("rn")), "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders", "orders"),
    "win_rank": pair("select c_custkey, cast(rank() over (partition by c_mktsegment order by c_nationkey desc nulls last) as bigint) as r from customer", "select c_custkey, rank() over (partition by c_mktsegment order by c_nationkey desc nulls last) as r from customer"),
    "win_dense_rank": pair("select c_custkey, cast(dense_rank() over (partition by c_mktsegment order by c_nationkey) as bigint) as r from customer", "select c_custkey, dense_rank() over (partition by c_mktsegment order by c_nationkey) as r from customer"),
    "win_ntile": pair("select c_custkey, cast(ntile(7) over (partition by c_mktsegment order by c_custkey) as bigint) as t from customer", "select c_custkey, ntile(7) over (partition by c_mktsegment order by c_custkey) as t from customer"),
    "win_lag": pair("select o_orderkey, lag(o_totalprice, 2, 0.0) over (partition by o_custkey order by o_orderkey) as p from orders", "select o_orderkey, lag(o_totalprice, 2, 0.0) over (partition by o_custkey order by o_orderkey) as p from orders"),
    "win_lead": same("select o_orderkey, lead(o_totalprice) over (partition by o_custkey order by o_orderkey) as p from orders"),
    "win_first_value": _running("v", "first_value(o_totalprice)", lambda: F.first("o_totalprice")),
    "win_last_value": same("select c_custkey, last_value(c_nationkey) over (partition by c_mktsegment order by c_nationkey) as lv from customer"),
    "win_nth_value": same("select o_orderkey, nth_value(o_totalprice, 3) over (partition by o_custkey order by o_orderkey) as v from orders"),
    "win_count": same("select o_orderkey, count(nullif(o_orderstatus, 'F')) over (partition by o_custkey order by o_orderkey) as n from orders"),
    "win_count_star": _running("n", "count(*)", lambda: F.count("*")),
    "win_sum": frame(lambda o: o.select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_customer()), 2).alias("s")), "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 2) as s from orders", "orders"),
    "win_avg": same("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey), 7) as a from orders"),
    "win_min": _running("v", "min(o_totalprice)", lambda: F.min("o_totalprice")),
    "win_max": _running("v", "max(o_totalprice)", lambda: F.max("o_totalprice")),
    "win_total": frame(_totals, "select n_nationkey, count(*) over () as n, max(n_nationkey) over (partition by n_regionkey) as m from nation", "nation"),
    "win_multi": frame(_several, "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_orderstatus) as n, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as p from orders", "orders"),
    "win_after_where": pair("select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as rn from orders where o_totalprice > 150000", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders where o_totalprice > 150000"),
    "win_rows_frame": same("select o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as m from orders"),
    "win_named": same("select o_orderkey, count(*) over w as n, min(o_totalprice) over w as m from orders window w as (partition by o_custkey order by o_orderkey)"),
    "win_percent_rank": same("select c_custkey, round(percent_rank() over (partition by c_mktsegment order by c_custkey), 9) as p, round(cume_dist() over (partition by c_mktsegment order by c_custkey), 9) as c from customer"),
}
