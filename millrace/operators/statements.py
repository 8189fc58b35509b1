"""Statements that define or change tables, each run on a table of its own and answered with the state it leaves.

The engine's folder is new for every call: in spark.checkpoint.dir, or a temporary one
where that is unset.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.catalogue import Query
from millrace.plans.engine import Engine
from millrace.sources import tables


def engine(spark: SparkSession) -> Engine:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    root = root or f"file://{tempfile.gettempdir()}/millrace-store"
    return Engine(spark, f"{root}/store-{uuid.uuid4().hex}")


_NATION = "create table n (n_nationkey int primary key, n_name text not null, n_regionkey int default 7)"
_LOAD = "insert into n select n_nationkey, n_name, n_regionkey from source"


def _run(*statements: str, answer: str = "select * from n", returning: bool = False):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark)
        tables.read(spark, folder, "nation").createOrReplaceTempView("source")
        tables.read(spark, folder, "region").createOrReplaceTempView("source_region")
        out = None
        for s in (_NATION, _LOAD, *statements):
            out = e.sql(s)
        return out.df if returning else e.sql(answer).df

    return build


def _state(oracle: str, *statements: str, **how) -> Query:
    return Query(_run(*statements, **how), oracle)


_ALL = "select n_nationkey, n_name, n_regionkey from nation"

QUERIES: dict[str, Query] = {
    "dml_insert_values": _state(f"{_ALL} union all select 100, 'A', 1 union all select 101, 'B-1', null", "insert into n values (100, 'A', 1), (101, 'B' || '-1', null)"),
    "dml_insert_defaults": _state(f"{_ALL} union all select 100, 'A', 7 union all select 101, 'B', 7", "insert into n (n_nationkey, n_name) values (100, 'A')", "insert into n values (101, 'B', default)"),
    "dml_insert_select": _state(f"{_ALL} union all select n_nationkey + 50, lower(n_name), 7 from nation where n_regionkey = 1", "insert into n (n_nationkey, n_name) select n_nationkey + 50, lower(n_name) from source where n_regionkey = 1"),
    "dml_upsert_nothing": _state(f"{_ALL} union all select 200, 'new', 1", "insert into n values (3, 'old', 1), (200, 'new', 1), (200, 'again', 2) on conflict do nothing"),
    "dml_upsert_update": _state("select n_nationkey, case when n_nationkey = 3 then n_name || '+x' else n_name end as n_name, case when n_nationkey = 3 then 9 else n_regionkey end as n_regionkey from nation union all select 200, 'y', 5", "insert into n values (3, 'x', 9), (200, 'y', 5) on conflict (n_nationkey) do update set n_name = n_name || '+' || excluded.n_name, n_regionkey = excluded.n_regionkey"),
    "dml_update": _state("select n_nationkey, case when n_regionkey = 1 then upper(n_name) || '*' else n_name end as n_name, n_regionkey from nation", "update n set n_name = upper(n_name) || '*' where n_regionkey = 1"),
    "dml_update_from": _state("select n_nationkey, case when n_nationkey < 3 then 'R' || n_regionkey::varchar else n_name end as n_name, n_regionkey from nation", "create table r (k int, t text)", "insert into r select n_nationkey, 'R' || cast(n_regionkey as string) from source where n_nationkey < 3", "update n set n_name = r.t from r where r.k = n.n_nationkey"),
    "dml_delete": _state("select * from nation where n_regionkey is distinct from 1", "delete from n where n_regionkey = 1"),
    "dml_delete_using": _state("select * from nation where n_regionkey not in (0, 2)", "create table r (k int)", "insert into r values (0), (2), (2)", "delete from n using r where r.k = n.n_regionkey"),
    "dml_truncate": _state("select count(*) as c from nation where false", "truncate n", answer="select count(*) as c from n"),
    "dml_returning": _state("select n_nationkey as k, n_name || '!' as v from nation where n_regionkey = 2", "update n set n_name = n_name || '!' where n_regionkey = 2 returning n_nationkey as k, n_name as v", returning=True),
    "dml_returning_delete": _state("select * from nation where n_nationkey < 4", "delete from n where n_nationkey < 4 returning *", returning=True),
    "con_update_unique": _state("select n_nationkey + 1 as n_nationkey, n_name, n_regionkey from nation", "update n set n_nationkey = n_nationkey + 1"),
    "ddl_create_table": _state(_ALL, "create table if not exists n (x int)"),
    "ddl_ctas": _state("select n_regionkey, count(*) as c from nation group by n_regionkey", "create table t as select n_regionkey, count(*) as c from n group by n_regionkey", answer="select * from t"),
    "ddl_add_column": _state("select *, 5::bigint as extra from nation", "alter table n add column extra bigint default 5"),
    "ddl_drop_column": _state("select n_nationkey, n_name from nation", "alter table n drop column n_regionkey"),
    "ddl_rename_column": _state("select n_nationkey, n_name as label, n_regionkey from nation", "alter table n rename column n_name to label"),
    "ddl_rename_table": _state(_ALL, "alter table n rename to m", answer="select * from m"),
    "ddl_drop": _state(_ALL, "create table t (x serial)", "drop table if exists t, nothing", "create table t (x serial)"),
    "seq_nextval": _state("select r_name as v, row_number() over (order by r_name)::int as id from region", "create table s (id serial primary key, v text)", "insert into s (v) select r_name from source_region order by r_name", answer="select id, v from s"),
    "seq_currval": _state("select 4::bigint as c", "create table s (id serial, v text)", "insert into s (v) values ('a'), ('b'), ('c'), ('d')", answer="select currval('s_id_seq') as c"),
    "seq_setval": _state("select 42::bigint as a", "create table s (id serial, v text)", "select setval('s_id_seq', 41)", answer="select nextval('s_id_seq') as a"),
    "sink_ctas": _state("select n_name from nation where n_regionkey = 0", "create table t as select n_name from n where n_regionkey = 0", answer="select n_name from t"),
    "wal_recover": Query(lambda spark, folder: _reopened(spark, folder), "select n_nationkey, n_name, n_regionkey from nation where n_nationkey <> 2"),
    "api_execute": _state("select n_regionkey, count(*) as c from nation where n_name like 'NATION_1%' group by n_regionkey", answer="select n_regionkey, count(*) as c from n where n_name like 'NATION_1%' group by n_regionkey"),
    "sql_null_order": _state("select n_name, nullif(n_regionkey, 4) as k from nation order by k nulls last, n_name limit 22", answer="select n_name, nullif(n_regionkey, 4) as k from n order by k, n_name limit 22"),
    "sql_any_all": _state("select n_nationkey from nation where n_nationkey >= all (select n_regionkey from nation) and n_regionkey < any (select 3)", answer="select n_nationkey from n where n_nationkey >= all (select n_regionkey from n) and n_regionkey < any (select 3)"),
    "sql_distinct_on": _state("select n_regionkey, max(n_nationkey) as n_nationkey from nation group by n_regionkey", answer="select distinct on (n_regionkey) n_regionkey, n_nationkey from n order by n_regionkey, n_nationkey desc"),
    "sql_functions": _state("select left(n_name, -2) as a, right(n_name, -3) as b, strpos(n_name, '_') as c, ltrim(n_name, 'NA') as d, concat(n_name, null, '!') as e from nation", answer="select left(n_name, -2) as a, right(n_name, -3) as b, strpos(n_name, '_') as c, ltrim(n_name, 'NA') as d, concat(n_name, null, '!') as e from n"),
    "sql_string_agg": _state("select n_regionkey, string_agg(n_name, ';' order by n_name) as s from nation group by n_regionkey", answer="select n_regionkey, string_agg(n_name, ';' order by n_name) as s from n group by n_regionkey"),
    "sql_vector": Query(lambda spark, folder: _vectors(spark), "select 1 as id, 0.0::double as d, 0.0::double as c union all select 2, 5.0, 1.0"),
}


def _refused(*statements: str, table: str = _NATION, load: str = _LOAD, answer: str = "select * from n"):
    """The state after statements that a constraint refuses."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark)
        tables.read(spark, folder, "nation").createOrReplaceTempView("source")
        e.sql(table)
        e.sql(load)
        for s in statements:
            try:
                e.sql(s)
            except ValueError:
                continue
            raise AssertionError(f"not refused: {s}")
        return e.sql(answer).df

    return build


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of statements of each kind."""
    e = engine(spark)
    run = ("begin", _NATION, "insert into n values (1, 'a', 1), (2, 'b', 2)", "update n set n_name = 'c' where n_nationkey = 1", "delete from n", "truncate table n", "drop table n", "set x = 1", "show x", "commit")
    return spark.createDataFrame([(i, e.sql(s).tag) for i, s in enumerate(run)], "i int, tag string")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as a part and read again, two columns of it."""
    e = engine(spark)
    part = e.store.write(tables.read(spark, folder, "part"))
    return spark.read.parquet(part).select("p_partkey", "p_brand")


_PAIR = {"table": "create table n (a int, b int, v text, primary key (a, b))", "load": "insert into n select n_regionkey, n_nationkey, n_name from source"}
_PAIRS = "select n_regionkey as a, n_nationkey as b, n_name as v from nation"
_TAGS = ("BEGIN", "CREATE TABLE", "INSERT 0 2", "UPDATE 1", "DELETE 2", "TRUNCATE TABLE", "DROP TABLE", "SET", "SHOW", "COMMIT")

QUERIES |= {
    "dml_insert_atomic": Query(_refused("insert into n values (300, 'new', 1), (301, 'new', 1), (300, 'twice', 2)"), _ALL),
    "con_not_null": Query(_refused("insert into n values (300, null, 1)", "update n set n_name = null where n_nationkey = 1"), _ALL),
    "con_pk": Query(_refused("insert into n values (0, 0, 'again')", "insert into n values (null, 900, 'x')", "update n set b = 0, a = 0", **_PAIR), _PAIRS),
    "con_unique": Query(_refused("insert into n values (400, 'NATION_1', 1)", table="create table n (n_nationkey int, n_name text unique, n_regionkey int)"), _ALL),
    "index_unique": Query(_refused("insert into n values (3, 'x', 1)", answer="select * from n where n_nationkey = 3"), f"{_ALL} where n_nationkey = 3"),
    "index_pk_composite": Query(_refused("insert into n values (0, 0, 'again')", answer="select v from n where a = 0 and b = 0", **_PAIR), "select n_name as v from nation where n_regionkey = 0 and n_nationkey = 0"),
    "dml_tags": Query(_tags, " union all ".join(f"select {i} as i, '{t}' as tag" for i, t in enumerate(_TAGS))),
    "file_segment_write": Query(_written, "select p_partkey, p_brand from part"),
    "seq_create": _state("select 1::int as id, 'a' as v", "create table s (id serial, v text)", "insert into s (v) values ('a')", answer="select * from s"),
    "wire_simple": _state("select count(*) as c from nation", answer="select count(*) as c from public.n"),
    "dml_update_subquery": _state(
        "select n_nationkey, case when n_nationkey in (select r_regionkey from region) then (select max(r_name) from region) || n_regionkey else n_name end as n_name, case when n_nationkey < 5 then n_regionkey + 1 else n_regionkey end as n_regionkey from nation",
        "update n set n_name = (select max(r_name) from source_region) || n_regionkey, n_regionkey = n_regionkey + 1 where n_nationkey in (select r_regionkey from source_region)"),
    "dml_delete_subquery": _state(
        "select * from nation where n_nationkey not in (select r_regionkey from region) and n_nationkey <> (select max(n_nationkey) from nation)",
        "delete from n where exists (select 1 from source_region where r_regionkey = n.n_nationkey) or n_nationkey = (select max(n_nationkey) from n)"),
    "dml_update_rounds": _state("select n_nationkey, n_name, case when n_nationkey = 1 then 3 when n_nationkey = 2 then 1 else n_regionkey end as n_regionkey from nation", "update n set n_regionkey = 2.5 where n_nationkey = 1", "update n set n_regionkey = 3 / 2 where n_nationkey = 2"),
    "con_unique_multi": Query(_refused("insert into n values (0, 0, 'again')", "insert into n values (90, 1, 'x'), (90, 1, 'y')", "update n set a = 1, b = 1", table="create table n (a int, b int, v text, unique (a, b))", load=_PAIR["load"]), _PAIRS),
    "con_key_dropped": _state("select n_regionkey as a, n_name as v from nation union all select 0, 'again'", "create table p (a int, b int, v text, primary key (a, b))", "insert into p select n_regionkey, n_nationkey, n_name from source", "alter table p drop column b", "insert into p values (0, 'again')", answer="select * from p"),
    "schema_tables": _state("select n_name as v from nation where n_nationkey = 3 union all select 'own'", "create table s.t (v text)", "insert into s.t select n_name from source where n_nationkey = 3", "insert into s.t values ('own')", answer="select v from s.t"),
    "wal_append": Query(lambda spark, folder: _logged(spark, folder), "select 4::bigint as entries, 1::bigint as after_vacuum, 'could not commit: another engine has changed the tables' as refused"),
    "wal_read": Query(lambda spark, folder: _torn(spark, folder), _ALL),
    "util_multi_stmt": Query(lambda spark, folder: _message(spark, lambda: engine(spark).sql("select 1; select 2")), "select 'syntax error: exactly one statement is expected' as message"),
    "api_parse": Query(lambda spark, folder: _parsed(spark), " union all ".join(f"select '{k}' as kind, {t} as is_tree" for k, t in (("SELECT", "true"), ("WITH", "true"), ("INSERT", "false"), ("CREATE TABLE", "false"), ("UPDATE", "false")))),
    "vec_type_error": Query(lambda spark, folder: _type_error(spark), "select 'a vector is expected' as message"),
    "vec_dim_error": Query(lambda spark, folder: _dimension_error(spark), "select 'different vector dimensions' as message"),
}


def _message(spark: SparkSession, run) -> DataFrame:
    """What a statement is refused with."""
    try:
        run()
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "message string")
    raise AssertionError("not refused")


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the log after four commits, and after a vacuum; and a commit on a state that another engine has left behind."""
    e = engine(spark)
    tables.read(spark, folder, "nation").createOrReplaceTempView("source")
    for s in (_NATION, _LOAD, "update n set n_name = 'x' where n_nationkey = 1"):
        e.sql(s)
    late = Engine(spark, e.store.root)
    e.sql("delete from n where n_nationkey = 2")
    entries = len(e.store.entries())
    refused = _message(spark, lambda: late.sql("delete from n")).first().message
    e.sql("vacuum")
    assert e.sql("select * from n").df.count() == tables.read(spark, folder, "nation").count() - 1
    return spark.createDataFrame([(entries, len(e.store.entries()), refused)], "entries long, after_vacuum long, refused string")


def _torn(spark: SparkSession, folder: str) -> DataFrame:
    """What is read where the log ends in half an entry."""
    e = engine(spark)
    tables.read(spark, folder, "nation").createOrReplaceTempView("source")
    for s in (_NATION, _LOAD):
        e.sql(s)
    out = e.store._files.create(e.store._path(f"{e.store.root}/log/{9:020d}.json"))
    out.write(bytearray(b'{"tables": {"public.n": {'))
    out.close()
    return Engine(spark, e.store.root).sql("select * from n").df


def _parsed(spark: SparkSession) -> DataFrame:
    e = Engine(spark, None)
    found = [json.loads(e.parse(s)) for s in ("select a::text, b / 2 from t", "with t as (select 1) select * from t", "insert into t values (1)", "create table t (x int)", "update t set x = 1")]
    return spark.createDataFrame([(x["kind"], "tree" in x) for x in found], "kind string, is_tree boolean")


def _type_error(spark: SparkSession) -> DataFrame:
    try:
        Engine(spark, None).sql("select 5 <-> '[1,2,3]' as d").df.collect()
    except Exception as x:  # noqa: BLE001  Spark raises its own kinds
        found = "a vector is expected" if "DATATYPE_MISMATCH" in str(x) else "another error"
    else:
        found = "no error"
    return spark.createDataFrame([(found,)], "message string")


def _dimension_error(spark: SparkSession) -> DataFrame:
    e = engine(spark)
    e.sql("create table v (vec vector(2))")
    e.sql("insert into v values ('[1,2]')")
    try:
        e.sql("select vec <-> '[1,2,3]' as d from v").df.collect()
    except Exception as x:  # noqa: BLE001  Spark raises its own kinds
        found = "different vector dimensions" if "different vector dimensions" in str(x) else "another error"
    else:
        found = "no error"
    return spark.createDataFrame([(found,)], "message string")


def _reopened(spark: SparkSession, folder: str) -> DataFrame:
    """The state that an engine opened anew finds."""
    e = engine(spark)
    tables.read(spark, folder, "nation").createOrReplaceTempView("source")
    for s in (_NATION, _LOAD, "delete from n where n_nationkey = 2"):
        e.sql(s)
    return Engine(spark, e.store.root).sql("select * from n").df


def _vectors(spark: SparkSession) -> DataFrame:
    e = engine(spark)
    e.sql("create table v (id int, vec vector(2))")
    e.sql("insert into v values (1, '[3,0]'), (2, '[0, 4]')")
    return e.sql("select id, vec <-> '[3,0]' as d, vec <=> '[3,0]' as c from v order by vec <-> '[3,0]' limit 2").df
