"""Constraints, failed statements, sequences and reopening of the statement engine."""

import pytest

from millrace.operators.statements import engine
from millrace.plans import text
from millrace.plans.engine import Engine


@pytest.fixture
def db(spark):
    e = engine(spark)
    e.sql("create table t (id int primary key, code text unique, n bigint not null default 5)")
    e.sql("insert into t (id, code) values (1, 'a'), (2, 'b'), (3, null), (4, null)")
    return e


def ids(e):
    return sorted(r.id for r in e.sql("select id from t").df.collect())


@pytest.mark.parametrize(
    ("statement", "message"),
    [
        ("insert into t values (1, 'z', 1)", "duplicate key"),
        ("insert into t values (9, 'a', 1)", "duplicate key"),
        ("insert into t values (9, 'x', 1), (9, 'y', 1)", "duplicate key"),
        ("insert into t values (null, 'z', 1)", "not-null"),
        ("insert into t values (9, 'z', null)", "not-null"),
        ("update t set id = 1", "duplicate key"),
        ("update t set n = null where id = 2", "not-null"),
        ("insert into t values (1, 'x', 1), (1, 'y', 2) on conflict (id) do update set n = 1", "second time"),
        ("insert into t values (1, 'x', 1) on conflict (n) do nothing", "no unique"),
        ("insert into missing values (1)", "does not exist"),
        ("select 1; select 2", "exactly one"),
        ("create table t (x int)", "already exists"),
        ("update t set nope = 1", "does not exist"),
    ],
)
def test_failed_statement_changes_nothing(db, statement, message):
    before = sorted(map(tuple, db.sql("select * from t").df.collect()), key=str)
    with pytest.raises(ValueError, match=message):
        db.sql(statement)
    assert sorted(map(tuple, db.sql("select * from t").df.collect()), key=str) == before


def test_tags_and_returning(db):
    assert db.sql("insert into t values (7, 'g', 1)").tag == "INSERT 0 1"
    r = db.sql("update t set n = n + id where id > 2 returning id, n as m")
    assert (r.tag, sorted(map(tuple, r.df.collect()))) == ("UPDATE 3", [(3, 8), (4, 9), (7, 8)])
    r = db.sql("delete from t where code is null returning *")
    assert (r.tag, len(r.df.collect())) == ("DELETE 2", 2)
    assert ids(db) == [1, 2, 7]


def test_update_moves_keys_as_a_whole(db):
    db.sql("update t set id = id + 1")
    assert ids(db) == [2, 3, 4, 5]


def test_state_and_sequences_survive_reopening(db, spark):
    db.sql("create table s (id bigserial, v text)")
    db.sql("insert into s (v) values ('x'), ('y')")
    again = Engine(spark, db.store.root)
    again.sql("insert into s (v) values ('z')")
    assert sorted(map(tuple, again.sql("select * from s").df.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert ids(again) == [1, 2, 3, 4]


def test_readers_keep_their_version(db):
    before = db.sql("select count(*) as n from t").df
    db.sql("delete from t")
    assert before.first().n == 4 and ids(db) == []


def test_vector_dimensions(db):
    db.sql("create table v (e vector(2))")
    db.sql("insert into v values ('[1,2]')")
    with pytest.raises(Exception, match="dimensions"):
        db.sql("select e <-> '[1,2,3]' as d from v").df.collect()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("select a from t order by a desc, b nulls first limit 3", "a desc NULLS LAST , b nulls first limit 3"),
        ("select a::text, b::float8, cast(c as integer), 1.5 from t", "cast ( a as string ) , cast ( b as double ) , cast ( c as int ) , 1.5D"),
        ("select row_number() over (order by a) from t", "order by a NULLS LAST )"),
        ("select 'it''s a . b' from s.t", "'it''s a . b' from s.t"),
    ],
)
def test_rewrites(given, want):
    assert want in text.to_spark(text.tokens(given))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_join_on_their_keys(db, spark, monkeypatch):
    """UPDATE ... FROM and DELETE ... USING plan equi joins, and a statement writes only parts that change."""
    plans, run = [], Engine._run
    monkeypatch.setattr(Engine, "_run", lambda self, body, **frames: (plans.append(plan_of(df := run(self, body, **frames))), df)[1])
    db.sql("create table o (k int, v bigint)")
    db.sql("insert into o values (1, 10), (2, 20), (2, 30)")
    db.sql("insert into t values (8, 'h', 1)")
    parts = list(db.store.get("t").parts)
    assert db.sql("update t set n = o.v from o where o.k = t.id and t.id = 1").tag == "UPDATE 1"
    assert len(set(parts) & set(db.store.get("t").parts)) == len(parts) - 1
    assert db.sql("delete from t using o where o.k = t.id").tag == "DELETE 2"
    assert ids(db) == [3, 4, 8]
    assert not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)


def test_vacuum_keeps_what_is_named(db):
    db.sql("update t set n = n + 1")
    rows = sorted(map(tuple, db.sql("select * from t").df.collect()), key=str)
    assert db.store.vacuum() >= 1 and db.store.vacuum() == 0
    assert sorted(map(tuple, db.sql("select * from t").df.collect()), key=str) == rows


@pytest.mark.parametrize("query", ["select id from t where id not in (select n from t)", "select id from t where id < all (select n from t)", "select id from t where n >= any (select id from t)"])
def test_set_comparisons_need_no_nested_loop(db, query):
    assert "NestedLoop" not in plan_of(db.sql(query).df) and "Cartesian" not in plan_of(db.sql(query).df)


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("(1 + 2) / 2 * 3", 3), ("case when 1 / 2 = 0 then 9 / 2 end", 4), ("2147483647 + 1", 2147483648), ("cast(2.5 as int)", 3), ("'42 '::int8", 42),
        ("2.0::text", "2"), ("(1 > 0)::text", "true"), ("'on'::bool", True), ("substring('hello', 0, 3)", "he"), ("substring('hello', -1, 3)", "h"), ("substring('hello' from 2)", "ello"), ("round(2.5)", 3), ("round(2.345, 2)", 2.35),
        ("'[3,0]'::vector <=> '[0,4]'", 1.0), ("('[1, 2.5]'::vector)::text", "[1,2.5]"), ("1 - -1", 2), ("'a - b' || 1.5", "a - b1.5"), ("3 not in (select 1 union all select null)", None), ("5 > all (select 1 where false)", True),
    ],
)
def test_values_of_the_dialect(spark, expression, want):
    assert Engine(spark, None).sql(f"select {expression} as v").df.first().v == want
