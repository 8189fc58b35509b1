"""Scalar operators and functions, casts, and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import pg, vectors
from millrace.operators.catalogue import Query, frame, pair, same

_QUERY = "[" + ",".join(str(round((i * 37 % 19 - 9) / 10, 1)) for i in range(64)) + "]"
_VECTOR = [float(x) for x in _QUERY[1:-1].split(",")]
_LIST = f"{_QUERY}::double[]"


def nation(oracle: str, **columns):
    return frame(lambda n: n.select("n_nationkey", *[c().alias(k) for k, c in columns.items()]), f"select n_nationkey, {oracle} from nation", "nation")


def part(oracle: str, **columns):
    return frame(lambda n: n.select("p_partkey", *[c().alias(k) for k, c in columns.items()]), f"select p_partkey, {oracle} from part", "part")


def embedded(oracle: str, text: str = "", **columns):
    if text:
        return pair(f"select vec_id, {text.replace('{q}', _QUERY)} from embeddings", f"select vec_id, {oracle} from embeddings")
    return frame(lambda n: n.select("vec_id", *[c().alias(k) for k, c in columns.items()]), f"select vec_id, {oracle} from embeddings", "embeddings")


def _near(distance):
    return lambda e: vectors.nearest(e, "embedding", _VECTOR, 10, distance, key="vec_id").select("vec_id", F.round("distance", 6).alias("d"))


def _knn(name):
    return f"select vec_id, round({name}(embedding::double[], {_LIST}), 6) as d from embeddings order by {name}(embedding::double[], {_LIST}), vec_id limit 10"


_name, _key, _price = lambda: F.col("n_name"), lambda: F.col("n_nationkey"), lambda: F.col("p_retailprice")
_words = lambda: F.concat(F.lit("xx yz"), F.col("n_name"), F.lit("zyx  "))
_balance = lambda: (F.col("n_nationkey") - 12) / 2.0
_q = lambda: F.array(*[F.lit(x) for x in _VECTOR])

QUERIES: dict[str, Query] = {
    "op_add": nation("n_nationkey::bigint + 2147483647 as v, n_nationkey + 0.5::double as f", v=lambda: pg.add(_key(), 2147483647), f=lambda: _key() + 0.5),
    "op_sub": nation("n_nationkey::bigint - 2147483647 - n_regionkey as v", v=lambda: pg.sub(pg.sub(_key(), 2147483647), F.col("n_regionkey"))),
    "op_mul": nation("n_nationkey::bigint * 1000000000 as v", v=lambda: pg.mul(_key(), 1000000000)),
    "op_div": pair(
        "select l_orderkey, l_linenumber, l_orderkey / 7 as d, -l_orderkey / 7 as e, l_quantity / 4 as f, 7 / 2 as g, l_orderkey / 2.0 as h from lineitem",
        "select l_orderkey, l_linenumber, l_orderkey // 7 as d, -(l_orderkey // 7) as e, l_quantity / 4.0 as f, 3::bigint as g, l_orderkey / 2.0 as h from lineitem"),
    "op_int_width": pair("select n_nationkey, n_nationkey + 2147483647 as v, n_nationkey * 2000000000 - n_regionkey as w from nation", "select n_nationkey, n_nationkey::bigint + 2147483647 as v, n_nationkey::bigint * 2000000000 - n_regionkey as w from nation"),
    "op_mod": nation("(n_nationkey - 12) % 5 as v", v=lambda: (_key() - 12) % 5),
    "op_neg": nation("-n_nationkey as v", v=lambda: -_key()),
    "op_concat": nation("n_name || '-' || n_nationkey::varchar as v, n_name || nullif(n_name, n_name) as x", v=lambda: F.concat(_name(), F.lit("-"), _key().cast("string")), x=lambda: F.concat(_name(), F.nullif(_name(), _name()))),
    "case_searched": same("select p_partkey, case when p_size > 40 then 'big' when p_size > 20 then 'mid' else 'small' end as c, case when p_size > 45 then 1 end as d from part"),
    "case_simple": same("select n_nationkey, case nullif(n_regionkey, 3) when 1 then 'one' when 3 then 'never' else 'other' end as c from nation"),
    "fn_coalesce": same("select n_nationkey, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 5), 99) as v from nation"),
    "fn_nullif": same("select n_nationkey, nullif(n_regionkey, 2) as v, nullif(n_name, 'NATION_3') as s from nation"),
    "fn_greatest_least": pair("select n_nationkey, greatest(n_nationkey, n_regionkey, 7) as g, least(n_nationkey, nullif(n_regionkey, 2)) as l from nation", "select n_nationkey, greatest(n_nationkey, n_regionkey, 7) as g, least(n_nationkey, nullif(n_regionkey, 2)) as l from nation"),
    "fn_upper": nation("upper(n_name || 'é') as v", v=lambda: F.upper(F.concat(_name(), F.lit("é")))),
    "fn_lower": nation("lower(n_name || 'É') as v", v=lambda: F.lower(F.concat(_name(), F.lit("É")))),
    "fn_length": nation("length(n_name || 'éü') as v", v=lambda: pg.length(F.concat(_name(), F.lit("éü")))),
    "fn_concat": nation("concat(n_name, nullif(n_name, n_name), '!') as c", c=lambda: pg.concat(_name(), F.nullif(_name(), _name()), "!")),
    "fn_substring": pair(
        "select n_nationkey, substring(n_name, 3) as a, substring(n_name from 2 for 4) as b, substring(n_name, -1, 3) as c, substr(n_name, 0, 3) as d, substring(n_name, n_regionkey - 2, 4) as e from nation",
        "select n_nationkey, substring(n_name, 3) as a, substring(n_name, 2, 4) as b, left(n_name, 1) as c, left(n_name, 2) as d, case when n_regionkey > 2 then substring(n_name, n_regionkey - 2, 4) else left(n_name, n_regionkey + 1) end as e from nation"),
    "fn_trim": nation("trim('xx yz' || n_name || 'zyx  ') as a, trim('xx yz' || n_name || 'zyx  ', ' xyz') as b", a=lambda: pg.btrim(_words()), b=lambda: pg.btrim(_words(), " xyz")),
    "fn_btrim": nation("trim('xx yz' || n_name || 'zyx  ', 'x ') as a", a=lambda: pg.btrim(_words(), "x ")),
    "fn_ltrim": nation("ltrim('xx yz' || n_name || 'zyx  ', 'xy ') as a", a=lambda: pg.ltrim(_words(), "xy ")),
    "fn_rtrim": nation("rtrim('xx yz' || n_name || 'zyx  ', 'xy ') as a", a=lambda: pg.rtrim(_words(), "xy ")),
    "fn_strpos": nation("strpos(n_name, 'N_1') as v, strpos('é' || n_name, 'T') as w", v=lambda: pg.strpos(_name(), "N_1"), w=lambda: pg.strpos(F.concat(F.lit("é"), _name()), "T")),
    "fn_position": nation("position('TI' in n_name) as v", v=lambda: pg.strpos(_name(), "TI")),
    "fn_replace": nation("replace(n_name, 'NA', 'x') as v", v=lambda: pg.replace(_name(), "NA", "x")),
    "fn_left": nation("left(n_name, 3) as a, left(n_name, -2) as b, left(n_name, -99) as c", a=lambda: pg.left(_name(), 3), b=lambda: pg.left(_name(), -2), c=lambda: pg.left(_name(), -99)),
    "fn_right": nation("right(n_name, 3) as a, right(n_name, -2) as b, right(n_name, 0) as c", a=lambda: pg.right(_name(), 3), b=lambda: pg.right(_name(), -2), c=lambda: pg.right(_name(), 0)),
    "fn_split_part": nation("split_part(n_name, '_', 2) as a, split_part(n_name, '_', 3) as b", a=lambda: pg.split_part(_name(), "_", 2), b=lambda: pg.split_part(_name(), "_", 3)),
    "fn_abs": nation("abs(n_nationkey - 12) as v", v=lambda: F.abs(_key() - 12)),
    "fn_ceil": part("ceil(p_retailprice)::bigint as v", v=lambda: pg.ceil(_price())),
    "fn_floor": part("floor(p_retailprice)::bigint as v", v=lambda: pg.floor(_price())),
    "fn_round": pair("select n_nationkey, round((n_nationkey - 12) / 2.0) as v, round((n_nationkey - 12) / 16.0, 1) as w from nation", "select n_nationkey, round((n_nationkey - 12) / 2.0::double)::bigint as v, round((n_nationkey - 12) / 16.0::double, 1) as w from nation"),
    "fn_mod": nation("(n_nationkey - 12) % 7 as v", v=lambda: (_key() - 12) % 7),
    "fn_power": nation("power(n_nationkey, 2)::double as v", v=lambda: pg.power(_key(), 2)),
    "fn_sqrt": nation("sqrt(n_nationkey * n_nationkey)::double as v", v=lambda: pg.sqrt(_key() * _key())),
    "cast_int": pair(
        "select s_suppkey, s_acctbal::int8 as b, cast(' ' || s_suppkey as bigint) as k, (s_acctbal > 0)::bigint as t, cast(2.5 as bigint) as h, (-2.5)::bigint as i from supplier",
        "select s_suppkey, round(s_acctbal)::bigint as b, s_suppkey as k, (s_acctbal > 0)::bigint as t, 3::bigint as h, -3::bigint as i from supplier"),
    "cast_float": pair("select n_nationkey, (n_nationkey::text || '.5')::float8 as v, n_regionkey::real / 2 as w, cast(n_nationkey as double precision) as x from nation", "select n_nationkey, (n_nationkey::varchar || '.5')::double as v, n_regionkey::double / 2 as w, n_nationkey::double as x from nation"),
    "cast_text": pair(
        "select n_nationkey, n_nationkey::text as v, (n_nationkey > 3)::text as b, cast(n_nationkey / 2.0 as varchar(20)) as f, 'x' || n_regionkey * 1.0 as c from nation",
        "select n_nationkey, n_nationkey::varchar as v, (n_nationkey > 3)::varchar as b, (n_nationkey // 2)::varchar || case when n_nationkey % 2 = 1 then '.5' else '' end as f, 'x' || n_regionkey as c from nation"),
    "cast_bool": pair(
        "select n_nationkey, (case n_regionkey when 0 then ' YES' when 1 then 'off' when 2 then 't' when 3 then '0' else 'no' end)::boolean as v, n_regionkey::bool as i from nation",
        "select n_nationkey, n_regionkey in (0, 2) as v, n_regionkey <> 0 as i from nation"),
    "cast_vector": pair(
        "select n_nationkey, ('[ ' || n_nationkey || ' ,2.5]')::vector[0] as a, '[1,2.5]'::vector <-> '[1,0.5]'::vector as b from nation",
        "select n_nationkey, n_nationkey::float as a, 2.0::double as b from nation"),
    "cast_other": nation("n_nationkey::smallint as v, ('2024-01-0' || (n_regionkey + 1)::varchar)::date as d", v=lambda: _key().cast("short"), d=lambda: F.concat(F.lit("2024-01-0"), (F.col("n_regionkey") + 1).cast("string")).cast("date")),
    "vec_literal": Query(lambda s, d: s.range(1).select(F.explode(vectors.parse(F.lit("[1, 2.5,-3]"))).alias("v")), "select unnest([1, 2.5, -3]::float[]) as v"),
    "vec_l2": embedded(f"round(list_distance(embedding::double[], {_LIST}), 3) as d", text="round(embedding <-> '{q}', 3) as d"),
    "vec_cosine": pair(
        "select a.vec_id, round(a.embedding <=> b.embedding, 3) as d, round(a.embedding <=> '[" + ",".join(["0"] * 64) + "]', 3) as z from embeddings a join embeddings b on a.vec_id = b.vec_id + 1",
        "select a.vec_id, round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 3) as d, 1.0::double as z from embeddings a join embeddings b on a.vec_id = b.vec_id + 1"),
    "vec_neg_ip": embedded(f"round(list_negative_inner_product(embedding::double[], {_LIST}), 3) as d", text="round(embedding <#> '{q}', 3) as d"),
    "vec_null": embedded("null::double as d", text="embedding <-> null::vector as d"),
    "vec_to_text": pair("select n_nationkey, (('[' || n_nationkey || ',2.5]')::vector)::text as v from nation", "select n_nationkey, '[' || n_nationkey::varchar || ',2.5]' as v from nation"),
    "knn_topk_sql": pair(f"select vec_id from embeddings order by embedding <=> '{_QUERY}' limit 5", f"select vec_id from embeddings order by list_cosine_distance(embedding::double[], {_LIST}) limit 5"),
    "knn_topk": frame(_near(vectors.l2), _knn("list_distance"), "embeddings"),
    "knn_topk_cosine": frame(_near(vectors.cosine), _knn("list_cosine_distance"), "embeddings"),
    "knn_topk_ip": frame(_near(vectors.negative_inner_product), _knn("list_negative_inner_product"), "embeddings"),
    "index_hnsw_search": frame(lambda e: _near(vectors.l2)(e).select("vec_id"), _knn("list_distance").replace(f", round(list_distance(embedding::double[], {_LIST}), 6) as d", ""), "embeddings"),
    "scan_by_rowid": frame(lambda e: _near(vectors.l2)(e).select("vec_id").join(e.select("vec_id", "label"), "vec_id"), f"select vec_id, label from embeddings where vec_id in (select vec_id from embeddings order by list_distance(embedding::double[], {_LIST}), vec_id limit 10)", "embeddings"),
}
