"""Edge cases of the scalar helpers that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import pg, vectors
from millrace.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: pg.to_int(F.lit(2.5)), 3), (lambda: pg.to_int(F.lit(-2.5)), -3), (lambda: pg.int_div(-7, 2), -3),
        (lambda: pg.substring("hello", 0, 3), "he"), (lambda: pg.substring("hello", -5, 3), ""), (lambda: pg.substring("hello", 4), "lo"),
        (lambda: pg.left("abc", -5), ""), (lambda: pg.right("abc", -1), "bc"), (lambda: pg.concat("a", F.lit(None), "b"), "ab"),
        (lambda: pg.to_bool(" ON "), True), (lambda: pg.to_bool("no"), False), (lambda: pg.to_bool(F.lit(None).cast("string")), None),
        (lambda: pg.text_of(F.lit(20.0), "double"), "20"), (lambda: pg.text_of(F.lit(True), "boolean"), "t"), (lambda: pg.text_of(F.lit(2.5), "double"), "2.5"),
        (lambda: pg.add(F.lit(2147483647), 1), 2147483648), (lambda: pg.strpos("héllo", "l"), 3), (lambda: pg.btrim("xxaxx", "x"), "a"),
        (lambda: vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 1.0), (lambda: vectors.l2(vectors.parse(F.lit("[0, 3]")), vectors.parse(F.lit("[4,0]"))), 5.0),
    ],
)
def test_values(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize("column", [lambda: pg.to_bool("maybe"), lambda: pg.int_div(1, 0), lambda: pg.substring("a", 1, -1), lambda: vectors.l2(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))])
def test_errors(spark, column):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, column())


def test_stream_counts(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    q = events.counts(events.read(spark, str(tmp_path / "in"), table)).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.w.start, r.event_type, r.n) for r in events.counts(table).collect()}
    assert {(r.w.start, r.event_type, r.n) for r in spark.table("counted").collect()} == want
