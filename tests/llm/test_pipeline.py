"""The pipeline's stages keep the columns of documents and take effect, on awkward rows too."""

import collections

import corpus_pipeline
import pytest
from millrace.llm import common, line_dedup, mixing, near_dedup, packing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, matches long, key string, cls string, size long, n_lines long, gone string, __copies string, kept string, root string"
_LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(12_000))
_BASE = "the quick brown fox jumps over the lazy dog while seven wizards box " * 3
ROWS = [
    (1, None, None, None), (2, "", "en", None), (3, " \n\t", "en", "a"), (4, _BASE, "en", "a"), (5, _BASE + "twice", "en", "b"), (6, _LONG, None, "b"), (None, "no id here", "en", "c"),
    (7, "same row", "en", "c"), (7, "same row", "en", "c"), (7, "same id but another text", "en", "c"), (8, "one\ntwo\none", "en", "a"), (9, "two\nthree", "en", "a"), (10, "vile vile vile", "en", "c"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.9, 7, "k", "c", 3, 4, "g", "x", "y", "z") for r in ROWS], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder whose labels make a model that calls "vile" toxic, and one without labels."""
    top = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(top / "some/labels.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(top / "none/labels.parquet"))
    return top


def texts(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


GIVEN = collections.Counter((r[0], r[1]) for r in ROWS)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_table(spark, rows, labelled, name, stage):
    out = stage(spark, rows.limit(0), str(labelled / "some"))
    assert out.count() == 0
    assert name == "packing" or out.columns == rows.columns


def test_toxicity(spark, rows, labelled):
    assert texts(toxicity.stage_toxicity(spark, rows, str(labelled / "none"))) == GIVEN
    taught = spark.createDataFrame([(1000 + i, f"some {'vile' if i % 2 else 'fine'} words here, number {i % 7}", "en", "t", 20) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    both = rows.unionByName(taught, allowMissingColumns=True)
    out = toxicity.stage_toxicity(spark, both, str(labelled / "some"))
    assert out.columns == both.columns
    kept = texts(out.filter("doc_id is null or doc_id < 1000"))
    assert kept == GIVEN - collections.Counter([(10, "vile vile vile")])
    assert {r.score for r in out.filter("doc_id = 4").collect()} == {0.9}  # a column of the input, not the stage's


def test_line_dedup(spark, rows, labelled):
    out = line_dedup.stage_line_dedup(spark, rows, "")
    assert out.columns == rows.columns
    kept = texts(out)
    # 5 is not within the threshold of 4; rows that repeat id and text are one document
    assert kept == GIVEN - collections.Counter([(8, ROWS[10][1]), (9, "two\nthree"), (10, "vile vile vile")]) + collections.Counter([(8, "one\ntwo"), (9, "three"), (10, "vile vile vile")])
    assert {r.doc_id: r.n_chars for r in out.collect()}[9] == 5


def test_near_dedup(spark, rows, labelled):
    out = near_dedup.stage_near_dedup(spark, rows, "")
    assert out.columns == rows.columns
    # 5 is a near copy of 4; 3 and 2 have no words and stay; one row of two equal ones stays
    assert texts(out) == GIVEN - collections.Counter([(5, ROWS[4][1]), (7, "same row")])


def test_mixing(spark, rows, labelled):
    out = mixing.stage_mixing(spark, rows, "")
    assert out.columns == rows.columns
    copies = texts(out)
    assert set(copies) <= set(GIVEN) and not {1, 2, 3} & {d for d, _ in copies}
    assert all(n <= 2 * GIVEN[x] for x, n in copies.items())
    assert texts(mixing.stage_mixing(spark, rows.repartition(5), "")) == copies


def test_packing(spark, rows, labelled):
    out = packing.stage_packing(spark, rows, "").collect()
    ends = collections.Counter(r.doc_id for r in out if r.piece == 0)
    assert ends == collections.Counter(r[0] for r in ROWS)
    used = collections.defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.Scratch(spark).keep(stage(spark, docs, folder))
        assert docs.columns == columns, name
        m = docs.count()
        assert 0 < m and (name == "mixing" or m <= n)
        n = m
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_registered():
    import __spark_entry__ as entry

    known = entry.queries()
    assert "pipeline" in known and {f"op{n}_" for n in range(1, 11)} == {f"{k.split('_')[0]}_" for k in known if k[:2] == "op" and k[2].isdigit()}
