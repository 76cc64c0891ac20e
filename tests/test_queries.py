"""Each registered query against its SQL."""

import compare
import pytest

from eventloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, db, name):
    assert compare.of_spark(QUERIES[name](spark, SF)) == compare.of_sql(db, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    from eventloom import queries
    from eventloom.operators import search

    found = search.select(queries.events(spark, SF), "?event_type = :error AND ?value > 100.0", ["float:value"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in text and "GreaterThan(value,100.0)" in text
    assert "props" not in text.split("ReadSchema")[1]


def test_minhash_of_different_sets(spark):
    """The query's slots are the operator's own; similarities of different sources are near the exact Jaccard ones."""
    import inspect

    from pyspark.sql import functions as F

    from eventloom import queries
    from eventloom.operators import stats

    assert "64" not in inspect.getsource(queries.minhash_self)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null")
    words = docs.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).distinct()
    sets = {}
    for r in words.collect():
        sets.setdefault(r.lang, set()).add(r.term)
    names = sorted(sets)[:3]
    signatures = {x: stats.minhash(words.where(F.col("lang") == x)).cache() for x in names}
    assert len(names) > 1
    for a, b in zip(names, names[1:], strict=False):
        exact = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert 0 < exact < 1 and abs(stats.similarity(signatures[a], signatures[b]).first()[0] - exact) < 0.0625


def test_places_are_numbered_in_ranges(spark):
    """No window holds all rows; places are right with missing values, ties, NaN and more rows than borders."""
    from pyspark.sql import functions as F

    from eventloom import queries
    from eventloom.operators import search

    plan = queries.sort_reverse(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(__range" in plan and "Sort" not in plan.split("row_number()")[0]
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 1000).cast("double")).alias("x"), F.when(F.col("id") % 5 > 0, F.lit("b")).alias("s"))
    rows = rows.withColumn("x", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("x")))
    for descending in (False, True):
        keys = [F.col("s"), F.col("x"), F.col("id")]
        found = search.places(rows, keys, descending, "n").collect()
        ordered = rows.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_first() for c in keys]).collect()
        assert [r.id for r in sorted(found, key=lambda r: r.n)] == [r.id for r in ordered] and sorted(r.n for r in found) == list(range(1, 40_001))
    assert search.places(rows.where("id < 0"), keys, True, "n").count() == 0


def test_postings_shuffle_no_words(spark):
    """Two texts of one event, none and blank ones; the only shuffle is of whole texts."""
    from pyspark.sql import functions as F

    from eventloom.operators import postings
    from eventloom.types import FieldId

    rows = spark.createDataFrame([(1, "b a b"), (1, "a c"), (None, "x"), (None, "x y"), (2, None), (3, "  "), (4, "A")], "event_id long, t string")
    found = postings.of_field(rows, FieldId.of("text:m"), F.col("t"))
    assert sorted((r.event_id or 0, r.term, r.positions) for r in found.collect()) == [(0, "x", [0, 0]), (0, "y", [1]), (1, "a", [0, 1]), (1, "b", [0, 2]), (1, "c", [1]), (4, "a", [0])]
    shuffles = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert shuffles and not any("term" in line for line in shuffles)


def test_minhash_has_few_rows_for_each_term(spark):
    """Slots are aggregates of a block's row; the signature is that of rows of slots, and none without terms."""
    from pyspark.sql import functions as F

    from eventloom.operators import stats

    terms = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), (None, 1)], "term string, half int")
    found = stats.minhash(terms, ["half"], 5)
    slow = terms.where("term is not null").select("half", F.posexplode(F.expr("transform(sequence(1, 5), i -> xxhash64(i, term))")).alias("slot", "h")).groupBy("half", "slot").agg(F.min("h").alias("least"))
    assert sorted(found.collect()) == sorted(slow.collect()) and found.count() == 10
    assert stats.minhash(terms.where("half > 1")).count() == 0
    assert stats.minhash(terms)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [__block") == 1
