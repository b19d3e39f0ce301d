"""Languages, updates, schema rules and streams on fixtures of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.operators import filters, joins
from tidewell.plans.pql import PqlError, tokens
from tidewell.streaming import streams


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.catalog.put("users", spark.createDataFrame([("1", "Alice", 30, "US"), ("2", "Bob", 25, "EU")], "_id string, name string, age long, country string"))
    e.catalog.put("products", spark.createDataFrame([("1", "Laptop", 100, 0.1)], "_id string, name string, price long, tax_rate double"))
    e.catalog.put("vecs", spark.createDataFrame([("first", [1.0, 0.0, 0.0]), ("second", [0.9, 0.1, 0.0]), ("third", [0.0, 1.0, 0.0])], "id string, embedding array<float>"))
    e.catalog.put("edges", spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "src string, dst string, weight double"))
    e.catalog.put("nodes", spark.createDataFrame([("A",)], "id string"))
    return e


def test_pql_where_select(engine):
    assert [tuple(r) for r in engine.pql("QUERY users WHERE age > 26 SELECT name, age").collect()] == [("Alice", 30)]


def test_pql_compute(engine):
    assert abs(engine.pql("QUERY products COMPUTE total = price * (1.0 + tax_rate)").first()["total"] - 110.0) < 1e-9


def test_pql_similar_and_traverse(engine):
    assert [r["id"] for r in engine.pql("QUERY vecs SIMILAR TO [1.0, 0.0, 0.0] TOP 2").collect()] == ["first", "second"]
    assert {(r["node"], r["depth"]) for r in engine.pql("QUERY nodes TRAVERSE edges DEPTH 1 TO 2").collect()} == {("B", 1), ("C", 2)}


def test_pql_case_parentheses_comment(engine):
    got = engine.pql("QUERY users WHERE (age > 26 AND age < 40) OR name = 'x' /* c */ SELECT CASE WHEN age > 28 THEN 'old' ELSE 'young' END AS k").collect()
    assert [r["k"] for r in got] == ["old"]


def test_pql_errors(engine):
    for text in ("SELECT 1", "QUERY users WHERE", "QUERY users NOSUCH(", "QUERY users WHERE nosuch(1) > 2"):
        with pytest.raises(PqlError):
            engine.pql(text)
    with pytest.raises(PqlError):
        tokens("a ? b")


def test_division_by_zero_is_null(engine):
    assert engine.pql("QUERY users COMPUTE x = age / 0 SELECT x").first()["x"] is None


def test_find_missing_field_fails(engine, spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert [r["k"] for r in df.where(filters.matches({"v": {"$ne": 4}})).collect()] == [2]
    assert [r["k"] for r in df.where(filters.matches({"v": {"$exists": False}})).collect()] == [1]
    with pytest.raises(ValueError):
        filters.matches({"v": {"$nosuch": 1}})


def test_array_updates(spark):
    df = spark.createDataFrame([(1, [3, 1])], "k int, a array<int>")
    put = lambda change: filters.update(df, {"k": 1}, change).first()["a"]
    assert put({"$push": {"a": 2}}) == [3, 1, 2]
    assert put({"$push": {"a": {"$each": [9, 8], "$position": 1, "$slice": 3}}}) == [3, 9, 8]
    assert put({"$pull": {"a": 3}}) == [1]
    assert put({"$addToSet": {"a": 3}}) == [3, 1]
    assert put({"$pop": {"a": 1}}) == [3]


def test_asof_takes_last_at_or_before(spark):
    t = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    q = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 6, 3.0)], "k string, t int, p double")
    assert {(r["k"], r["t"], r["p"]) for r in joins.asof_join(t, q, "t", ["k"], ["p"]).collect()} == {("a", 5, 2.0), ("a", 1, None), ("b", 9, None)}


def test_change_stream_applies(spark, tmp_path):
    schema = "k int, v string, version long, deleted boolean"
    for i, rows in enumerate([[(1, "a", 1, False), (2, "b", 2, False)], [(1, "c", 3, False), (2, None, 4, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = streams.watch(spark, str(tmp_path / "log"), schema)
        streams.apply_changes(stream, str(tmp_path / "table"), "k", "version", str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "table/v=1")).collect()] == [(1, "c")]


def test_windowed_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:01:05', 'a'").write.parquet(str(tmp_path / "ev"))
    df = streams.windowed(streams.watch(spark, str(tmp_path / "ev"), "ts timestamp, k string"), "ts", "1 minute", ["k"], [F.count("*").alias("n")])
    df.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("wins").count() == 2


@pytest.mark.parametrize("width", [None, 3, 1000])
def test_asof_over_stretches(spark, width):
    rng = random.Random(7)
    left = [(rng.choice("abc"), rng.randrange(60), i) for i in range(80)]
    right = [(rng.choice("ab"), rng.randrange(60), float(i)) for i in range(25)]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, p double")
    want = {i: max(((u, p) for q, u, p in right if q == k and u <= t), default=(0, None))[1] for k, t, i in left}
    assert {r["i"]: r["p"] for r in joins.asof_join(a, b, "t", ["k"], ["p"], width=width).collect()} == want


def test_intervals_of_all_widths(spark):
    rng = random.Random(8)
    points, spans = [rng.randrange(5000) for _ in range(200)], [(i, s, s + rng.choice([0, 1, 7, 90, 3000])) for i, s in enumerate(rng.randrange(5000) for _ in range(40))]
    got = joins.interval_join(spark.createDataFrame([(p, j) for j, p in enumerate(points)], "p int, j int"), spark.createDataFrame(spans, "i int, a int, b int"), "p", "a", "b", 2, fan=3)
    assert sorted((r["j"], r["i"]) for r in got.collect()) == sorted((j, i) for j, p in enumerate(points) for i, a, b in spans if a <= p < b)


def test_stateful_streams(spark, tmp_path):
    for i, rows in enumerate([[("a", 1), ("b", 5)], [("a", 2)], [("a", 4), ("a", 4)]]):
        spark.createDataFrame(rows, "k string, v long").selectExpr("k", "v", f"timestamp'2024-01-01 00:00:0{i}' AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.watch(spark, str(tmp_path / "in"), "k string, v long, ts timestamp", per_trigger=1)
    sums = streams.folded(stream, ["k"], lambda old, rows: (old[0] + int(rows["v"].sum()), old[1] + len(rows)), "total long, n long", "k string, total long, n long", (0, 0))
    sums.writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("folded").collect()} >= {("a", 11, 4), ("b", 5, 1)}
    first = streams.distinct_within(stream, "ts", ["k"])
    first.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_time_limit(engine, spark):
    assert engine.within(60, lambda: spark.range(10).count()) == 10
    with pytest.raises(Exception, match="cancel"):
        engine.within(1, lambda: spark.range(1 << 44).selectExpr("sum(hash(id) % 7)").collect())
