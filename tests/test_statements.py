"""Statements that change tables, versions, views, spellings that Spark's SQL lacks, JSON that is changed."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.functions import jsons
from tidewell.plans import dml
from tidewell.sources import catalog as sources


@pytest.fixture()
def e(spark):
    out = Engine(spark)
    out.catalog.put("stuff", spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, None, 30.0)], "id int, name string, price double"))
    return out


def rows(e, name="stuff"):
    return sorted(map(tuple, e.catalog.resolve(name).collect()), key=str)


def test_insert_update_delete(e):
    assert e.sql("INSERT INTO stuff (id, name) VALUES (4, 'd;x'), (5, upper('e'))").first()["rows"] == 2
    assert rows(e)[3:] == [(4, "d;x", None), (5, "E", None)]
    assert e.sql("INSERT INTO stuff SELECT id + 10, name, price FROM stuff WHERE id < 3").first()["rows"] == 2
    assert e.sql("UPDATE stuff SET price = price * 2, name = coalesce(name, 'none') WHERE id IN (2, 3)").first()["rows"] == 2
    assert {(2, "b", 40.0), (3, "none", 60.0)} <= set(rows(e))
    assert [tuple(r) for r in e.sql("DELETE FROM stuff WHERE id > 3 AND id < 12 RETURNING id").orderBy("id").collect()] == [(4,), (5,), (11,)]
    assert [r[0] for r in rows(e)] == [1, 12, 2, 3]
    assert e.sql("UPDATE stuff SET price = NULL").first()["rows"] == 4 and e.sql("SELECT count(price) AS n FROM stuff").first()["n"] == 0
    assert [r[2] for r in sorted(map(tuple, e.catalog.at_version("stuff", 0).collect()))] == [10.0, 20.0, 30.0]
    e.sql("UPDATE stuff AS s SET name = o.label FROM (SELECT 1 AS k, 'new' AS label) o WHERE o.k = s.id")
    assert e.sql("SELECT name FROM stuff WHERE id = 1").first()["name"] == "new"
    with pytest.raises(dml.StatementError):
        e.sql("UPDATE stuff SET nosuch = 1")


def test_upsert_statements(e):
    assert e.sql("INSERT INTO stuff VALUES (1, 'z', 5.0), (9, 'n', 1.0) ON CONFLICT (id) DO NOTHING").first()["rows"] == 1
    assert e.sql("INSERT INTO stuff VALUES (1, 'z', 5.0), (8, 'm', 2.0) ON CONFLICT (id) DO UPDATE SET name = excluded.name, price = price + excluded.price").first()["rows"] == 2
    assert set(rows(e)) == {(1, "z", 15.0), (2, "b", 20.0), (3, None, 30.0), (8, "m", 2.0), (9, "n", 1.0)}
    with pytest.raises(dml.StatementError):
        e.sql("INSERT INTO stuff VALUES (7, 'z', 5.0), (7, 'n', 1.0) ON CONFLICT (id) DO NOTHING")


def test_tables_with_rules(e):
    e.sql("CREATE TABLE part (id INT PRIMARY KEY, kind STRING DEFAULT 'x', n INT CHECK (n > 0), owner INT REFERENCES stuff(id), UNIQUE (kind, n))")
    e.sql("INSERT INTO part (id, n, owner) VALUES (1, 5, 2)")
    assert rows(e, "part") == [(1, "x", 5, 2)]
    for bad in ("(1, 'y', 5, 2)", "(2, 'y', 0, 2)", "(2, 'y', 5, 77)", "(2, 'x', 5, 2)", "(NULL, 'q', 5, 2)"):
        with pytest.raises(dml.StatementError):
            e.sql(f"INSERT INTO part VALUES {bad}")
    assert len(rows(e, "part")) == 1
    e.sql("ALTER TABLE part ADD COLUMN note STRING DEFAULT 'hi'")
    e.sql("ALTER TABLE part RENAME COLUMN note TO remark")
    e.sql("ALTER TABLE part ALTER COLUMN n TYPE BIGINT")
    assert dict(e.catalog.resolve("part").dtypes)["n"] == "bigint" and rows(e, "part")[0][-1] == "hi"
    e.sql("ALTER TABLE part DROP COLUMN remark")
    e.sql("CREATE INDEX ON part (n)")
    assert e.sql("TRUNCATE TABLE part").first()["rows"] == 1 and rows(e, "part") == []
    e.sql("CREATE TABLE few AS SELECT id FROM stuff WHERE id < 3")
    e.sql("CREATE TABLE IF NOT EXISTS few (a INT)")
    assert len(rows(e, "few")) == 2 and e.sql("DROP TABLE few") is not None and not e.catalog.known("few")
    with pytest.raises(dml.StatementError):
        e.sql("DROP TABLE few")


def test_views_and_refresh(e):
    e.sql("CREATE MATERIALIZED VIEW total AS SELECT sum(price) AS s FROM stuff")
    e.sql("INSERT INTO stuff VALUES (4, 'd', 40.0)")
    assert e.sql("SELECT s FROM total").first()["s"] == 60.0
    e.sql("REFRESH MATERIALIZED VIEW total")
    assert e.sql("SELECT s FROM total").first()["s"] == 100.0
    e.sql("CREATE VIEW dear AS SELECT id FROM stuff WHERE price > 25")
    assert e.sql("SELECT count(*) AS n FROM dear").first()["n"] == 2


def test_copy_and_files(e, tmp_path):
    assert e.sql(f"COPY stuff TO '{tmp_path}/out' (FORMAT csv, HEADER true)").first()["rows"] == 3
    e.sql("CREATE TABLE back (id INT, name STRING, price DOUBLE)")
    assert e.sql(f"COPY back FROM '{tmp_path}/out' WITH (FORMAT csv, HEADER true)").first()["rows"] == 3 and rows(e, "back") == rows(e)
    e.sql(f"COPY (SELECT id FROM stuff WHERE id = 2) TO '{tmp_path}/bin' (FORMAT binary)")
    assert [tuple(r) for r in e.spark.read.parquet(f"{tmp_path}/bin").collect()] == [(2,)]
    sources.to_arrow_file(e.catalog.resolve("stuff"), str(tmp_path / "f.arrow"))
    assert sorted(map(tuple, sources.from_arrow_file(e.spark, str(tmp_path / "f.arrow")).collect()), key=str) == rows(e)
    con = sources.to_duckdb(e.catalog.resolve("stuff"), "t")
    assert con.sql("SELECT sum(price) FROM t").fetchall() == [(60.0,)]
    assert [tuple(r) for r in sources.from_duckdb(e.spark, con, "SELECT id FROM t WHERE id = 3").collect()] == [(3,)]
    sources.save(e.catalog.resolve("stuff"), str(tmp_path / "j"), "json")
    good, bad = sources.imported(e.spark, str(tmp_path / "j"), "json", {"name": "label"}, {"price": "price / 10"}, {"id": (e.spark.createDataFrame([(1,), (3,)], "id int"), "id")}, "id int, name string, price double")
    assert sorted(r["price"] for r in good.collect()) == [1.0, 3.0] and [r["id"] for r in bad.collect()] == [2] and "label" in good.columns


def test_spellings(e):
    ids = lambda cond: sorted(r["id"] for r in e.sql(f"SELECT id FROM stuff WHERE {cond}").collect())
    assert ids("price >= ALL (SELECT price FROM stuff)") == [3] and ids("price > ANY (SELECT price FROM stuff WHERE id < 3)") == [2, 3]
    assert ids("price < ALL (SELECT price FROM stuff WHERE id > 99)") == [1, 2, 3] and ids("price < ANY (SELECT price FROM stuff WHERE id > 99)") == []
    assert ids("id = ANY (SELECT 2)") == [2] and ids("id <> ALL (SELECT 2)") == [1, 3] and ids("(id, name) = (SELECT 2, 'b')") == [2]
    got = e.sql("SELECT id, row_number() OVER (ORDER BY price DESC) AS r FROM stuff QUALIFY row_number() OVER (ORDER BY price DESC) <= 2 ORDER BY id DESC")
    assert [tuple(r) for r in got.collect()] == [(3, 1), (2, 2)]
    j = "(SELECT '{\"a\": {\"b\": [10, 20]}, \"t\": \"x\"}' AS j) d"
    assert tuple(e.sql(f"SELECT j->'a'->'b'->>1 AS x, j->>'t' AS y, j #>> '{{a,b,0}}' AS z FROM {j}").first()) == ("20", "x", "10")
    assert tuple(e.sql(f"SELECT j @> '{{\"t\": \"x\"}}' AS a, j ? 't' AS b, j ?| '{{q,t}}' AS c, j ?& '{{q,t}}' AS d FROM {j}").first()) == (True, True, True, False)
    assert json.loads(e.sql(f"SELECT jsonb_set(j, '{{a,b,0}}', '5') AS v FROM {j}").first()["v"]) == {"a": {"b": [5, 20]}, "t": "x"}
    assert json.loads(e.sql(f"SELECT j #- '{{a,b,0}}' AS v FROM {j}").first()["v"]) == {"a": {"b": [20]}, "t": "x"}


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1, 2]}',), (None,), ("no json",)], "j string")
    one = lambda name, *args: [r["v"] for r in df.select(jsons.column(name)(F.col("j"), *map(F.lit, args)).alias("v")).collect()]
    assert one("jsonb_set", "{c}", "true") == ['{"a":1,"b":[1,2],"c":true}', None, None]
    assert one("jsonb_insert", "{b,1}", "9")[0] == '{"a":1,"b":[1,9,2]}' and one("jsonb_insert", "{a}", "9")[0] == '{"a":1,"b":[1,2]}'
    assert one("jsonb_delete", "a")[0] == '{"b":[1,2]}' and one("jsonb_merge", '{"a": 2, "z": null}')[0] == '{"a":2,"b":[1,2],"z":null}'
    assert one("jsonb_contains", '{"b": [2]}') == [True, None, None] and one("jsonb_contains", '{"b": [3]}')[0] is False
    assert one("jsonb_object_keys")[0] == ["a", "b"] and one("jsonb_typeof")[0] == "object" and one("jsonb_array_length")[0] is None


def test_functions_of_users(e):
    e.function("twice", "(x INT) RETURNS INT RETURN x * 2")
    e.function("shout", lambda s: None if s is None else s.upper() + "!", "string")
    assert tuple(e.sql("SELECT twice(id) AS a, shout(name) AS b FROM stuff WHERE id = 2").first()) == (4, "B!")
    from pyspark.sql.functions import pandas_udf, udtf

    def middle(v: pd.Series) -> float:
        return float(v.median())

    e.function("middle", pandas_udf(middle, "double"))
    assert e.sql("SELECT middle(price) AS m FROM stuff").first()["m"] == 20.0

    @udtf(returnType="n: int")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    e.function("upto", Upto)
    assert e.sql("SELECT n FROM upto(3)").count() == 3
    assert [r["x"] for r in e.pql("QUERY stuff WHERE id = 2 COMPUTE x = twice(id) SELECT x").collect()] == [4]


def test_engine_surface(e, spark):
    e.put("stuff", spark.createDataFrame([(2, "bb", 0.0), (7, "g", 7.0)], "id int, name string, price double"), "id")
    assert {(2, "bb", 0.0), (7, "g", 7.0)} <= set(rows(e)) and len(rows(e)) == 4
    e.update("stuff", {"id": 7}, {"$inc": {"price": 1}})
    e.delete("stuff", {"id": {"$lt": 3}})
    assert rows(e) == [(3, None, 30.0), (7, "g", 8.0)]
    assert [r["id"] for r in e.find("stuff", {"price": {"$gt": 1}}, limit=1, offset=1).collect()]
    e.catalog.tag("stuff", "good")
    e.sql("DELETE FROM stuff")
    assert e.catalog.at_version("stuff", "good").count() == 2 and e.catalog.vacuum("stuff") > 0 and e.catalog.at_version("stuff", "good").count() == 2
    assert e.prepare("SELECT id FROM range(5) WHERE id = :k")(k=3).first()["id"] == 3
    assert sum(b.num_rows for b in e.stream(spark.range(25), 10)) == 25
    assert "Range" in e.explain(spark.range(3)) and "Range" in e.explain(spark.range(3), "analyze")
    e.catalog.put("other.stuff", spark.createDataFrame([(1,)], "id int"))
    assert e.catalog.wildcard(table="stuff").count() == 1 and sources.tenant(spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant string, v int"), "t2").first()["v"] == 2


def test_edges_shards_and_order(spark):
    old = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0)], "src int, dst int, weight double")
    more = spark.createDataFrame([(1, 2, 7.0, 1), (1, 2, 9.0, 0), (4, 5, 2.0, 0)], "src int, dst int, weight double, seq int")
    assert sorted(map(tuple, sources.add_edges(old, more, "seq").collect())) == [(1, 2, 7.0), (2, 3, 1.0), (4, 5, 2.0)]
    assert [tuple(r) for r in sources.delete_edges(old, more).collect()] == [(2, 3, 1.0)]
    dealt = sources.resharded(spark.range(100), "id", 4)
    assert dealt.select("shard", F.spark_partition_id().alias("p")).distinct().count() == 4 and dealt.count() == 100
    points = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    assert sorted(map(tuple, sources.clustered(points, ["x", "y"], 3).collect())) == sorted(map(tuple, points.collect()))


def test_maps_of_meta(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "k int, meta map<string,string>")
    assert sources.merge_meta(df, {"b": "3", "c": "4"}).first()["meta"] == {"a": "1", "b": "3", "c": "4"}
    assert sources.drop_meta(df, ["a"]).first()["meta"] == {"b": "2"}


def test_vectors_by_name(spark):
    e = Engine(spark)
    kind = "id int, embedding array<double>, meta map<string,string>"
    e.put_vectors("near.a", spark.createDataFrame([(1, [1.0, 0.0], {"c": "x"}), (2, [0.0, 1.0], {"c": "y"})], kind))
    e.put_vectors("near.a", spark.createDataFrame([(2, [0.6, 0.8], {"c": "y"}), (3, [0.9, 0.1], {"c": "y"})], kind))
    e.put_vectors("far.a", spark.createDataFrame([(4, [1.0, 0.01], {"c": "x"})], kind))
    with pytest.raises(Exception, match="dimension mismatch"):
        e.put_vectors("near.a", spark.createDataFrame([(9, [1.0], {})], kind))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert e.vector("near.a", 2).first()["embedding"] == [0.6, 0.8] and ids(e.search("near.a", [1.0, 0.0], 2)) == [1, 3]
    assert ids(e.search("near.a", [1.0, 0.0], 1, meta={"c": "y"})) == [3] and ids(e.search("near.a", [1.0, 0.0], 1, where={"id": {"$gt": 3}})) == []
    assert ids(e.search("near.a", [1.0, 0.0], 1, ids=spark.createDataFrame([(2,)], "id int"))) == [2] and ids(e.search(None, [1.0, 0.0], 2)) == [1, 4] and ids(e.search("far.*", [1.0, 0.0])) == [4]


def test_partitions_chunks_and_times(spark):
    import datetime

    df = spark.createDataFrame([(1, 5), (2, 15), (3, 99), (4, None)], "k int, v int")
    named = lambda **how: {r["k"]: r["part"] for r in sources.partitioned(df, "v", **how).collect()}
    assert named(ranges={"low": (None, 10), "mid": (10, 50)}) == {1: "low", 2: "mid", 3: "default", 4: "default"}
    assert named(lists={"odd": [5, 99]}, default="rest") == {1: "odd", 2: "rest", 3: "odd", 4: "rest"}
    assert {v for k, v in named(hashes=2).items() if k < 4} <= {"h0", "h1"}
    blobs = spark.createDataFrame([("a", bytes(range(256)) * 5), ("b", b""), ("c", b"x" * 100)], "name string, content binary")
    parts = sources.chunked(blobs, "name", size=100)
    assert parts.count() == 13 + 1 + 1 and {r["name"]: bytes(r["content"]) for r in sources.unchunked(parts, "name").collect()} == {r["name"]: bytes(r["content"]) for r in blobs.collect()}
    e = Engine(spark)
    e.sql("CREATE TABLE log AS SELECT 1 AS a")
    before = datetime.datetime.now()
    e.sql("INSERT INTO log VALUES (2)")
    assert e.catalog.at_time("log", before).count() == 1 and e.catalog.at_time("log", datetime.datetime.now()).count() == 2
