"""Document expressions, filters, updates and stages on rows of a few values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.functions.documents import Scope, compiled
from tidewell.operators import filters


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Ada", 7, 2.5, [3, 1, 2], {"street": "Elm", "no": 4}, dt.datetime(2024, 2, 29, 13, 5, 9), [("x", 1), ("y", 2)], [8.5, 47.4]),
        (2, "bob", -3, None, [], {"street": None, "no": 9}, dt.datetime(2023, 12, 31, 0, 0, 0), [("x", 5)], [13.4, 52.5]),
        (3, None, None, 0.5, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "k int, name string, n int, x double, xs array<int>, at struct<street string, no int>, ts timestamp, kv array<struct<k string, v int>>, loc array<double>")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ({"$add": ["$n", 1, 2]}, 10), ({"$subtract": ["$n", 2]}, 5), ({"$multiply": ["$n", "$x"]}, 17.5), ({"$divide": ["$n", 2]}, 3.5), ({"$divide": ["$n", 0]}, None), ({"$mod": ["$n", 4]}, 3), ({"$abs": -4}, 4), ({"$ceil": "$x"}, 3), ({"$floor": "$x"}, 2),
        ({"$round": ["$x"]}, 2.0), ({"$round": [2.125, 2]}, 2.12), ({"$trunc": -2.7}, -2.0), ({"$sqrt": 9}, 3.0), ({"$pow": ["$n", 2]}, 49.0),
        ({"$concat": ["$name", "-", "z"]}, "Ada-z"), ({"$substr": ["$name", 1, 2]}, "da"), ({"$toLower": "$name"}, "ada"), ({"$toUpper": "$name"}, "ADA"), ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]), ({"$trim": {"input": "  q "}}, "q"), ({"$trim": {"input": "xqx", "chars": "x"}}, "q"), ({"$strLenCP": "$name"}, 3), ({"$indexOfCP": ["$name", "a"]}, 2), ({"$replaceAll": {"input": "aXa", "find": "a", "replacement": "b"}}, "bXb"), ({"$regexMatch": {"input": "$name", "regex": "^a", "options": "i"}}, True),
        ({"$size": "$xs"}, 3), ({"$slice": ["$xs", 2]}, [3, 1]), ({"$slice": ["$xs", -2]}, [1, 2]), ({"$slice": ["$xs", 1, 1]}, [1]), ({"$arrayElemAt": ["$xs", 0]}, 3), ({"$arrayElemAt": ["$xs", -1]}, 2), ({"$arrayElemAt": ["$xs", 9]}, None), ({"$concatArrays": ["$xs", [9]]}, [3, 1, 2, 9]),
        ({"$filter": {"input": "$xs", "as": "e", "cond": {"$gt": ["$$e", 1]}}}, [3, 2]), ({"$map": {"input": "$xs", "as": "e", "in": {"$multiply": ["$$e", "$n"]}}}, [21, 7, 14]), ({"$reduce": {"input": "$xs", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6), ({"$in": [1, "$xs"]}, True), ({"$isArray": "$xs"}, True), ({"$range": [0, 3]}, [0, 1, 2]),
        ({"$and": [True, {"$gt": ["$n", 1]}]}, True), ({"$or": [False, {"$lt": ["$n", 1]}]}, False), ({"$not": [False]}, True), ({"$eq": ["$n", 7]}, True), ({"$ne": ["$n", None]}, True), ({"$gte": ["$n", 7]}, True), ({"$lte": ["$n", 6]}, False), ({"$cmp": ["$n", 9]}, -1),
        ({"$cond": [{"$gt": ["$n", 5]}, "big", "small"]}, "big"), ({"$cond": {"if": False, "then": 1, "else": 2}}, 2), ({"$ifNull": [None, "$missing", "d"]}, "d"), ({"$switch": {"branches": [{"case": {"$lt": ["$n", 0]}, "then": "neg"}, {"case": True, "then": "pos"}], "default": "?"}}, "pos"), ({"$let": {"vars": {"a": 2}, "in": {"$add": ["$$a", "$n"]}}}, 9),
        ({"$toString": "$n"}, "7"), ({"$toInt": "12"}, 12), ({"$toLong": "x"}, None), ({"$toDouble": "1.5"}, 1.5), ({"$type": "$n"}, "int"), ({"$type": "$xs"}, "array"), ({"$type": "$at"}, "object"), ({"$year": "$ts"}, 2024), ({"$month": "$ts"}, 2), ({"$dayOfMonth": "$ts"}, 29), ({"$hour": "$ts"}, 13), ({"$minute": "$ts"}, 5), ({"$second": "$ts"}, 9), ({"$dayOfWeek": "$ts"}, 5), ({"$dateToString": {"date": "$ts", "format": "%Y-%m-%dT%H:%M"}}, "2024-02-29T13:05"), ({"$year": {"$toDate": "2020-05-06"}}, 2020),
        ("$at.street", "Elm"), ({"$getField": {"field": "no", "input": "$at"}}, 4), ({"$mergeObjects": ["$at", {"no": 5}]}, ("Elm", 5)), ({"$arrayToObject": "$kv"}, {"x": 1, "y": 2}), ({"$literal": "$n"}, "$n"), ("$$ROOT.name", "Ada"), ("$$CURRENT.n", 7), ([1, "$n"], [1, 7]), ({"a": "$n"}, (7,)),
    ],
)
def test_expression(docs, expression, want):
    got = docs.where("k = 1").select(compiled(expression, Scope(docs)).alias("v")).first()["v"]
    assert (tuple(got) if isinstance(got, tuple) else got) == want


def test_pairs_of_an_object(docs):
    got = docs.where("k = 1").select(compiled({"$objectToArray": "$at"}, Scope(docs)).alias("v")).first()["v"]
    assert [tuple(x) for x in got] == [("street", "Elm"), ("no", "4")]
    assert docs.select(compiled("$$NOW", Scope(docs)).alias("v")).first()["v"].year >= 2024
    with pytest.raises(ValueError):
        compiled({"$nosuch": 1}, Scope(docs))


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"name": {"$type": "string"}}, [1, 2]), ({"n": {"$bitsAllSet": 5}}, [1, 2]), ({"n": {"$bitsAnyClear": 2}}, [2]), ({"n": {"$bitsAllClear": 8}}, [1]), ({"xs": {"$all": [1, 3]}}, [1]), ({"xs": {"$size": 0}}, [2]), ({"kv": {"$elemMatch": {"k": "x", "v": {"$gt": 3}}}}, [2]), ({"n": {"$not": {"$gt": 0}}}, [2, 3]),
        ({"$expr": {"$gt": ["$n", "$x"]}}, [1]), ({"$expr": "n < 0"}, [2]), ({"$text": {"$search": "ada -bob"}}, []), ({"loc": {"$geoWithin": {"$box": [[5, 45], [10, 50]]}}}, [1]), ({"loc": {"$geoWithin": {"$center": [[13, 52], 1]}}}, [2]), ({"loc": {"$geoWithin": {"$centerSphere": [[8.5, 47.4], 0.001]}}}, [1]),
        ({"loc": {"$geoWithin": {"$polygon": [[0, 40], [10, 40], [10, 50], [0, 50]]}}}, [1]), ({"loc": {"$near": {"$geometry": {"type": "Point", "coordinates": [13.0, 52.0]}, "$maxDistance": 100000}}}, [2]), ({"loc": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[0, 40], [10, 40], [10, 50], [0, 50], [0, 40]]]}}}}, [1]),
        ({"$jsonSchema": {"required": ["name"], "properties": {"n": {"bsonType": "int", "minimum": 0}, "name": {"pattern": "^A"}, "xs": {"minItems": 1, "items": {"maximum": 3}}, "at": {"required": ["street"]}}}}, [1]),
    ],
)
def test_filter(docs, spec, want):
    docs = docs.withColumn("text", F.lit("plain words"))
    assert sorted(r["k"] for r in docs.where(filters.matches(spec)).collect()) == want


def test_update_sees_the_row_as_it_was(spark):
    df = spark.createDataFrame([("a", 0), ("b", 5)], "st string, n int")
    got = filters.update(df, {"st": "a"}, {"$set": {"st": "b", "n": 1}}).collect()
    assert sorted(map(tuple, got)) == [("b", 1), ("b", 5)]
    got = filters.update(df, {"n": 5}, {"$inc": {"n": 2}, "$mul": {"n": 10}, "$rename": {"st": "s"}})
    assert got.columns == ["st", "n", "s"] and sorted(map(tuple, got.collect()), key=str) == [("a", 0, None), (None, 70, "b")]
    assert filters.update(df, {}, {"$unset": {"n": ""}}).columns == ["st"]
    assert [r["n"] for r in filters.update(df, {"st": "b"}, {"$unset": {"n": ""}}).orderBy("st").collect()] == [0, None]


def test_update_of_parts(docs):
    one = lambda change, where=None, **more: filters.update(docs, {"k": 1} | (where or {}), change, **more).where("k = 1").first()
    assert one({"$set": {"at.no": 12}})["at"]["no"] == 12
    assert one({"$inc": {"xs.$[]": 1}})["xs"] == [4, 2, 3]
    assert one({"$set": {"xs.$[e]": 0}}, array_filters=[{"e": {"$gte": 2}}])["xs"] == [0, 1, 0]
    assert [x["v"] for x in one({"$set": {"kv.$[e].v": 9}}, array_filters=[{"e.k": "y"}])["kv"]] == [1, 9]
    assert one({"$set": {"xs.$": 50}}, {"xs": {"$elemMatch": {"$lt": 3}}})["xs"] == [3, 50, 2]
    assert one({"$addToSet": {"xs": {"$each": [1, 8]}}})["xs"] == [3, 1, 2, 8]


def test_upsert_inserts_when_nothing_matches(spark):
    df = spark.createDataFrame([(1, "a", 0)], "k int, v string, made int")
    change = {"$set": {"v": "z"}, "$setOnInsert": {"made": 7}}
    assert sorted(map(tuple, filters.upsert_where(df, {"k": 2}, change).collect())) == [(1, "a", 0), (2, "z", 7)]
    assert sorted(map(tuple, filters.upsert_where(df, {"k": 1}, change).collect())) == [(1, "z", 0)]


@pytest.fixture(scope="module")
def shop(spark):
    e = Engine(spark)
    e.catalog.put("sales", spark.createDataFrame([(1, "pen", 3, "n"), (2, "pen", 5, "s"), (3, "ink", 9, "n"), (4, "cap", 1, "s")], "id int, item string, q int, region string"))
    e.catalog.put("stock", spark.createDataFrame([("pen", "p1", 10), ("pen", "p2", 1), ("ink", "i1", 4)], "sku string, place string, n int"))
    e.catalog.put("staff", spark.createDataFrame([("ann", None), ("ben", "ann"), ("cat", "ben"), ("dan", "cat")], "who string, boss string"))
    return e


def test_stages(shop):
    run = lambda *stages: shop.aggregate("sales", list(stages)).collect()
    (f,) = run({"$facet": {"top": [{"$sort": {"q": -1}}, {"$limit": 1}, {"$project": {"item": 1}}], "per": [{"$group": {"_id": "$item", "n": {"$sum": 1}}}], "all": [{"$count": "n"}]}})
    assert [r["item"] for r in f["top"]] == ["ink"] and {(r["_id"], r["n"]) for r in f["per"]} == {("pen", 2), ("ink", 1), ("cap", 1)} and f["all"][0]["n"] == 4
    got = run({"$sort": {"q": 1}}, {"$group": {"_id": {"r": "$region"}, "first": {"$first": "$item"}, "last": {"$last": "$item"}, "all": {"$addToSet": "$item"}, "mean": {"$avg": {"$multiply": ["$q", 2]}}}})
    assert {(r["r"], r["first"], r["last"], r["mean"]) for r in got} == {("n", "pen", "ink", 12.0), ("s", "cap", "pen", 6.0)}
    got = run({"$lookup": {"from": "stock", "localField": "item", "foreignField": "sku", "as": "have"}}, {"$project": {"id": 1, "n": {"$size": "$have"}}})
    assert {tuple(r) for r in got} == {(1, 2), (2, 2), (3, 1), (4, 0)}
    got = run({"$lookup": {"from": "stock", "let": {"i": "$item", "q": "$q"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$sku", "$$i"]}, {"$gte": ["$n", "$$q"]}]}}}, {"$project": {"place": 1}}], "as": "enough"}})
    assert {r["id"]: [x["place"] for x in r["enough"]] for r in got} == {1: ["p1"], 2: ["p1"], 3: [], 4: []}
    got = run({"$lookup": {"from": "stock", "let": {"i": "$item"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$sku", "$$i"]}}}, {"$sort": {"n": 1}}, {"$limit": 1}], "as": "least"}})
    assert {r["id"]: [x["place"] for x in r["least"]] for r in got} == {1: ["p2"], 2: ["p2"], 3: ["i1"], 4: []}
    got = shop.aggregate("staff", [{"$graphLookup": {"from": "staff", "startWith": "$boss", "connectFromField": "boss", "connectToField": "who", "as": "above", "depthField": "d", "maxDepth": 1}}]).collect()
    assert {r["who"]: {(x["who"], x["d"]) for x in r["above"]} for r in got} == {"ann": set(), "ben": {("ann", 0)}, "cat": {("ben", 0), ("ann", 1)}, "dan": {("cat", 0), ("ben", 1)}}
    assert {r["id"] for r in run({"$redact": {"$cond": [{"$eq": ["$region", "n"]}, "$$KEEP", "$$PRUNE"]}})} == {1, 3}
    assert [tuple(r) for r in run({"$match": {"id": 3}}, {"$replaceRoot": {"newRoot": {"a": "$item", "b": {"$add": ["$q", 1]}}}})] == [("ink", 10)]
    assert len(run({"$unionWith": "stock"})) == 7 and {r["bucket"]: r["n"] for r in run({"$bucket": {"groupBy": "$q", "boundaries": [0, 4, 8], "default": -1, "output": {"n": {"$sum": 1}}}})} == {0: 2, 4: 1, -1: 1}
    assert [r["id"] for r in run({"$sort": {"id": 1}}, {"$skip": 1}, {"$limit": 2})] == [2, 3] and run({"$project": {"q": 0, "region": 0}}, {"$unset": "item"})[0].asDict().keys() == {"id"}
    assert run({"$sample": {"size": 2}}).__len__() == 2
    with pytest.raises(ValueError):
        run({"$nosuch": 1})


def test_redact_descends(spark):
    df = spark.createDataFrame([(1, [(1, "low"), (5, "high")])], "level int, parts array<struct<level int, t string>>")
    got = filters.aggregate(df, [{"$redact": {"$cond": [{"$lte": ["$level", 3]}, "$$DESCEND", "$$PRUNE"]}}]).first()
    assert [x["t"] for x in got["parts"]] == ["low"]
