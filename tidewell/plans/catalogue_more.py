"""More registered queries: document expressions, statements, the pipeline language's longer forms, JSON, sources, vectors, text and sessions."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.functions import jsons, text, vectors
from tidewell.functions.documents import Scope, compiled
from tidewell.operators import graph, joins
from tidewell.plans.catalogue import _EDGES, _Q, _TERMS, both, edges, pipeline_query, query
from tidewell.sources import catalog
from tidewell.sources.stages import shared_folder
from tidewell.streaming import streams


def made(e: Engine, table: str, key: str, /, **expressions: Any) -> DataFrame:
    df = e.catalog.resolve(table)
    return df.select(key, *[compiled(x, Scope(df)).alias(k) for k, x in expressions.items()])


# document expressions, a family a query
@query("""SELECT o_orderkey, o_totalprice + o_custkey + 1 AS a, o_totalprice - o_custkey AS b, o_custkey * 3 AS c, o_custkey / 4.0::DOUBLE AS d, o_custkey % 7 AS e, abs(o_custkey - 500) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS g, CAST(floor(o_totalprice) AS BIGINT) AS h,
    round(sqrt(o_totalprice), 6) AS i, power(o_custkey, 2) AS j, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS k FROM orders""")
def expr_arithmetic(e: Engine) -> DataFrame:
    out = made(e, "orders", "o_orderkey", a={"$add": ["$o_totalprice", "$o_custkey", 1]}, b={"$subtract": ["$o_totalprice", "$o_custkey"]}, c={"$multiply": ["$o_custkey", 3]}, d={"$divide": ["$o_custkey", 4]}, e={"$mod": ["$o_custkey", 7]}, f={"$abs": {"$subtract": ["$o_custkey", 500]}},
               g={"$ceil": "$o_totalprice"}, h={"$floor": "$o_totalprice"}, i={"$sqrt": "$o_totalprice"}, j={"$pow": ["$o_custkey", 2]}, k={"$round": ["$o_totalprice"]})
    return out.withColumn("i", F.round("i", 6))


@query("""SELECT p_partkey, p_brand || '/' || p_name AS a, substr(p_name, 2, 4) AS b, upper(p_type) AS c, lower(p_brand) AS d, string_split(p_name, ' ')[1] AS e, length(p_name) AS f, instr(p_name, 'ring') - 1 AS g, replace(p_name, 'small', 'tiny') AS h, regexp_matches(p_name, '^s') AS i, trim(p_type) AS j FROM part""")
def expr_strings(e: Engine) -> DataFrame:
    out = made(e, "part", "p_partkey", a={"$concat": ["$p_brand", "/", "$p_name"]}, b={"$substr": ["$p_name", 1, 4]}, c={"$toUpper": "$p_type"}, d={"$toLower": "$p_brand"}, e={"$arrayElemAt": [{"$split": ["$p_name", " "]}, 0]}, f={"$strLenCP": "$p_name"}, g={"$indexOfCP": ["$p_name", "ring"]},
               h={"$replaceAll": {"input": "$p_name", "find": "small", "replacement": "tiny"}}, i={"$regexMatch": {"input": "$p_name", "regex": "^s"}}, j={"$trim": {"input": "$p_type"}})
    return out.withColumns({"f": F.col("f").cast("long"), "g": F.col("g").cast("long")})


_LIST = "CAST(embedding AS DOUBLE[])"


@query(f"""SELECT vec_id, len({_LIST}) AS a, {_LIST}[1] AS b, {_LIST}[-1] AS c, len([x for x in {_LIST} if x > 0]) AS d, round(list_sum([x * 2 for x in {_LIST}]), 6) AS e, {_LIST}[3] AS f, len(list_concat({_LIST}, [1.0])) AS g, list_contains([1, 2, 3], label) AS h FROM embeddings""")
def expr_arrays(e: Engine) -> DataFrame:
    df = e.catalog.resolve("embeddings").withColumn("xs", F.col("embedding").cast("array<double>"))
    expressions = {"a": {"$size": "$xs"}, "b": {"$arrayElemAt": ["$xs", 0]}, "c": {"$arrayElemAt": ["$xs", -1]}, "d": {"$size": {"$filter": {"input": "$xs", "as": "x", "cond": {"$gt": ["$$x", 0]}}}},
                   "e": {"$reduce": {"input": {"$map": {"input": "$xs", "as": "x", "in": {"$multiply": ["$$x", 2]}}}, "initialValue": 0.0, "in": {"$add": ["$$value", "$$this"]}}}, "f": {"$arrayElemAt": [{"$slice": ["$xs", 2, 1]}, 0]}, "g": {"$size": {"$concatArrays": ["$xs", [1.0]]}}, "h": {"$in": ["$label", [1, 2, 3]]}}
    out = df.select("vec_id", *[compiled(x, Scope(df)).alias(k) for k, x in expressions.items()])
    return out.withColumns({"a": F.col("a").cast("long"), "d": F.col("d").cast("long"), "g": F.col("g").cast("long"), "e": F.round("e", 6)})


@query("""SELECT c_custkey, c_acctbal > 0 AND c_nationkey < 10 AS a, c_acctbal < 0 OR c_nationkey = 3 AS b, NOT c_acctbal >= 100 AS c, c_mktsegment <> 'BUILDING' AS d, CASE WHEN c_acctbal < 500 THEN -1 WHEN c_acctbal > 500 THEN 1 ELSE 0 END AS e, CASE WHEN c_acctbal <= 0 THEN 'debt' ELSE 'fine' END AS f,
    CASE WHEN c_nationkey < 5 THEN 'low' WHEN c_nationkey < 15 THEN 'mid' ELSE 'high' END AS g, c_nationkey + 100 AS h FROM customer""")
def expr_conditions(e: Engine) -> DataFrame:
    out = made(e, "customer", "c_custkey", a={"$and": [{"$gt": ["$c_acctbal", 0]}, {"$lt": ["$c_nationkey", 10]}]}, b={"$or": [{"$lt": ["$c_acctbal", 0]}, {"$eq": ["$c_nationkey", 3]}]}, c={"$not": [{"$gte": ["$c_acctbal", 100]}]}, d={"$ne": ["$c_mktsegment", "BUILDING"]}, e={"$cmp": ["$c_acctbal", 500]},
               f={"$cond": [{"$lte": ["$c_acctbal", 0]}, "debt", "fine"]}, g={"$switch": {"branches": [{"case": {"$lt": ["$c_nationkey", 5]}, "then": "low"}, {"case": {"$lt": ["$c_nationkey", 15]}, "then": "mid"}], "default": "high"}}, h={"$let": {"vars": {"base": 100}, "in": {"$add": ["$$base", {"$ifNull": ["$c_nationkey", 0]}]}}})
    return out


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS VARCHAR) AS a, CAST(l_quantity AS INT) AS b, CAST(l_quantity AS BIGINT) AS c, CAST(l_orderkey AS DOUBLE) AS d, 'double' AS e, NULL::INT AS f FROM lineitem")
def expr_conversions(e: Engine) -> DataFrame:
    df = e.catalog.resolve("lineitem")
    spec = {"a": {"$toString": "$l_quantity"}, "b": {"$toInt": "$l_quantity"}, "c": {"$toLong": "$l_quantity"}, "d": {"$toDouble": "$l_orderkey"}, "e": {"$type": "$l_tax"}, "f": {"$toInt": "$l_returnflag"}}
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[compiled(x, Scope(df)).alias(k) for k, x in spec.items()])


@query("SELECT event_id, CAST(year(ts) AS INT) AS a, CAST(month(ts) AS INT) AS b, CAST(day(ts) AS INT) AS c, CAST(hour(ts) AS INT) AS d, CAST(minute(ts) AS INT) AS e, CAST(second(ts) AS INT) AS f, CAST(dayofweek(ts) + 1 AS INT) AS g, strftime(ts, '%Y/%m/%d %H') AS h FROM events")
def expr_dates(e: Engine) -> DataFrame:
    return made(e, "events", "event_id", a={"$year": "$ts"}, b={"$month": "$ts"}, c={"$dayOfMonth": "$ts"}, d={"$hour": "$ts"}, e={"$minute": "$ts"}, f={"$second": "$ts"}, g={"$dayOfWeek": "$ts"}, h={"$dateToString": {"date": "$ts", "format": "%Y/%m/%d %H"}})


@query("SELECT n_nationkey, 'n_name=' || n_name || ',n_region=' || n_regionkey AS a, n_name AS b, n_regionkey + 1 AS c, n_name AS d FROM nation")
def expr_objects(e: Engine) -> DataFrame:
    df = e.catalog.resolve("nation").withColumn("o", F.struct("n_name", F.col("n_regionkey").cast("string").alias("n_region")))
    out = df.select("n_nationkey", compiled({"$objectToArray": "$o"}, Scope(df)).alias("kv"), compiled({"$mergeObjects": ["$o", {"x": {"$add": ["$n_regionkey", 1]}}]}, Scope(df)).alias("m"), compiled("$$ROOT.n_name", Scope(df)).alias("d"))
    back = compiled({"$arrayToObject": "$kv"}, Scope(out))
    return out.select("n_nationkey", F.array_join(F.transform("kv", lambda p: F.concat_ws("=", p["k"], p["v"])), ",").alias("a"), back["n_name"].alias("b"), F.col("m.x").alias("c"), "d")


# stages
@query("SELECT n_nationkey, (SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100) AS rich FROM nation")
def stage_lookup_pipeline(e: Engine) -> DataFrame:
    match = {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$n"]}, {"$gt": ["$s_acctbal", {"$multiply": ["$$n", 100]}]}]}}
    out = e.aggregate("nation", [{"$lookup": {"from": "supplier", "let": {"n": "$n_nationkey"}, "pipeline": [{"$match": match}, {"$project": {"s_suppkey": 1}}], "as": "rich"}}])
    joined = F.array_join(F.transform(F.array_sort(F.transform("rich", lambda r: r["s_suppkey"])), lambda k: k.cast("string")), ",")
    return out.select("n_nationkey", F.when(F.size("rich") > 0, joined).alias("rich"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), b(start, node, depth) AS (SELECT k, k, 0 FROM (VALUES (1), (5), (9)) t(k) UNION SELECT b.start, e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 2) SELECT start AS k, count(DISTINCT node) AS reached FROM b JOIN (SELECT DISTINCT src FROM e) s ON s.src = b.node GROUP BY start")
def stage_graph_lookup(e: Engine) -> DataFrame:
    e.catalog.put("follows", edges(e))
    e.catalog.put("asked", e.spark.createDataFrame([(1,), (5,), (9,)], "k long"))
    out = e.aggregate("asked", [{"$graphLookup": {"from": "follows", "startWith": "$k", "connectFromField": "dst", "connectToField": "src", "maxDepth": 2, "as": "found"}}])
    return out.select("k", F.size(F.array_distinct(F.transform("found", lambda d: d["src"]))).cast("long").alias("reached"))


@query("SELECT c_nationkey, min(c_acctbal) AS least, max(c_acctbal) AS most, arg_min(c_custkey, c_acctbal) AS first, arg_max(c_custkey, c_acctbal) AS last, round(stddev_pop(c_acctbal), 4) AS sd, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY c_nationkey")
def stage_group_accumulators(e: Engine) -> DataFrame:
    group = {"_id": {"c_nationkey": "$c_nationkey"}, "least": {"$min": "$c_acctbal"}, "most": {"$max": "$c_acctbal"}, "first": {"$first": "$c_custkey"}, "last": {"$last": "$c_custkey"}, "sd": {"$stdDevPop": "$c_acctbal"}, "kinds": {"$addToSet": "$c_mktsegment"}}
    out = e.aggregate("customer", [{"$sort": {"c_acctbal": 1}}, {"$group": group}])
    return out.withColumns({"sd": F.round("sd", 4), "kinds": F.size("kinds").cast("long")})


@query("SELECT n_nationkey AS id, upper(n_name) AS name, n_regionkey * 10 AS region FROM nation WHERE n_regionkey <> 2")
def stage_project_redact(e: Engine) -> DataFrame:
    return e.aggregate("nation", [{"$redact": {"$cond": [{"$eq": ["$n_regionkey", 2]}, "$$PRUNE", "$$KEEP"]}}, {"$addFields": {"big": {"$multiply": ["$n_regionkey", 10]}}}, {"$project": {"id": "$n_nationkey", "name": {"$toUpper": "$n_name"}, "region": "$big"}}])


@query("SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 3 AND 20 AND c_name LIKE 'Customer%' AND c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def find_json_schema(e: Engine) -> DataFrame:
    schema = {"required": ["c_name"], "properties": {"c_nationkey": {"bsonType": "int", "minimum": 3, "maximum": 20}, "c_name": {"pattern": "^Customer"}, "c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}}
    return e.find("customer", {"$jsonSchema": schema}, limit=None).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey & 5 = 5 OR c_nationkey & 8 <> 8 AND c_custkey % 3 = 1")
def find_bits(e: Engine) -> DataFrame:
    return e.find("customer", {"$or": [{"c_nationkey": {"$bitsAllSet": 5}}, {"c_nationkey": {"$bitsAnyClear": 8}, "c_custkey": {"$mod": [3, 1]}}]}, limit=None).select("c_custkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority IS NULL AS unset FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN least(o_totalprice + 5, 1000.0) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)")
def update_whole_row(e: Engine) -> DataFrame:
    """Changes of the filtered column don't switch later ones off."""
    from tidewell.operators import filters

    out = filters.update(e.catalog.resolve("orders"), {"o_orderstatus": "F"}, {"$set": {"o_orderstatus": "X"}, "$inc": {"o_totalprice": 5.0}, "$min": {"o_totalprice": 1000.0}, "$unset": {"o_orderpriority": ""}})
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").isNull().alias("unset"))


@query("SELECT vec_id, round(list_sum([CASE WHEN x < 0 THEN 0.0 ELSE x END for x in CAST(embedding AS DOUBLE[])]), 5) AS total FROM embeddings")
def update_array_filters(e: Engine) -> DataFrame:
    from tidewell.operators import filters

    df = e.catalog.resolve("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("xs"))
    out = filters.update(df, {}, {"$set": {"xs.$[neg]": 0.0}}, [{"neg": {"$lt": 0}}])
    return out.select("vec_id", F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# statements
@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'OCEANS' UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation WHERE n_regionkey = 1")
def sql_insert(e: Engine) -> DataFrame:
    e.sql("INSERT INTO region (r_regionkey, r_name) VALUES (90, 'OCEANS')")
    e.sql("INSERT INTO region SELECT n_nationkey + 100, upper(n_name) FROM nation WHERE n_regionkey = 1")
    return e.sql("SELECT r_regionkey, r_name FROM region")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'RISK' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN c_acctbal < 0 THEN c_acctbal * 1.1 ELSE c_acctbal END, 4) AS c_acctbal FROM customer")
def sql_update(e: Engine) -> DataFrame:
    e.sql("UPDATE customer SET c_mktsegment = 'RISK', c_acctbal = c_acctbal * 1.1 WHERE c_acctbal < 0")
    return e.sql("SELECT c_custkey, c_mktsegment, round(c_acctbal, 4) AS c_acctbal FROM customer")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'F')")
def sql_delete(e: Engine) -> DataFrame:
    e.sql("DELETE FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
    return e.sql("SELECT o_orderkey, o_custkey FROM orders")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'new ' || n_nationkey ELSE n_name END AS n_name FROM nation UNION ALL SELECT 50 + n_nationkey, 'new ' || n_nationkey FROM nation WHERE n_nationkey < 2")
def sql_on_conflict(e: Engine) -> DataFrame:
    e.sql("INSERT INTO nation (n_nationkey, n_name) SELECT n_nationkey, concat('new ', n_nationkey) FROM nation WHERE n_nationkey < 3 ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name")
    e.sql("INSERT INTO nation (n_nationkey, n_name) SELECT 50 + n_nationkey, concat('new ', n_nationkey) FROM nation WHERE n_nationkey < 2 ON CONFLICT (n_nationkey) DO NOTHING")
    return e.sql("SELECT n_nationkey, n_name FROM nation")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def pql_update(e: Engine) -> DataFrame:
    e.pql("UPDATE supplier SET s_acctbal = s_acctbal + 1 WHERE s_nationkey = 7")
    e.pql("DELETE FROM supplier WHERE s_nationkey = 3")
    return e.pql("QUERY supplier SELECT s_suppkey, s_acctbal")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT -1, count(*) FROM customer")
def sql_materialised_view(e: Engine) -> DataFrame:
    e.sql("CREATE MATERIALIZED VIEW per_nation AS SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
    e.sql("CREATE VIEW whole AS SELECT -1 AS c_nationkey, sum(n) AS n FROM per_nation")
    return e.sql("SELECT c_nationkey, n FROM per_nation UNION ALL SELECT c_nationkey, n FROM whole")


both("sql_qualify", "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2")
both("subquery_row", "SELECT p_partkey, p_name FROM part WHERE (p_size, p_brand) = (SELECT p_size, p_brand FROM part WHERE p_partkey = 3)", "SELECT p_partkey, p_name FROM part WHERE (p_size, p_brand) IN (SELECT p_size, p_brand FROM part WHERE p_partkey = 3)")
both("agg_percentile", "SELECT c_nationkey, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 6) AS p90 FROM customer GROUP BY c_nationkey")
# a tenth is ten times the sketch's error; distinct keys are counted apart, as Spark would keep both sketches for each of them
both("agg_approximate", "SELECT abs(a - n) < 0.1 * n AS near, abs(m - 25) <= 2 AS middle FROM (SELECT approx_count_distinct(l_partkey, 0.01) AS a, percentile_approx(l_quantity, 0.5, 1000) AS m FROM lineitem) CROSS JOIN (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)",
     "SELECT true AS near, abs(quantile_cont(l_quantity, 0.5) - 25) <= 2 AS middle FROM lineitem")
both("agg_approximate_top", "SELECT item, count AS n FROM (SELECT inline(approx_top_k(event_type, 3)) FROM events)", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3")
both("collation_ignores_case", "SELECT n_nationkey FROM nation WHERE lower(n_name) COLLATE UTF8_LCASE = upper(n_name) ORDER BY n_name COLLATE UNICODE_CI", "SELECT n_nationkey FROM nation")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_custkey) AS place FROM customer")
def collation_numeric(e: Engine) -> DataFrame:
    """Names in the order of the numbers within them; places by offsets of range partitions."""
    named = e.catalog.resolve("customer").select("c_custkey", text.natural_key(F.col("c_name")).alias("k"))
    return catalog.sequence(named, ["k", "c_custkey"], name="place").select("c_custkey", F.col("place").cast("long").alias("place"))


# JSON that is changed and tested
@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 0 AS k, event_type AS kind, false AS has_k FROM events")
def json_modify(e: Engine) -> DataFrame:
    changed = jsons.column("jsonb_set")(F.col("props"), F.lit("{kind}"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    df = e.catalog.resolve("events").select("event_id", changed.alias("j"))
    return df.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.kind").alias("kind"), jsons.column("jsonb_exists")(jsons.column("jsonb_delete")(F.col("j"), F.lit("k")), F.lit("k")).alias("has_k"))


both("json_operators", """SELECT event_id, props->>'k' AS k, props @> '{"k": 5}' AS five, props ? 'q' AS has_q FROM events""",
     "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) = 5 AS five, false AS has_q FROM events")

# the pipeline language
pipeline_query("pql_window", "QUERY orders COMPUTE r = RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC), s = SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) SELECT o_orderkey, r, ROUND(s, 4) AS s",
               "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM orders")
pipeline_query("pql_subqueries", "QUERY customer AS c WHERE EXISTS (QUERY orders WHERE o_custkey = c.c_custkey AND o_totalprice > 250000) AND c_acctbal > (QUERY customer COMPUTE m = AVG(c_acctbal)) AND c_nationkey IN (QUERY nation WHERE n_regionkey < 3 SELECT n_nationkey) SELECT c_custkey",
               "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 250000) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
pipeline_query("pql_text", "QUERY part WHERE p_name CONTAINS 'ring' OR p_name STARTS WITH 'small' SELECT p_partkey, p_brand + ': ' + p_name AS label, LENGTH(p_name) AS n", "SELECT p_partkey, p_brand || ': ' || p_name AS label, CAST(length(p_name) AS INT) AS n FROM part WHERE contains(p_name, 'ring') OR starts_with(p_name, 'small')")
pipeline_query("pql_inline", "QUERY [{k: 1, v: 'a'}, {k: 2, v: 'b'}] INNER JOIN nation ON k = n_nationkey SELECT k, v, n_name", "SELECT k, v, n_name FROM (VALUES (1, 'a'), (2, 'b')) t(k, v) JOIN nation ON k = n_nationkey")
pipeline_query("pql_aggregate_right", "QUERY orders COMPUTE many = 1000 < COUNT(*), n = COUNT(DISTINCT o_custkey), top = MAX(o_totalprice)", "SELECT count(*) > 1000 AS many, count(DISTINCT o_custkey) AS n, max(o_totalprice) AS top FROM orders")


@query(f"WITH e AS ({_EDGES}) SELECT a.src AS a, a.dst AS b, b.dst AS c, a.weight + b.weight AS w, p.p_name AS name FROM e a JOIN e b ON a.dst = b.src JOIN part p ON p.p_partkey = b.dst WHERE a.weight > 1 AND b.weight > 1")
def pql_match(e: Engine) -> DataFrame:
    e.catalog.put("strong", edges(e).where("weight > 1"))
    return e.pql("QUERY part MATCH (a)-[x:strong]->(b)-[y:strong]->(c:part) SELECT a, b, c, x.weight + y.weight AS w, c_node.p_name AS name").distinct()


@query(f"WITH RECURSIVE e AS ({_EDGES}), d(node, cost, hop) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT e.dst, min(d.cost + e.weight), d.hop + 1 FROM d JOIN e ON d.node = e.src WHERE d.hop < 30 GROUP BY e.dst, d.hop) SELECT min(cost) AS cost FROM d WHERE node = 9")
def pql_path(e: Engine) -> DataFrame:
    e.catalog.put("follows", edges(e))
    return e.pql("QUERY part PATH SHORTEST FROM 1 TO 9 IN follows SELECT cost")


# graphs
@query(f"SELECT dst, weight FROM ({_EDGES}) WHERE src = 7 ORDER BY dst LIMIT 5")
def graph_neighbors(e: Engine) -> DataFrame:
    return graph.neighbors(edges(e), 7, 5).select("dst", "weight")


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) WHERE weight > 1), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), b(start, node, depth) AS (SELECT node, node, 0 FROM n UNION SELECT b.start, e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 60)
    SELECT start AS node, round(count(*) / sum(d), 8) AS closeness FROM (SELECT start, node, min(depth) AS d FROM b WHERE start <> node GROUP BY start, node) GROUP BY start""")
def graph_closeness(e: Engine) -> DataFrame:
    """Over links that occur again, which are a graph of their own."""
    return graph.closeness(edges(e).where("weight > 1")).select("node", F.round("closeness", 8).alias("closeness"))


@query(f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_EDGES})) SELECT x.a || '-' || x.b || '-' || y.b || '-' || w.b AS nodes FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b JOIN e w ON w.a = y.b JOIN e u ON u.a = x.a AND u.b = w.b JOIN e v ON v.a = x.b AND v.b = w.b")
def graph_cliques(e: Engine) -> DataFrame:
    found = graph.cliques(edges(e), 4)
    return found.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), "-").alias("nodes"))


@query("SELECT o_custkey AS src, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01' GROUP BY o_custkey")
def graph_as_of(e: Engine) -> DataFrame:
    """Edges that are valid for ninety days, as they were on one day."""
    links = e.sql("SELECT o_custkey AS src, o_orderkey AS dst, o_orderdate AS valid_from, o_orderdate + INTERVAL '90' DAY AS valid_to FROM orders")
    day = e.sql("SELECT TIMESTAMP_NTZ '1996-06-01 00:00:00' AS d").first()["d"]
    return graph.as_of(links, day).groupBy("src").agg(F.count("*").alias("n"))


# vectors and text
@query("SELECT vec_id, CAST(list_sum([CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding]) AS BIGINT) AS far, least(127, greatest(-128, CAST(floor((CAST(embedding AS DOUBLE[])[1] + 1) / 2 * 255) AS INT) - 128)) AS first FROM embeddings")
def vector_codes(e: Engine) -> DataFrame:
    signs = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return e.catalog.resolve("embeddings").select("vec_id", vectors.hamming(signs, F.transform("embedding", lambda x: F.lit(0))).cast("long").alias("far"), vectors.quantize(F.col("embedding"), -1.0, 1.0)[0].alias("first"))


@query(f"SELECT vec_id, round(0.7 * list_cosine_similarity({_LIST}, q) + 0.3 * list_cosine_similarity(list_reverse({_LIST}), q), 4) AS score FROM embeddings, {_Q} ORDER BY 0.7 * list_cosine_similarity({_LIST}, q) + 0.3 * list_cosine_similarity(list_reverse({_LIST}), q) DESC, vec_id LIMIT 10")
def vector_fusion(e: Engine) -> DataFrame:
    rows = e.catalog.resolve("embeddings").withColumn("turned", F.reverse("embedding"))
    q = list(rows.where("vec_id = 1").first()["embedding"])
    return vectors.fused(rows, {"embedding": (q, 0.7), "turned": (q, 0.3)}).select("vec_id", F.round("_vector_score", 4).alias("score"))


@query(f"SELECT vec_id FROM embeddings, {_Q} WHERE label = 3 AND list_cosine_similarity({_LIST}, q) BETWEEN -0.5 AND 0.9 ORDER BY list_cosine_similarity({_LIST}, q) DESC, vec_id LIMIT 4")
def vector_filtered(e: Engine) -> DataFrame:
    """By an entry of a map beforehand, and within two bounds of the score."""
    rows = e.catalog.resolve("embeddings").withColumn("meta", F.create_map(F.lit("label"), F.col("label").cast("string")))
    q = list(rows.where("vec_id = 1").first()["embedding"])
    return vectors.top_k(vectors.checked(rows, len(q)).where(vectors.meta_matches({"label": "3"})), q, 4, threshold=-0.5, most=0.9).select("vec_id")


@query(f"""WITH d AS (SELECT doc_id, len(ws) AS n, len([t for t in ws if t = 'license']) AS f FROM (SELECT doc_id, {_TERMS} AS ws FROM documents)), s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (WHERE f > 0) AS df FROM d),
    k AS (SELECT doc_id, ln((nn - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)) AS b FROM d, s WHERE f > 0), v AS (SELECT vec_id AS doc_id, list_cosine_similarity({_LIST}, q) AS c FROM embeddings, {_Q})
    SELECT doc_id, round(0.4 * coalesce(c / (SELECT max(c) FROM v), 0) + 0.6 * coalesce(b / (SELECT max(b) FROM k), 0), 6) AS score FROM k FULL JOIN v USING (doc_id)""")
def text_alpha_fusion(e: Engine) -> DataFrame:
    q = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]
    words = text.bm25(e.catalog.resolve("documents"), ["license"]).withColumnRenamed("bm25", "score")
    near = e.catalog.resolve("embeddings").select(F.col("vec_id").alias("doc_id"), vectors.cosine(F.col("embedding"), vectors.literal(list(q))).alias("score"))
    return text.alpha_fusion(near, words, "doc_id", 0.4).select("doc_id", F.round("score", 6).alias("score"))


@query(r"SELECT doc_id, regexp_replace(text, '\b(license|work)\b', '<b>\1</b>', 'gi') AS marked FROM documents WHERE regexp_matches(text, '\b(license|work)\b', 'i')")
def text_highlight(e: Engine) -> DataFrame:
    words = ["license", "work"]
    return e.catalog.resolve("documents").where(F.col("text").rlike(r"(?i)\b(license|work)\b")).select("doc_id", text.highlight(F.col("text"), words).alias("marked"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE (list_contains(ws, 'license') OR list_contains(ws, 'licenses')) AND NOT list_contains(ws, 'general')")
def text_query(e: Engine) -> DataFrame:
    return e.catalog.resolve("documents").where(text.query_matches(F.col("text"), "license & !general")).select("doc_id")


# sources
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)")
def source_round_trip(e: Engine) -> DataFrame:
    """Saved by partition as CSV and loaded with a schema."""
    import uuid

    path = f"{shared_folder(e.spark)}/stages/csv-{uuid.uuid4().hex}"
    catalog.save(e.catalog.resolve("nation"), path, "csv", ("n_regionkey",))
    return catalog.load(e.spark, path, "csv", "n_nationkey int, n_name string, n_regionkey int").where("n_regionkey IN (1, 2)")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'inline'")
def source_union(e: Engine) -> DataFrame:
    e.catalog.put("a.places", e.sql("SELECT n_nationkey AS key, n_name AS name FROM nation"))
    e.catalog.put("b.places", e.sql("SELECT r_regionkey AS key, r_name AS name FROM region"))
    return catalog.union_sources(e.catalog.wildcard(table="places"), catalog.inline(e.spark, [{"key": 77, "name": "inline"}], "key int, name string"))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 'x' ELSE CAST(label AS VARCHAR) END AS label, 'new' AS tag FROM (SELECT vec_id, label FROM embeddings)")
def vector_meta(e: Engine) -> DataFrame:
    rows = e.catalog.resolve("embeddings").select("vec_id", "label", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("old"), F.lit("1")).alias("meta"))
    merged = catalog.merge_meta(catalog.drop_meta(rows, ["old"]), {"tag": "new"})
    return merged.select("vec_id", F.when(F.col("label") == 3, "x").otherwise(F.col("meta")["label"]).alias("label"), F.col("meta")["tag"].alias("tag"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(e: Engine) -> DataFrame:
    found = streams.sessions(e.catalog.resolve("events"), "ts", "2 hours", ["user_id"], [F.min("ts").alias("began"), F.count("*").alias("n")])
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n")


@query("SELECT p.c_custkey, s.o_orderkey FROM customer p JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) s ON s.o_custkey = p.c_custkey AND s.o_orderdate >= TIMESTAMP '1996-01-01' AND s.o_orderdate < TIMESTAMP '1996-03-01'")
def join_temporal(e: Engine) -> DataFrame:
    """Orders within the span in which a price list of each customer was valid; times as days."""
    points = e.sql("SELECT o_orderkey, o_custkey AS k, unix_date(CAST(o_orderdate AS DATE)) AS day FROM orders")
    spans = e.sql("SELECT c_custkey, c_custkey AS k, unix_date(DATE '1996-01-01') AS since, unix_date(DATE '1996-03-01') AS until FROM customer")
    return joins.interval_join(points, spans, "day", "since", "until", 30, ["k"]).select("c_custkey", "o_orderkey")


# more of the pipeline language and of document filters
@query(f"SELECT vec_id FROM embeddings, {_Q} WHERE embedding IS NULL OR list_cosine_similarity({_LIST}, q) < 0.1")
def pql_not_similar(e: Engine) -> DataFrame:
    v = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]
    return e.pql("QUERY embeddings NOT SIMILAR TO @q IN embedding THRESHOLD 0.1 SELECT vec_id", q=v)


@query(f"""SELECT p_partkey, CAST(coalesce(n, 0) AS DOUBLE) AS links FROM part LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT src AS k FROM ({_EDGES}) UNION ALL SELECT dst FROM ({_EDGES})) GROUP BY k) ON k = p_partkey WHERE p_size > 40""")
def pql_centrality(e: Engine) -> DataFrame:
    e.catalog.put("follows", edges(e))
    return e.pql("QUERY part WHERE p_size > 40 COMPUTE links = GRAPH_CENTRALITY(follows, p_partkey, 'degree') SELECT p_partkey, links")


@query("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000) LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) ON c_nationkey = s_nationkey")
def pql_optional_match(e: Engine) -> DataFrame:
    e.catalog.put("near", e.sql("SELECT s_suppkey AS src, c_custkey AS dst FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal > 9000"))
    return e.pql("QUERY supplier WHERE s_acctbal > 5000 SELECT s_suppkey OPTIONAL MATCH (s_suppkey)-[:near]->(c_custkey)")


@query(f"""WITH d AS (SELECT doc_id, len(ws) AS n, len([t for t in ws if t = 'license']) AS f1, len([t for t in ws if t = 'work']) AS f2 FROM (SELECT doc_id, {_TERMS} AS ws FROM documents)),
    s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM d),
    b AS (SELECT doc_id, round(CASE WHEN f1 > 0 THEN ln((nn - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / av)) ELSE 0 END + CASE WHEN f2 > 0 THEN ln((nn - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / av)) ELSE 0 END, 6) AS score FROM d, s WHERE f1 > 0 OR f2 > 0)
    SELECT score FROM b ORDER BY score DESC LIMIT 10""")
def pql_search(e: Engine) -> DataFrame:
    return e.pql("QUERY documents SELECT doc_id, text SEARCH 'license work' IN text TOP 10 SELECT ROUND(_text_score, 6) AS score")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE (list_contains(ws, 'license') OR list_contains(ws, 'licenses')) AND NOT (list_contains(ws, 'general') OR list_contains(ws, 'generals'))")
def find_text(e: Engine) -> DataFrame:
    return e.find("documents", {"$text": {"$search": "license -general"}}, limit=None).select("doc_id")


@query("SELECT c_custkey FROM (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1800) / 10.0 - 90 AS lat FROM customer) WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 70 OR 2 * 6371008.8 * asin(sqrt(pow(sin(radians(-30 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-30)) * pow(sin(radians(100 - lon) / 2), 2))) <= 2000000")
def find_geo(e: Engine) -> DataFrame:
    e.catalog.put("places", e.sql("SELECT c_custkey, array((c_custkey * 37 % 3600) / 10.0 - 180, (c_custkey * 53 % 1800) / 10.0 - 90) AS loc FROM customer"))
    near = {"$near": {"$geometry": {"type": "Point", "coordinates": [100.0, -30.0]}, "$maxDistance": 2000000}}
    return e.find("places", {"$or": [{"loc": {"$geoWithin": {"$box": [[-20, 30], [40, 70]]}}}, {"loc": near}]}, limit=None).select("c_custkey")


@query("SELECT event_id, len(json_keys(props)) AS n, json_keys(props)[1] AS first FROM events")
def json_each(e: Engine) -> DataFrame:
    names = jsons.column("jsonb_object_keys")(F.col("props"))
    return e.catalog.resolve("events").select("event_id", names.alias("ks")).select("event_id", F.size("ks").cast("long").alias("n"), F.col("ks")[0].alias("first"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def user_functions(e: Engine) -> DataFrame:
    """A SQL function and an aggregate of pandas beside built-in ones."""

    def whole(v: pd.Series) -> float:
        return float(v.sum())

    e.function("one_of", "(x DOUBLE) RETURNS BIGINT RETURN CASE WHEN x IS NULL THEN 0 ELSE 1 END")
    e.function("whole", F.pandas_udf(whole, "double"))
    return e.sql("SELECT a.event_type, n, round(total, 2) AS total FROM (SELECT event_type, sum(one_of(value)) AS n FROM events GROUP BY event_type) a JOIN (SELECT event_type, whole(value) AS total FROM events GROUP BY event_type) b ON a.event_type = b.event_type")


@query("SELECT 'h' || (c_custkey % 1) AS dummy, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def source_partitions(e: Engine) -> DataFrame:
    """Rows by list of values, the others by default."""
    named = catalog.partitioned(e.catalog.resolve("customer"), "c_mktsegment", lists={"BUILDING": ["BUILDING"], "MACHINERY": ["MACHINERY"]})
    return named.where("part <> 'default'").groupBy(F.lit("h0").alias("dummy"), F.col("part").alias("c_mktsegment")).agg(F.count("*").alias("n"))
