"""Registered queries of the engine and their oracle SQL.

Most are one SQL text that Spark and the oracle both read; the others call the library's operators. Sums of
doubles are rounded, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.functions import geo, text, vectors
from tidewell.operators import ann, communities, components, filters, graph, joins
from tidewell.sources import catalog
from tidewell.sources.stages import staged

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.catalog.mount(sf_dir, TABLES)
    return e


def both(name: str, sql: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(sql)
    ORACLE_SQL[name] = oracle or sql


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(engine(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# projection, filters, predicates
both("q_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
both("select_alias_star", "SELECT n.*, n_name AS label, n_nationkey + 1 AS next_key FROM nation n")
both("where_and_in", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING')")
both("where_between_like_null", "SELECT p_partkey, p_name FROM part WHERE (p_size BETWEEN 5 AND 15 OR p_name LIKE '%a%') AND p_brand IS NOT NULL AND NOT p_size = 7")
both("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
both("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
both("string_functions", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS len, substring(p_name, 2, 3) AS sub, trim(p_type) AS trimmed, concat(p_brand, '-', p_type) AS joined, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand FROM part")
both("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month_start FROM orders",
     "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start FROM orders")
both("cast_try", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, try_cast(l_returnflag AS INT) AS no_number FROM lineitem")

# joins
both("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
both("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
both("join_full", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
both("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
both("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
both("join_using_natural", "SELECT doc_id, quality, lang FROM documents NATURAL JOIN labels")
both("join_using", "SELECT doc_id, toxic, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
both("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
both("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
both("join_multi", """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""")
both("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
both("join_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")


@query("""SELECT e.event_id, e.user_id, p.event_id AS prev_purchase, p.value AS prev_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, ts, max_by(event_id, value) AS event_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(e: Engine) -> DataFrame:
    ev = e.catalog.resolve("events")
    bought = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("event_id", "value").alias("prev_purchase"), F.max("value").alias("prev_value"))
    out = joins.asof_join(ev.where("event_type <> 'purchase'"), bought, "ts", ["user_id"], ["prev_value", "prev_purchase"])
    return out.select("event_id", "user_id", "prev_purchase", "prev_value")


@query("""SELECT p.o_orderkey, s.lo FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) p JOIN (SELECT CAST(p_partkey AS BIGINT) * 1000 AS lo, CAST(p_partkey AS BIGINT) * 1000 + 1500 AS hi FROM part) s ON p.price >= s.lo AND p.price < s.hi""")
def join_range_overlap(e: Engine) -> DataFrame:
    p = e.sql("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders")
    s = e.sql("SELECT p_partkey * 1000 AS lo, p_partkey * 1000 + 1500 AS hi FROM part")
    return joins.interval_join(p, s, "price", "lo", "hi", 1000).select("o_orderkey", "lo")


@query("SELECT r_regionkey, r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
def lookup_collected(e: Engine) -> DataFrame:
    found = e.aggregate("region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}])
    return found.select("r_regionkey", "r_name", F.array_join(F.array_sort(F.transform("nations", lambda n: n["n_name"])), ",").alias("nations"))


# aggregates
both("agg_global", "SELECT count(*) AS n, count(l_quantity) AS nq, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem")
both("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("agg_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
both("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM events GROUP BY event_type")
both("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("agg_collect", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
both("agg_time_bucket", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
both("agg_distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
both("agg_stddev", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 3) AS vp FROM part GROUP BY p_brand")


@query("SELECT CASE WHEN p_size < 10 THEN 0.0 WHEN p_size < 20 THEN 10.0 WHEN p_size < 40 THEN 20.0 ELSE -1.0 END::DOUBLE AS bucket, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def stage_bucket(e: Engine) -> DataFrame:
    return filters.bucket(e.catalog.resolve("part"), "p_size", [0.0, 10.0, 20.0, 40.0], -1.0, n=F.count("*"), mean=F.round(F.avg("p_retailprice"), 4))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def stage_sort_by_count(e: Engine) -> DataFrame:
    return e.aggregate("events", [{"$sortByCount": "$event_type"}])


@query("SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def stage_match_group(e: Engine) -> DataFrame:
    out = e.aggregate("orders", [{"$match": {"o_totalprice": {"$gt": 1000}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}}, {"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}, "n": {"$count": {}}}}, {"$sort": {"_id": 1}}])
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT (SELECT count(*) FROM events) AS n, (SELECT string_agg(event_type || ':' || k, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS k FROM events GROUP BY event_type)) AS by_type,
    (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 3)) AS top""")
def stage_facet(e: Engine) -> DataFrame:
    facets = {"all": [{"$count": "n"}], "types": [{"$group": {"_id": "$event_type", "k": {"$sum": 1}}}], "top": [{"$sort": {"value": -1, "event_id": 1}}, {"$limit": 3}, {"$project": {"event_id": 1, "value": 1}}]}
    out = e.aggregate("events", [{"$facet": facets}])
    listed = F.transform(F.array_sort(F.transform("types", lambda t: F.struct(t["_id"], t["k"]))), lambda t: F.concat_ws(":", t["_id"], t["k"].cast("string")))
    best = F.array_sort(F.transform("top", lambda t: F.struct((-t["value"]).alias("v"), t["event_id"].alias("i"))))
    return out.select(F.col("all")[0]["n"].alias("n"), F.array_join(listed, ",").alias("by_type"), F.array_join(F.transform(best, lambda t: t["i"].cast("string")), ",").alias("top"))


@query("SELECT w AS word, count(*) AS n, max(i - 1) AS last_pos FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT string_split(text, ' ') AS ws FROM documents)) GROUP BY w")
def stage_unwind(e: Engine) -> DataFrame:
    out = e.aggregate("documents", [{"$project": {"word": {"$split": ["$text", " "]}}}, {"$unwind": {"path": "$word", "includeArrayIndex": "pos"}}, {"$group": {"_id": {"word": "$word"}, "n": {"$sum": 1}, "last_pos": {"$max": "$pos"}}}])
    return out.withColumn("last_pos", F.col("last_pos").cast("long"))


# windows
both("window_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer")
both("window_dist", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS cd, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS nt FROM customer")
both("window_moving", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
both("window_lag_lead", "SELECT conv_id, turn, lag(role, 1, 'none') OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
both("window_values", "SELECT n_nationkey, first_value(n_name) OVER w AS first, last_value(n_name) OVER w AS last, nth_value(n_name, 2) OVER w AS second FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("window_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS recent FROM orders")


@query("SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near_groups FROM customer")
def window_groups(e: Engine) -> DataFrame:
    return joins.groups_frame(e.catalog.resolve("customer"), F.count("*"), ["c_mktsegment"], "c_nationkey", 1, 1, "near_groups").select("c_custkey", "near_groups")


@query("""SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS BIGINT) AS others,
    CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP), 0) AS BIGINT) AS no_peers FROM part""")
def window_exclude(e: Engine) -> DataFrame:
    df = joins.sum_excluding(e.catalog.resolve("part"), "p_size", ["p_brand"], "p_type", "current row", "others")
    return joins.sum_excluding(df, "p_size", ["p_brand"], "p_type", "group", "no_peers").select("p_partkey", F.col("others").cast("long"), F.col("no_peers").cast("long"))


@query("SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_k_per_group(e: Engine) -> DataFrame:
    return joins.top_per_group(e.catalog.resolve("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_custkey", "c_nationkey")


# order, limit, sets, subqueries, recursion
both("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
both("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
both("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
both("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) * 1.2")
both("subquery_row_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
both("subquery_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 5)")
both("subquery_any", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size > 45)")
both("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey FROM a, b WHERE t > 2 * m")
both("cte_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
both("derived_table", "SELECT k, n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey) t WHERE n > 50")

# JSON
both("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
both("json_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k, typeof(variant_get(parse_json(props), '$.k', 'string')) = 'string' AS ok FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS ok FROM events")
both("json_keys", "SELECT event_id, array_join(json_object_keys(props), ',') AS names FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS names FROM events")


# document filters and updates
@query("SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_acctbal > 9000) AND regexp_matches(c_mktsegment, '^[AB]') AND NOT c_nationkey % 5 = 0")
def find_filter(e: Engine) -> DataFrame:
    spec = {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_acctbal": {"$gt": 9000}}], "c_mktsegment": {"$regex": "^[ab]", "$options": "i"}, "$nor": [{"c_nationkey": {"$mod": [5, 0]}}]}
    return e.find("customer", spec, limit=None).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE len([w for w in string_split(text, ' ') if length(w) > 14]) > 0 AND contains(text, 'the')")
def find_elem_match(e: Engine) -> DataFrame:
    df = e.catalog.resolve("documents").where(F.col("text").contains("the")).withColumn("ws", F.transform(F.split("text", " "), F.length))
    return df.where(filters.matches({"ws": {"$elemMatch": {"$gt": 14}}})).select("doc_id")


@query("SELECT c_custkey, round(CASE WHEN c_nationkey = 1 THEN (c_acctbal + 10) * 2 ELSE c_acctbal END, 4) AS c_acctbal, CASE WHEN c_nationkey = 1 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_set_inc_mul(e: Engine) -> DataFrame:
    df = filters.update(e.catalog.resolve("customer"), {"c_nationkey": 1}, {"$set": {"c_mktsegment": "X"}, "$inc": {"c_acctbal": 10}, "$mul": {"c_acctbal": 2}})
    return df.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 99, 'new'")
def dml_upsert_delete(e: Engine) -> DataFrame:
    n = e.catalog.resolve("nation").select("n_nationkey", "n_name")
    changes = e.spark.createDataFrame([(3, "changed"), (99, "new")], n.schema)
    return catalog.delete(catalog.upsert(n, changes, "n_nationkey"), e.spark.createDataFrame([(4,)], "n_nationkey int"), "n_nationkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'check:balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'reference:o_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def schema_violations(e: Engine) -> DataFrame:
    c, o = e.catalog.resolve("customer"), e.catalog.resolve("orders")
    a = filters.violations(c, "c_custkey", required=("c_name",), unique=("c_custkey",), checks={"balance": "c_acctbal >= 0"})
    return a.unionByName(filters.violations(o, "o_orderkey", references={"o_custkey": (c.where("c_acctbal >= 0"), "c_custkey")}))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= 500 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def time_travel(e: Engine) -> DataFrame:
    log = e.catalog.resolve("events").withColumn("deleted", F.col("event_type") == "error")
    return catalog.as_of(log, "user_id", "event_id", 500).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) * 10 AS seq FROM customer")
def sequence_numbers(e: Engine) -> DataFrame:
    return catalog.sequence(e.catalog.resolve("customer").select("c_custkey"), ["c_custkey"], 10, 10).select("c_custkey", F.col("seq").cast("long"))


# the pipeline language
def pipeline_query(name: str, pql: str, oracle: str, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).pql(pql, **params)
    ORACLE_SQL[name] = oracle


pipeline_query("pql_filter_compute", "QUERY orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F' COMPUTE twice = o_totalprice * 2, more = twice + 1 SELECT o_orderkey, more",
               "SELECT o_orderkey, o_totalprice * 2 + 1 AS more FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F'")
pipeline_query("pql_group", "QUERY orders GROUP BY o_orderstatus COMPUTE n = COUNT(*), top = MAX(o_totalprice) HAVING n > 5 -- groups\n ORDERBY n DESC", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 5")
pipeline_query("pql_join", "QUERY nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey SELECT n_name, r_name", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
pipeline_query("pql_order_limit", "QUERY customer WHERE c_acctbal BETWEEN 100 AND 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 2 SELECT c_custkey, c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 2")
pipeline_query("pql_arithmetic", "QUERY part COMPUTE a = -p_size ^ 2, b = p_size / 4, c = p_size % 0 SELECT p_partkey, a, b, c", "SELECT p_partkey, pow(-p_size, 2) AS a, CAST(p_size // 4 AS BIGINT) AS b, CAST(NULL AS INT) AS c FROM part")
pipeline_query("pql_parameter", "QUERY customer WHERE c_mktsegment = @seg AND c_nationkey IN (1, 2, 3) SELECT c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)", seg="BUILDING")


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1)"


@query(f"SELECT vec_id FROM embeddings, {_Q} WHERE label >= 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 5")
def pql_similar(e: Engine) -> DataFrame:
    v = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]
    return e.pql("QUERY embeddings WHERE label >= 0 SIMILAR TO @q IN embedding TOP 5 METRIC cosine SELECT vec_id", q=v)


# vectors and text


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, {_Q} ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")
def vector_knn(e: Engine) -> DataFrame:
    q = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]  # one row: the query
    return vectors.top_k(e.catalog.resolve("embeddings"), list(q), 10).select("vec_id", F.round("_vector_score", 4).alias("score"))


@query("SELECT label, i AS pos, round(avg(x), 4) + 0.0 AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def vector_centroid(e: Engine) -> DataFrame:
    c = vectors.centroid(e.catalog.resolve("embeddings"), "embedding", ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), (F.round("m", 4) + 0.0).alias("mean"))


@query("""SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding, b.embedding), b.vec_id) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 3""")
def vector_mesh(e: Engine) -> DataFrame:
    return graph.knn_mesh(e.catalog.resolve("embeddings"), 3, query_where="vec_id % 20 = 0").select("src", "dst")


_TERMS = "[t for t in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if t <> '']"


@query(f"""WITH d AS (SELECT doc_id, len(ws) AS n, len([t for t in ws if t = 'the']) AS f1, len([t for t in ws if t = 'license']) AS f2 FROM (SELECT doc_id, {_TERMS} AS ws FROM documents)),
    s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM d)
    SELECT doc_id, round(CASE WHEN f1 > 0 THEN ln((nn - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / av)) ELSE 0 END + CASE WHEN f2 > 0 THEN ln((nn - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / av)) ELSE 0 END, 5) AS bm25
    FROM d, s WHERE f1 > 0 OR f2 > 0""")
def text_bm25(e: Engine) -> DataFrame:
    return text.bm25(e.catalog.resolve("documents"), ["the", "license"]).select("doc_id", F.round("bm25", 5).alias("bm25"))


@query("SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(" + _TERMS + ", ' ') || ' ', ' of the ')")
def text_phrase(e: Engine) -> DataFrame:
    return e.catalog.resolve("documents").where(text.phrase(F.col("text"), ["of", "the"])).select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, len(ws) AS n, len([t for t in ws if t = 'license']) AS f FROM (SELECT doc_id, {_TERMS} AS ws FROM documents)), s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (WHERE f > 0) AS df FROM d),
    k AS (SELECT doc_id, row_number() OVER (ORDER BY round(ln((nn - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)), 9) DESC, doc_id) AS r FROM d, s WHERE f > 0),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) DESC, vec_id) AS r FROM embeddings, {_Q})
    SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM k WHERE r <= 1000 UNION ALL SELECT * FROM v WHERE r <= 1000) GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 20""")
def text_hybrid_rrf(e: Engine) -> DataFrame:
    """Keyword ranks of documents fused with vector ranks of the embeddings of the same ids."""
    q = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]
    words = text.bm25(e.catalog.resolve("documents"), ["license"]).select("doc_id", F.round("bm25", 9).alias("score"))
    near = e.catalog.resolve("embeddings").select(F.col("vec_id").alias("doc_id"), F.round(vectors.cosine(F.col("embedding"), vectors.literal(list(q))), 9).alias("score"))
    return text.reciprocal_rank_fusion([words, near], "doc_id").select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


# graphs: parts that follow one another in an order
_EDGES = "SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst"
#: What customers, suppliers, nations and regions belong to, both ways; kinds have ranges of ids of their own.
_BELONGS = "SELECT c_custkey * 4 AS src, CAST(c_nationkey AS BIGINT) * 4 + 2 AS dst FROM customer UNION SELECT s_suppkey * 4 + 1, CAST(s_nationkey AS BIGINT) * 4 + 2 FROM supplier UNION SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, CAST(n_regionkey AS BIGINT) * 4 + 3 FROM nation"


def edges(e: Engine) -> DataFrame:
    """A graph whose nodes are all parts that were ordered beside others and whose weights are how often."""
    return staged(e.sql(_EDGES), "part-edges")


@query(f"WITH RECURSIVE e AS ({_EDGES}), b(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 10) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def graph_bfs(e: Engine) -> DataFrame:
    return graph.bfs(edges(e), e.spark.createDataFrame([(1,)], "node long"))


@query(f"WITH e AS ({_EDGES}) SELECT n AS node, sum(o) AS out_degree, sum(i) AS in_degree, sum(o + i) AS degree FROM (SELECT src AS n, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY n")
def graph_degrees(e: Engine) -> DataFrame:
    return graph.degrees(edges(e))


@query(f"""WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_EDGES}) WHERE src <> dst) SELECT x.a AS a, x.b AS b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""")
def graph_triangles(e: Engine) -> DataFrame:
    return graph.triangles(edges(e))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, weight AS w FROM ({_EDGES})), d(node, dist, hop) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT e.dst, min(d.dist + e.w), d.hop + 1 FROM d JOIN e ON d.node = e.src WHERE d.hop < 60 GROUP BY e.dst, d.hop) SELECT node, min(dist) AS distance FROM d GROUP BY node""")
def graph_shortest(e: Engine) -> DataFrame:
    return graph.shortest_paths(edges(e), 1)


@query(f"WITH e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS k FROM e GROUP BY src), c AS (SELECT count(*) AS n FROM n), r0 AS (SELECT node, 1.0 / n AS r FROM n, c), "
       + ", ".join(f"r{i} AS (SELECT n.node, 0.15 / c.n + 0.85 * coalesce(g.s, 0) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT e.dst, sum(r{i - 1}.r / o.k) AS s FROM e JOIN o ON e.src = o.src JOIN r{i - 1} ON r{i - 1}.node = e.src GROUP BY e.dst) g ON g.dst = n.node)" for i in range(1, 21))
       + " SELECT node, round(r, 8) AS rank FROM r20")
def graph_pagerank(e: Engine) -> DataFrame:
    return graph.pagerank(edges(e)).select("node", F.round("rank", 8).alias("rank"))


@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer")
def graph_components(e: Engine) -> DataFrame:
    """Customers linked along their nation, each to the next."""
    linked = e.sql("SELECT c_custkey AS src, lead(c_custkey, 1, c_custkey) OVER (PARTITION BY c_nationkey ORDER BY hash(c_custkey)) AS dst, c_nationkey FROM customer")
    firsts = e.sql("SELECT max(c_custkey) AS src, min(c_custkey) AS dst FROM customer GROUP BY c_nationkey")
    alone = e.sql("SELECT min(c_custkey) AS node, min(c_custkey) AS component FROM customer GROUP BY c_nationkey HAVING count(*) = 1")
    return components.components(linked.select("src", "dst").unionByName(firsts)).unionByName(alone)


@query(f"WITH e AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), l0 AS (SELECT DISTINCT src AS node, src AS label FROM e), "
       + ", ".join(f"l{i} AS (SELECT src AS node, label FROM (SELECT e.src, l.label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, l.label) AS r FROM e JOIN l{i - 1} l ON e.dst = l.node GROUP BY e.src, l.label) WHERE r = 1)" for i in range(1, 11))
       + " SELECT node, label FROM l10")
def graph_label_propagation(e: Engine) -> DataFrame:
    return graph.label_propagation(edges(e))


@query(f"WITH RECURSIVE e AS ({_EDGES}), p(path, node, length) AS (SELECT [CAST(1 AS BIGINT)], CAST(1 AS BIGINT), 0 UNION ALL SELECT list_append(p.path, e.dst), e.dst, p.length + 1 FROM p JOIN e ON p.node = e.src WHERE p.length < 2 AND NOT list_contains(p.path, e.dst)) SELECT array_to_string(path, '>') AS path, length FROM p WHERE length BETWEEN 1 AND 2")
def graph_paths(e: Engine) -> DataFrame:
    found = graph.paths(edges(e), e.spark.createDataFrame([(1,)], "node long"), 1, 2)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@query(f"""SELECT d.doc_id, d.lang, l.quality, g.degree, round(v.score, 4) AS score, k.k FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    JOIN (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, {_Q} ORDER BY 2 DESC, 1 LIMIT 200) v ON v.vec_id = d.doc_id
    JOIN (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM ({_EDGES}) UNION ALL SELECT dst FROM ({_EDGES})) GROUP BY n) g ON g.n = d.doc_id
    LEFT JOIN (SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY user_id) k ON k.user_id = d.doc_id""")
def cross_model_join(e: Engine) -> DataFrame:
    """Rows, vector hits, graph degrees and JSON documents joined by id."""
    q = e.catalog.resolve("embeddings").where("vec_id = 1").first()["embedding"]
    hits = vectors.top_k(e.catalog.resolve("embeddings"), list(q), 200).select(F.col("vec_id").alias("doc_id"), F.round("_vector_score", 4).alias("score"))
    degree = graph.degrees(edges(e)).select(F.col("node").alias("doc_id"), "degree")
    top = e.catalog.resolve("events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    rows = e.catalog.resolve("documents").join(e.catalog.resolve("labels"), "doc_id").join(hits, "doc_id").join(degree, "doc_id").join(top, "doc_id", "left")
    return rows.select("doc_id", "lang", "quality", "degree", "score", "k")


@query()
def graph_strong_components(e: Engine) -> DataFrame:
    return communities.strongly_connected(edges(e))


@query()
def graph_betweenness(e: Engine) -> DataFrame:
    """Of all customers, suppliers, nations and regions."""
    both_ways = e.sql(f"SELECT src, dst FROM ({_BELONGS}) UNION SELECT dst, src FROM ({_BELONGS})")
    return communities.betweenness(both_ways).select("node", F.round("betweenness", 4).alias("betweenness"))


@query()
def graph_louvain(e: Engine) -> DataFrame:
    return communities.louvain(edges(e))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, weight AS w FROM ({_EDGES})), p(path, node, cost, length) AS (SELECT [CAST(1 AS BIGINT)], CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION ALL
    SELECT list_append(p.path, e.dst), e.dst, p.cost + e.w, p.length + 1 FROM p JOIN e ON p.node = e.src WHERE p.length < 3 AND NOT list_contains(p.path, e.dst)) SELECT array_to_string(path, '>') AS path, cost FROM p WHERE node = 9 ORDER BY cost, length, p.path LIMIT 5""")
def graph_k_cheapest(e: Engine) -> DataFrame:
    found = communities.cheapest_paths(edges(e), 1, 9, 5, 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "cost")


@query()
def vector_ivf_pq(e: Engine) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 20, through the index. These vectors hardly cluster, so a recall of 0.9 takes three cells in four."""
    rows = e.catalog.resolve("embeddings")
    cells = max(1, min(1024, int(rows.count() ** 0.5 / 2)))
    found = ann.search(ann.build(rows, cells), rows, rows.where("vec_id % 20 = 0"), k=10, probes=-(-cells * 3 // 4), again=60)
    return found.select("query", "key", F.round("distance", 4).alias("distance"), "rank")


_PLACES = "SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1800) / 10.0 - 90 AS lat FROM customer"


@query(f"""SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(11 - lon) / 2), 2))), 1) AS km, lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 70 AS in_box,
    abs(lon) + abs(lat) < 45.05 AS in_diamond FROM ({_PLACES})""")
def geo_predicates(e: Engine) -> DataFrame:
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    ring = [(45.05, 0.0), (0.0, 45.05), (-45.05, 0.0), (0.0, -45.05)]
    return e.sql(_PLACES).select("c_custkey", F.round(geo.distance(lon, lat, F.lit(11.0), F.lit(48.0)) / 1000, 1).alias("km"), geo.within_box(lon, lat, (-20.0, 30.0), (40.0, 70.0)).alias("in_box"), geo.within_polygon(lon, lat, ring).alias("in_diamond"))


from tidewell.plans import catalogue_more  # noqa: E402, F401  registers queries with the helpers above
