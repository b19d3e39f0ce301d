"""The pipeline language beyond single clauses: windows, subqueries, patterns, paths, searches, inline rows, changes."""

import pytest

from tidewell.engine import Engine
from tidewell.plans.pql import PqlError


@pytest.fixture(scope="module")
def e(spark):
    out = Engine(spark)
    out.catalog.put("crew", spark.createDataFrame([(1, "Ida", "x", 40, [1, 2]), (2, "Leo", "x", 25, []), (3, "Mio", "y", 31, [5]), (4, "Noa", "y", 31, None)], "id long, nick string, team string, years long, tags array<int>"))
    out.catalog.put("trips", spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 3, 2.0)], "tid long, crew long, km double"))
    out.catalog.put("roads", spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (4, 1, 9.0)], "src long, dst long, weight double"))
    out.catalog.put("spots", spark.createDataFrame([(1, "old harbour town", [1.0, 0.0]), (2, "harbour lights", [0.0, 1.0]), (3, "quiet hills", [0.7, 0.7]), (4, "hills", None)], "sid long, text string, embedding array<float>"))
    return out


def got(e, text, **params):
    return [tuple(r) for r in e.pql(text, **params).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("QUERY crew COMPUTE r = ROW_NUMBER() OVER (PARTITION BY team ORDER BY years DESC, id) SELECT id, r ORDER BY id", [(1, 1), (2, 2), (3, 1), (4, 2)]),
        ("QUERY crew COMPUTE s = SUM(years) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), p = LAG(nick, 1, 'none') OVER (ORDER BY id) SELECT s, p ORDERBY s", [(40, "none"), (56, "Leo"), (62, "Mio"), (65, "Ida")]),
        ("QUERY crew QUALIFY RANK() OVER (PARTITION BY team ORDER BY years) = 1 SELECT id ORDER BY id", [(2,), (3,), (4,)]),
        ("QUERY crew WHERE EXISTS (QUERY trips WHERE crew = id AND km > 4) SELECT id", [(1,)]),
        ("QUERY crew AS c WHERE NOT EXISTS (QUERY trips WHERE crew = c.id) SELECT id ORDER BY id", [(2,), (4,)]),
        ("QUERY crew WHERE id IN (QUERY trips SELECT crew) SELECT id ORDER BY id", [(1,), (3,)]),
        ("QUERY crew WHERE years > (QUERY crew COMPUTE m = AVG(years)) SELECT id", [(1,)]),
        ("QUERY crew WHERE 'Ida' == nick AND id <> 7 AND NOT years IS NULL SELECT nick + '-' + team AS t", [("Ida-x",)]),
        ("QUERY crew WHERE 2 IN tags OR tags CONTAINS 5 SELECT id ORDER BY id", [(1,), (3,)]),
        ("QUERY crew WHERE ANY(t IN tags WHERE t > 4) SELECT id", [(3,)]),
        ("QUERY crew WHERE ALL(t IN tags WHERE t > 4) SELECT id ORDER BY id", [(2,), (3,)]),
        ("QUERY crew WHERE tags IS NOT NULL SELECT LENGTH(tags) AS n, LENGTH(nick) AS m ORDER BY n", [(0, 3), (1, 3), (2, 3)]),
        ("QUERY crew COMPUTE some = 1 < COUNT(*), n = COUNT(DISTINCT team)", [(True, 2)]),
        ("QUERY crew WHERE id = 1 SELECT 9007199254740993 / 1 AS a, -7 / 2 AS b, 7 / 0 AS c, years / 7 AS d, 7.0 / 2 AS f, 2 ^ 3 ^ 2 AS g", [(9007199254740993, -3, None, 5, 3.5, 512.0)]),
        ("QUERY crew UNWIND tags AS t WHERE t > 1 SELECT id, t ORDER BY t", [(1, 2), (3, 5)]),
        ("QUERY crew TAKE 4 SKIP 1 ORDER BY id LIMIT 1 SELECT id", [(2,)]),
        ("QUERY [{a: 1, b: 'x'}, {a: 2}] WHERE a > 1 SELECT a, b", [(2, None)]),
        ("QUERY (trips, [{x: 1}]) SELECT tid", None),
        ("QUERY (QUERY trips GROUP BY crew COMPUTE far = SUM(km)) WHERE far > 3 SELECT crew, far", [(1, 12.0)]),
        ("QUERY crew INNER JOIN trips ON id = crew AND km > 4 SELECT id, km ORDER BY km", [(1, 5.0), (1, 7.0)]),
        ("QUERY crew WHERE id = 1 SELECT {n: nick, y: years} AS o, [1, 2] AS l", [(("Ida", 40), [1, 2])]),
        ("QUERY crew WHERE id = 1 TRAVERSE roads DEPTH 1 TO 2 ANY ORDER BY node", [(2, 1), (3, 1), (4, 2)]),
        ("QUERY crew WHERE id = 1 TRAVERSE roads DEPTH 2 TO 3 SHORTEST SELECT path, cost", [([1, 3, 4], 6.0)]),
        ("QUERY crew WHERE id = 1 TRAVERSE roads WHERE weight < 2 DEPTH 2 ALL SELECT path", [([1, 2, 3],)]),
        ("QUERY crew PATH SHORTEST FROM 1 TO 4 IN roads SELECT path, cost, length", [([1, 2, 3, 4], 3.0, 3)]),
        ("QUERY crew PATH ALL FROM 1 TO 4 IN roads DEPTH 3 SELECT PATH_LENGTH(path) AS n ORDER BY n", [(2,), (3,)]),
        ("QUERY crew MATCH (id)-[r:roads]->(b)-[:roads]->(c:crew) WHERE nick = 'Leo' SELECT id, b, c, c_node.nick AS n", [(2, 3, 4, "Noa")]),
        ("QUERY crew MATCH (id)<-[r:roads]-(b) WHERE id = 1 SELECT b, r.weight AS w", [(4, 9.0)]),
        ("QUERY crew MATCH (id)-[p:roads*2..3]->(b) WHERE id = 2 SELECT b, p ORDER BY b", [(1, [2, 3, 4, 1]), (4, [2, 3, 4])]),
        ("QUERY crew WHERE id < 3 OPTIONAL MATCH (id)-[:trips_as_edges]->(t) SELECT id, t ORDER BY id, t", [(1, 10), (1, 11), (2, None)]),
        ("QUERY spots SIMILAR TO [1.0, 0.1] TOP 2 THRESHOLD 0.5 SELECT sid", [(1,), (3,)]),
        ("QUERY spots NOT SIMILAR TO [1.0, 0.0] SELECT sid ORDER BY sid", [(2,), (4,)]),
        ("QUERY spots SIMILAR TO CENTROID(QUERY spots WHERE sid = 2) TOP 1 SELECT sid", [(2,)]),
        ("QUERY spots SEARCH 'harbour town' TOP 1 SELECT sid", [(1,)]),
        ("QUERY spots HYBRID SEARCH 'hills' SIMILAR TO [1.0, 0.0] ALPHA 0.9 TOP 1 SELECT sid", [(1,)]),
        ("QUERY spots HYBRID SEARCH 'lights' SIMILAR TO [1.0, 0.0] ALPHA 0.1 TOP 1 SELECT sid", [(2,)]),
        ("QUERY spots WHERE sid < 3 COMPUTE same = COSINE_SIMILARITY(EMBED(text, 16), EMBED('harbour town old', 16)) ORDER BY same DESC LIMIT 1 SELECT sid, ROUND(same, 3) AS s", [(1, 1.0)]),
        ("QUERY crew COMPUTE d = GRAPH_CENTRALITY(roads, id, 'degree') SELECT id, d ORDER BY id", [(1, 3.0), (2, 2.0), (3, 3.0), (4, 2.0)]),
        ("QUERY crew WHERE id = 2 COMPUTE c = CONNECTED(id, 4, roads), n = CONNECTED(id, 77, roads) SELECT c, n", [(True, False)]),
        ("QUERY crew WHERE id = 1 COMPUTE a = DATE_ADD(DATE('2024-02-28'), 2), b = MINUTE(TIMESTAMP('2024-01-01 05:06:07')), c = SLICE(tags, 0, 1) SELECT YEAR(a) AS y, DAY(a) AS d, b, c", [(2024, 1, 6, [1])]),
        ("QUERY crew WHERE nick STARTS WITH 'I' OR nick ENDS WITH 'oa' OR nick MATCHES '^M.o$' OR nick LIKE 'L%' SELECT id ORDER BY id", [(1,), (2,), (3,), (4,)]),
        ("QUERY crew WHERE nick = @who OR nick = @unbound SELECT id", [(3,)]),
    ],
)
def test_query(e, text, want):
    e.catalog.put("trips_as_edges", e.spark.sql("SELECT crew AS src, tid AS dst FROM trips"))
    if want is None:
        with pytest.raises(PqlError):
            e.pql(text)
        return
    out = got(e, text, who="Mio")
    assert [tuple(tuple(v) if hasattr(v, "asDict") else v for v in r) for r in out] == want


@pytest.mark.parametrize("text", ["QUERY crew WHERE id IN (1, 2", "QUERY crew WHERE id IN (1, 2]", "QUERY crew WHERE NOT", "QUERY crew COMPUTE a = RANK()", "QUERY crew WHERE id NOT 3", "QUERY crew MATCH (a)", "QUERY crew SELECT id)"])
def test_errors(e, text):
    with pytest.raises(PqlError):
        e.pql(text).collect()


def test_changes(spark):
    e = Engine(spark)
    assert got(e, "INSERT INTO pets {_id: 'a', age: 3}, {_id: 'b', age: 5, kind: 'cat'}") == [(2,)]
    assert got(e, "INSERT INTO pets {_id: 'c'}") == [(1,)]
    assert got(e, "UPDATE pets SET age = age + 1, seen = TRUE WHERE age >= 5") == [(1,)]
    assert sorted(got(e, "QUERY pets SELECT _id, age, seen"), key=str) == [("a", 3, None), ("b", 6, True), ("c", None, None)]
    assert got(e, "DELETE FROM pets WHERE age < 4") == [(1,)]
    assert got(e, "QUERY pets ORDER BY _id SELECT _id") == [("b",), ("c",)] and got(e, "QUERY pets VERSION 0 ORDER BY _id SELECT _id") == [("a",), ("b",)]
    got(e, "CREATE EDGE likes FROM 'a' TO 'b' WEIGHT 2")
    got(e, "CREATE EDGE likes FROM 'a' TO 'b' WEIGHT 3")
    got(e, "CREATE EDGE likes FROM 'b' TO 'c'")
    assert sorted(got(e, "QUERY likes")) == [("a", "b", 3.0), ("b", "c", 1.0)]
    assert got(e, "CREATE NODE pets {_id: 'z', age: 1}") == [(1,)] and e.pql("EXPLAIN QUERY pets").count() > 2
