import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querymill.operators.audit import collect_features, detect_antipatterns
from querymill.plans.corpus import GOLD, TEMPLATES
from querymill.sql.ddl import foreign_keys, identity, tables
from querymill.sql.facts import read


def found(sql, **kw):
    return [a["pattern"] for a in detect_antipatterns(sql, **kw)["antipatterns"]]


@pytest.mark.parametrize("row", GOLD, ids=lambda r: str(r[0]))
def test_templates(row):
    f, a = collect_features(TEMPLATES[row[0]]), detect_antipatterns(TEMPLATES[row[0]])
    assert (f["parseable"], f["difficulty_level"], f["complexity_score"]) == (bool(row[1]), row[-3], row[-2])
    assert ",".join(f"{x['pattern']}:{x['severity']}" for x in a["antipatterns"]) == row[-1]


@pytest.mark.parametrize("sql", ["SELECT FROM WHERE", "SELECT a FROM", "", "  ", None, "SELECT (1", "SELECT * FROM t WHERE", "hello world there", "SELECT a b c FROM t", "SELECT 'x", "CASE", "SELECT 1 FROM t GROUP", "WITH a AS (SELECT 1)"])
def test_unparseable(sql):
    assert not collect_features(sql)["parseable"]
    assert detect_antipatterns(sql)["quality_score"] == 0


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1;", "SELECT a, b FROM t1, t2 LEFT OUTER JOIN t3 USING (x) WHERE a IS NOT NULL", "SELECT count(DISTINCT a) FROM t", "SELECT a::int, b ILIKE 'x%' FROM t", "SELECT DISTINCT ON (a) a FROM t ORDER BY a", "INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')",
        "INSERT INTO t SELECT * FROM s", "UPDATE t SET a = 1, b = 2 WHERE c IN (1, 2)", "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10) NOT NULL, FOREIGN KEY (b) REFERENCES s (c))", "SELECT CASE WHEN a THEN 1 ELSE 2 END FROM t", "SELECT a FROM (SELECT b FROM t) AS x", "(SELECT a FROM t) UNION (SELECT b FROM s) LIMIT 3",
        "SELECT SUM(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT a FROM t WHERE (a, b) IN (SELECT c, d FROM s)", "SELECT * FROM a NATURAL JOIN b", "SELECT \"a b\", [c d], `e f` FROM t", "SELECT a FROM t WHERE b NOT BETWEEN 1 AND 2 AND c NOT LIKE '%x' ESCAPE '!'",
        "SELECT x'ab', 1e5, .5, 0x1F FROM t -- end", "SELECT a FROM t WHERE EXISTS (SELECT 1) OR NOT EXISTS (SELECT 2)", "VALUES (1, 2)", "SELECT CAST(a AS REAL) / COUNT(*) FROM t GROUP BY a", "SELECT strftime('%Y', d) FROM t", "SELECT EXTRACT(YEAR FROM d) FROM t", "SELECT a FROM t LIMIT 2, 3", "DROP TABLE IF EXISTS t", "PRAGMA foreign_keys",
    ],
)
def test_parseable(sql):
    assert collect_features(sql)["parseable"], read(sql)[1]


def test_features():
    f = collect_features("WITH c AS (SELECT 1) SELECT a, SUM(b) FROM c LEFT JOIN s.d ON c.x = d.x WHERE a > 1 AND (b < 2 OR c LIKE 'q') GROUP BY a HAVING COUNT(*) > 1 ORDER BY a, b DESC LIMIT 2 OFFSET 1")
    assert (f["cte_count"], f["where_condition_count"], f["order_by_columns"], f["tables"], f["join_types"], f["join_sides"]) == (1, 3, 2, ["c", "d"], ["INNER"], ["LEFT"])
    assert f["has_having"] and f["has_limit"] and f["has_offset"] and f["aggregate_types"] == ["COUNT", "SUM"] and f["uses_wildcard"]
    f = collect_features("SELECT a FROM t WHERE x IN (SELECT y FROM u WHERE z = (SELECT MAX(w) FROM v))")
    assert (f["subquery_count"], f["max_subquery_depth"]) == (2, 2)
    f = collect_features("SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM v EXCEPT SELECT d FROM w")
    assert sorted(f["set_op_types"]) == ["EXCEPT", "INTERSECT", "UNION"] and f["statement_type"] == "EXCEPT"


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("DELETE FROM t WHERE a = 1", []), ("UPDATE t SET a = 1", ["unsafe_update"]), ("SELECT a FROM t WHERE b <> NULL", ["null_comparison_equals"]), ("SELECT a FROM t WHERE b IN (1, NULL)", ["null_comparison_equals"]), ("SELECT a FROM t WHERE b IS NULL", []),
        ("SELECT a.x FROM a JOIN b ON a.id = b.id", []), ("SELECT a.x FROM a JOIN b USING (id)", []), ("SELECT a.x FROM a CROSS JOIN b", ["cartesian_product"]), ("SELECT a.x FROM a, b WHERE a.id = b.id", []), ("SELECT a.x FROM a JOIN b ON a.id = b.id, c", ["cartesian_product"]),
        ("SELECT a, COUNT(*) FROM t GROUP BY a", []), ("SELECT a, b, COUNT(*) FROM t GROUP BY a", ["missing_group_by"]), ("SELECT a AS z, COUNT(*) FROM t GROUP BY z", []), ("SELECT a, COUNT(*) FROM t GROUP BY 1", []), ("SELECT a + b, COUNT(*) FROM t GROUP BY a+b", []), ("SELECT b + a, COUNT(*) FROM t GROUP BY a + b", ["missing_group_by"]),
        ("SELECT upper(a), COUNT(*) FROM t GROUP BY UPPER(a)", []), ("SELECT A.x, COUNT(*) FROM A GROUP BY X", []), ("SELECT a, AVG(b) OVER (PARTITION BY c) FROM t", []), ("SELECT a FROM t ORDER BY COUNT(*)", ["missing_group_by"]),
        ("SELECT a FROM t WHERE lower('x') = a", []), ("SELECT a FROM t WHERE a + 1 > 2", ["function_in_where"]), ("SELECT p.a FROM p, q WHERE p.id = q.id AND p.m = q.x + q.y", []), ("SELECT a FROM t GROUP BY a HAVING SUM(b) > 1", []), ("SELECT a FROM t GROUP BY a HAVING ABS(a) > 1", ["function_in_where"]),
        ("SELECT a FROM t WHERE b NOT IN (1, 2)", []), ("SELECT a FROM t WHERE NOT b IN (SELECT c FROM u)", ["not_in_nullable"]), ("SELECT a FROM t WHERE b LIKE 'x%'", []), ("SELECT a FROM t WHERE b LIKE '_x'", ["leading_wildcard_like"]),
        ("SELECT 1 FROM t LIMIT 1", []), ("SELECT a FROM t LIMIT 1", ["limit_without_order_by"]), ("SELECT a FROM t UNION SELECT b FROM u LIMIT 1", ["limit_without_order_by"]), ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u LIMIT 1)", []), ("SELECT t.* FROM t", ["select_star"]), ("SELECT COUNT(*) FROM t", []),
        ("SELECT a FROM t WHERE EXISTS (SELECT b FROM u)", ["select_in_exists"]), ("SELECT DISTINCT a FROM t", []), ("SELECT COUNT(DISTINCT a) FROM t GROUP BY b", []), ("SELECT a FROM t WHERE b = (SELECT MAX(c) FROM u WHERE u.x = t.x)", ["correlated_subquery"]),
    ],
)
def test_antipatterns(sql, expected):
    assert found(sql) == expected


def test_severities_and_penalties():
    assert found("SELECT * FROM t", severities={"low": ["limit_without_order_by"]}) == []
    r = detect_antipatterns("SELECT * FROM t", severities={"odd": ["select_star"]})
    assert (r["quality_score"], r["quality_level"]) == (90, "excellent")
    assert detect_antipatterns("SELECT * FROM t", penalties={"medium": 60})["quality_score"] == 40


NAMES = st.sampled_from(["a", "b", "t", "u", "x1", "long_name"])
EXPRESSIONS = st.recursive(NAMES | st.integers(0, 99).map(str) | st.just("'s'"), lambda e: st.tuples(e, st.sampled_from(["+", "=", "AND", "<", "||"]), e).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(EXPRESSIONS, min_size=1, max_size=3), NAMES, EXPRESSIONS)
def test_text_of_the_tree_parses_to_the_same_features(items, source, where):
    sql = f"select {', '.join(items)}  from {source}\n where {where}"
    statement, err = read(sql)
    assert err is None
    assert collect_features(statement.root.text) == collect_features(sql)
    assert 0 <= detect_antipatterns(sql)["quality_score"] <= 100


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_handled(text):
    assert collect_features(text)["parseable"] in (True, False)


def test_ddl():
    text = "CREATE TABLE a (id INTEGER PRIMARY KEY, n TEXT NOT NULL); create table b (x int, y int, primary key (x), foreign key (y) references a(id));"
    assert [c["name"] for c in tables(text)["a"]] == ["id", "n"] and tables(text)["b"][0]["pk"]
    assert foreign_keys(text) == [{"table": "b", "local": ["y"], "parent_table": "a", "parent_columns": ["id"]}]
    assert identity(text) == identity("-- c\n" + text.replace("; ", ";\n\n")) != identity("CREATE TABLE a (id TEXT)")
    assert identity("nonsense") is None and identity(text).startswith("t2sql_")
