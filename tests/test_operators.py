import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from querymill import sinks
from querymill.operators import audit, calibration, drift, execution, judge, normalize, schema
from querymill.sources import config, files


def test_audit_keeps_columns_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "SELECT 1", "x"), (2, None, "y"), (3, "SELECT " + ", ".join(f"c{i}" for i in range(3000)) + " FROM t", "z")], "id int, sql string, tables string")
    out = {r["id"]: r for r in audit.audit(df).collect()}
    assert out[1]["parseable"] and not out[2]["parseable"] and out[3]["column_count"] == 3000
    assert out[2]["err"] == "Empty or null SQL" and out[2]["quality_score"] == 0 and out[1]["tables"] == []
    assert audit.audit(df.limit(0)).count() == 0


def test_native_scores_equal_python(spark):
    from querymill.plans.corpus import TEMPLATES

    df = spark.createDataFrame([(t,) for t in TEMPLATES], "sql string")
    for r in audit.audit(df).collect():
        f, a = audit.collect_features(r["sql"]), audit.detect_antipatterns(r["sql"])
        assert (r["difficulty_level"], r["complexity_score"], r["quality_score"], r["quality_level"]) == (f["difficulty_level"], f["complexity_score"], a["quality_score"], a["quality_level"])


def test_sql_functions(spark):
    audit.register(spark)
    row = spark.sql("select sql_features('SELECT * FROM t').difficulty_level d, sql_antipatterns('SELECT * FROM t')[0].pattern p").first()
    assert tuple(row) == ("easy", "select_star")


# drift ----------------------------------------------------------------------------------------------
LINES = "feed string, file_no int, file_name string, line_no int, line string, extra string"


def _lines(*files_):
    return [("f", n, f"f/{n}", i, line if isinstance(line, str) or line is None else json.dumps(line), "e") for n, lines in enumerate(files_, 1) for i, line in enumerate(lines, 1)]


A = {"id": 1, "question": "Show the names of all singers please", "sql": "SELECT name FROM singer", "db_id": "concert_1"}


def test_drift_changes(spark, rows):
    b = {"uid": "it-1", "question": "Show the names of all singers now", "query": {"text": "SELECT a FROM b"}, "weight": 0.5}
    df = spark.createDataFrame(_lines([A, A, "not json", "[1]", None, ""], [b, {**b, "weight": None}], [b | {"Weight": 0.25, "weight": None}]), LINES)
    assert rows(drift.changes(df)) == sorted(
        [("f/2", "added", "weight"), ("f/2", "removed", "db_id"), ("f/2", "renamed", "query"), ("f/2", "renamed", "uid"), ("f/2", "retyped", "query"), ("f/2", "retyped", "uid"), ("f/3", "renamed", "Weight")], key=repr
    )


def test_drift_edge_cases(spark):
    empty = spark.createDataFrame([], LINES)
    assert drift.changes(empty).count() == 0 and drift.consistent(empty).count() == 0
    only = spark.createDataFrame(_lines([A]), LINES)
    assert drift.changes(only).count() == 0
    gap = spark.createDataFrame(_lines([A], ["{"], [A]), LINES)
    assert sorted(r["change"] for r in drift.changes(gap).collect()) == ["added"] * 4 + ["removed"] * 4


def test_drift_consistent_table(spark):
    df = spark.createDataFrame(_lines([A], [{"uid": "x9", "sql_prompt": ["List all", "the shops here now"], "SQL": ["SELECT a", "FROM b"], "database": {"name": "d_1", "engine": "sqlite"}, "tags": "a,b", "checked": "true", "weight": "0.5", "ts": 1746954844, "gold_rows": "12", "level": 2}] * 2), LINES)
    out = [r for r in drift.consistent(df).collect() if r["file_no"] == 2]
    assert len(out) == 2
    r = out[0]
    assert (r["id"], r["question"], r["sql"], r["dbId"], r["tags"], r["checked"], r["weight"], r["gold_rows"], r["difficulty"]) == ("x9", "List all the shops here now", "SELECT a FROM b", "d_1", ["a", "b"], True, 0.5, 12, "medium")
    assert str(r["created"]) == "2025-05-11 09:14:04"


def test_drift_of_nested_fields(spark, rows):
    a = {"uid": {"value": 17}, "q": {"text": "Show the names of all singers please"}, "deep": {"given": {"sql": "SELECT a FROM b"}}, "db": {"name": "shop_1", "engine": "sqlite"}}
    b = {"ID": 17, "question": "Show the names of all singers please", "deep": "SELECT a FROM b", "db_id": "shop_1"}
    df = spark.createDataFrame(_lines([a, a], [b]), LINES)
    assert {(r["field"], r["role"]) for r in drift.correspondences(df).collect()} >= {("uid", "id"), ("q", "question"), ("deep", "sql"), ("db", "db")}
    assert ("f/2", "retyped", "deep") in rows(drift.changes(df)) and ("f/2", "renamed", "ID") in rows(drift.changes(df))
    r = drift.consistent(df).where("file_no = 1").first()
    assert (r["id"], r["question"], r["dbId"]) == ("17", "Show the names of all singers please", "shop_1")


def test_drift_of_ten_thousand_files(spark, rows):
    names = F.when(F.col("file_no") % 2 == 0, "question").otherwise("utterance")
    line = F.concat(F.lit('{"id": '), F.col("file_no").cast("string"), F.lit(', "'), names, F.lit('": "Show the names of all singers please", "sql": "SELECT a FROM b"}'))
    df = spark.range(1, 10_001).select(F.lit("f").alias("feed"), F.col("id").cast("int").alias("file_no")).withColumn("line", line).select("feed", "file_no", F.concat(F.lit("f/"), F.col("file_no").cast("string")).alias("file_name"), F.lit(1).alias("line_no"), "line")
    found = drift.changes(df)
    assert found.groupBy("change").count().collect() == [("renamed", 9_999)]


def test_drift_matches_a_brute_force(spark, rows):
    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/dataitem_lines.parquet")
    roles = {n: role for role, (names, *_) in drift.ROLES.items() for n in names.split()} | {"Question": "question"}
    state, names = {}, {}
    for r in df.orderBy("feed", "file_no", "line_no").collect():
        key = (r["feed"], r["file_no"])
        names[key] = r["file_name"]
        for k, v in (drift.parse(r["line"]) or {}).items():
            if v is not None:
                state.setdefault(key, {})[roles[k]] = (k, drift.json_type(v))
    want = set()
    for (feed, n), name in names.items():
        if (feed, n - 1) in names:
            a, b = state[feed, n - 1], state[feed, n]
            want |= {(name, "added", b[r][0]) for r in b.keys() - a.keys()} | {(name, "removed", a[r][0]) for r in a.keys() - b.keys()}
            want |= {(name, "renamed", b[r][0]) for r in a.keys() & b.keys() if a[r][0] != b[r][0]} | {(name, "retyped", b[r][0]) for r in a.keys() & b.keys() if a[r][1] != b[r][1]}
    assert set(rows(drift.changes(df))) == want


# schema ---------------------------------------------------------------------------------------------
def test_schema_classes_and_status(spark):
    columns = spark.createDataFrame([("d", "p", 0, "id", "INTEGER", False, True, True), ("d", "p", 1, "t", "TEXT", True, False, False), ("d", "c", 0, "pid", "INT", True, False, False), ("d", "c", 1, "x", "TEXT", True, False, False), ("d", "c", 2, "x", "TEXT", True, False, False)], "db_id string, table string, pos int, name string, type string, nullable boolean, pk boolean, uniq boolean")
    fk = lambda i, local, parent, theirs: ("d", "c", i, local, parent, theirs)
    fks = spark.createDataFrame([fk(0, ["pid"], "p", ["id"]), fk(1, ["pid"], "q", ["id"]), fk(2, ["pid"], "p", ["zz"]), fk(3, ["pid"], "p", [None]), fk(4, ["pid", "x"], "p", ["id"]), fk(5, ["x"], "p", ["t"]), fk(6, ["x"], "p", ["id"])], "db_id string, table string, fk_id int, local array<string>, parent_table string, parent_columns array<string>")
    kinds = {r["fk_id"]: r["fk_class"] for r in schema.fk_classes(fks, columns).collect()}
    assert kinds == {0: "valid", 1: "fk_missing_table", 2: "fk_missing_column", 3: "fk_missing_column", 4: "fk_arity_mismatch", 5: "fk_target_not_key", 6: "fk_type_mismatch"}
    dbs = spark.createDataFrame([("d", True), ("gone", False), ("bare", True)], "db_id string, healthy boolean")
    tables = spark.createDataFrame([("d", "p", False), ("d", "c", True)], "db_id string, table string, is_empty boolean")
    out = {r["db_id"]: r for r in schema.validate(dbs, tables, columns, fks).collect()}
    assert (out["d"]["status"], out["d"]["fk_invalid"], out["d"]["duplicate_columns_count"], out["d"]["empty_tables"], out["d"]["blocking_errors_total"]) == ("errors", 6, 1, ["c"], 7)
    assert (out["gone"]["status"], out["bare"]["status"], out["bare"]["tables"]) == ("failed", "ok", 0)
    text = {r["table"]: r["ddl"] for r in schema.ddl(columns, fks.where("fk_id = 0"), spark.createDataFrame([("d", "p", "t", ["it's", "b"])], "db_id string, table string, name string, examples array<string>")).collect()}
    assert text["p"] == 'CREATE TABLE "p" (\n  "id" INTEGER NOT NULL,\n  "t" TEXT /* ex: [\'it\\\'s\', \'b\'] */,\n  PRIMARY KEY ("id")\n);'
    assert 'FOREIGN KEY ("pid") REFERENCES "p" ("id")' in text["c"]


def test_orphans_ignore_nulls(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "id int")
    assert [r["k"] for r in schema.orphans(child, parent, ["k"], ["id"]).collect()] == [2]


# judge ----------------------------------------------------------------------------------------------
def test_votes(spark):
    V = "item_id string, model string, verdict string, weight double, error string"
    votes = spark.createDataFrame([("a", "m", "correct", 1.0, None), ("a", "n", "PARTIALLY-CORRECT", 3.0, None), ("b", "m", "FAILED", 1.0, "x"), ("c", "m", " INCORRECT ", None, None), ("c", "n", "incorrect", None, None), ("c", "o", None, None, None), (None, "m", "CORRECT", 1.0, None)], V)
    out = {r["item_id"]: r for r in judge.aggregate(votes).collect()}
    assert set(out) == {"a", "b", "c"}
    assert (out["a"]["weighted_score"], out["a"]["consensus_verdict"], out["a"]["status"], out["a"]["err"]) == (0.625, None, "warns", "Mixed: 1 CORRECT, 1 PARTIALLY_CORRECT")
    assert (out["b"]["status"], out["b"]["weighted_score"]) == ("failed", 0.0)
    assert (out["c"]["consensus_verdict"], out["c"]["is_unanimous"], out["c"]["status"], out["c"]["err"], out["c"]["voters_failed"]) == ("INCORRECT", True, "errors", "Unanimous INCORRECT (2/2)", 1)
    assert judge.aggregate(votes.limit(0)).count() == 0


def test_breakdown_over_all_models_and_mixed_items(spark, rows):
    votes = [("1", "m1", "CORRECT"), ("1", "m2", "INCORRECT"), ("2", "m1", "CORRECT"), ("2", "m2", "CORRECT"), ("3", "m2", "correct"), ("3", "new.4", "UNANSWERABLE"), ("4", "m1", "CORRECT"), ("4", "m2", "FAILED"), ("5", "m1", "CORRECT"), ("5", "m2", "INCORRECT")]
    df = spark.createDataFrame([(*v, 1.0, None) for v in votes], "item_id string, model string, verdict string, weight double, error string")
    got = judge.breakdown(df)
    assert got.columns == ["m1", "m2", "new.4", "items"]
    assert {tuple(r) for r in got.collect()} == {("CORRECT", "INCORRECT", None, 2), (None, "CORRECT", "UNANSWERABLE", 1)}
    assert judge.breakdown(df.limit(0)).count() == 0


def test_replies_and_asking(spark):
    texts = ['```json\n{"verdict": "correct", "explanation": "e"}\n```', '{"verdict": "MAYBE"}', "no", None, '{"explanation": "x"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0]["verdict"] for r in df.select(judge.reply(F.col("t"))).collect()] == ["CORRECT", "INCORRECT", "FAILED", "FAILED", "INCORRECT"]
    items = spark.createDataFrame([("1", "q", "s", "d")], "id string, question string, sql string, ddl string")
    voters = spark.createDataFrame([("m", "p", None), ("bad", "p", 2.0)], "model string, provider string, weight double")

    def call(provider, model, text):
        if model == "bad":
            raise RuntimeError("down")
        return json.dumps({"verdict": "CORRECT", "explanation": text})

    out = {r["model"]: r for r in judge.ask(items, voters, call, "{{dialect}} {{ddl_schema}} {{natural_question}} {{sql_to_revise}}").collect()}
    assert (out["m"]["verdict"], out["m"]["explanation"], out["bad"]["verdict"], out["bad"]["error"]) == ("CORRECT", "sqlite d q s", "FAILED", "down")


def test_voters_and_items_that_cannot_be_judged(spark):
    out = judge.expand_voters([{"name": "OpenAI", "models": ["a", {"name": "b", "weight": 2}], "weight": 0.5}, {"name": "odd", "models": ["x"]}, {"name": "stub", "model": "s"}])
    assert [(v["provider"], v["model"], v["weight"], v["temperature"]) for v in out] == [("openai", "a", 0.5, 0.0), ("openai", "b", 2.0, 0.0), ("stub", "s", 1.0, 0.0)]
    df = spark.createDataFrame([("s", "q", "d", "c"), ("s", "q", "d", " "), (None, None, "d", "c")], "sql string, question string, dbId string, ddl string")
    assert [r[0] for r in df.select(judge.invalid(1)).collect()] == [None, "empty ddl", "empty sql"]
    assert df.select(judge.invalid(0)).first()[0] == "no providers"


# calibration ----------------------------------------------------------------------------------------
def test_calibration_texts(spark):
    row = spark.createDataFrame([("Final note: PARTIALLY_CORRECT, HUMAN (CORRECT)", "2 CORRECT, 1 INCORRECT", "Mixed (x)")], "a string, b string, c string").select(calibration.human_verdict(F.col("a")), calibration.majority_of(F.col("b")), calibration.normal(F.col("c")), calibration.majority_of(F.lit("1 CORRECT, 1 INCORRECT")), calibration.human_verdict(F.lit("HUMAN: INCORRECT")), calibration.majority_of(F.lit("3 PARTIALLY_CORRECT"))).first()
    assert tuple(row) == ("PARTIALLY_CORRECT", "CORRECT", "Mixed", None, "INCORRECT", "PARTIALLY_CORRECT")


def test_reports_as_a_source(spark, tmp_path):
    text = """# Report
595, 12 - mark as correct
NOTE: 77 - Incorrect
## Majority INCORRECT
### Item: `595` (DB: `d1`)
- **Voter Details:**
  - **HUMAN** (INCORRECT/UNANSWERABLE): no
### Item: `2` (DB: `d1`)
  - **HUMAN** (PARTIALLY_CORRECT/CORRECT): half
## Mixed
### Item: `3` (DB: `d2`)
  - **HUMAN** UNANSWERABLE
### Item: `4` (DB: `d2`)
- **Voter Details:**
  - **INCORRECT**: wrong
### Item: `5` (DB: `d2`)
- **Voter Breakdown:** 3 CORRECT, 1 PARTIALLY_CORRECT, 0 INCORRECT, 0 UNANSWERABLE
### Item: `6` (DB: `d2`)
- **Voter Breakdown:** 2 CORRECT, 2 PARTIALLY_CORRECT, 0 INCORRECT, 0 UNANSWERABLE
- **Voter Details:**
  - **some-model** (CORRECT): yes
"""
    (tmp_path / "r.md").write_text(text)
    got = {r["item_id"]: (r["db_id"], r["section"], r["human"], r["way"]) for r in calibration.read_reports(spark, f"{tmp_path}/r.md").collect()}
    assert got == {
        "595": ("d1", "Majority INCORRECT", "CORRECT", "note"), "2": ("d1", "Majority INCORRECT", "PARTIALLY_CORRECT", "human"), "3": ("d2", "Mixed", "UNANSWERABLE", "human"), "4": ("d2", "Mixed", "INCORRECT", "bare"),
        "5": ("d2", "Mixed", "CORRECT", "majority"), "6": ("d2", "Mixed", None, None), "12": (None, None, "CORRECT", "note"), "77": (None, None, "INCORRECT", "note"),
    }


def test_complement_reaches_the_greatest_id(spark, tmp_path):
    from querymill.plans import queries

    spark.createDataFrame([(1,), (None,), (25_000,), (25_000,)], "id long").write.parquet(f"{tmp_path}/calibration_train.parquet")
    got = {r["id"] for r in queries.QUERIES["complement_ids"](spark, str(tmp_path)).collect()}
    assert got == set(range(2, 25_000))


def test_kappa_extremes(spark):
    same = spark.createDataFrame([("CORRECT", "CORRECT")] * 3, "original string, human string")
    assert calibration.kappa(same).first()["kappa"] == 1.0
    assert calibration.kappa(same.limit(0)).first()["kappa"] == 0.0


# normalisers ----------------------------------------------------------------------------------------
def test_normalisers(spark, rows):
    raw = spark.createDataFrame([("q", "s", "d", None, 7), (None, None, None, "x", 8)], "q string, query string, db string, id string, other int")
    items = normalize.alias_mapper(raw, {"question": "q", "sql": "query", "dbId": "db"})
    assert rows(items, "id", "question", "sql", "metadata") == [("x", "", "", '{"other":8}'), (None, "q", "s", '{"other":7}')]
    ids = {r["question"]: r["id"] for r in normalize.hash_ids(items, 8).collect()}
    import hashlib

    assert ids == {"q": hashlib.sha256(b"d\0q\0s").hexdigest()[:8], "": "x"}
    many = spark.range(40).select(F.when(F.col("id") % 3 == 0, "k").alias("id"), F.col("id").alias("n"))
    assert [r["id"] for r in normalize.incremental_ids(many, ["n"], 5).where("id <> 'k'").orderBy("n").collect()] == [str(i) for i in range(5, 31)]
    with pytest.raises(ValueError):
        normalize.hash_ids(items, 3)


def test_database_identity(spark):
    items = spark.createDataFrame([("1", "good", None), ("2", "bad", "CREATE TABLE a (b INT)"), ("3", "bad", None), ("4", None, "CREATE TABLE a (b INT)"), ("5", " ", ""), ("6", None, "CREATE nonsense")], "id string, dbId string, schema string").withColumn("steps", F.array().cast(f"array<{normalize.STEP}>"))
    out = {r["id"]: r for r in normalize.database_identity(items, spark.createDataFrame([("good", "ok"), ("bad", "error")], "db_id string, health string")).collect()}
    assert [out[i]["steps"][-1]["status"] for i in "123456"] == ["ok", "ok", "failed", "ok", "failed", "failed"]
    assert out["4"]["dbId"].startswith("t2sql_") and out["2"]["dbId"] == "bad"


# execution ------------------------------------------------------------------------------------------
def test_execution_gate_and_limit():
    assert execution.gate("drop table t") == "Blocked destructive statement: DROP"
    assert execution.gate("DELETE FROM t") == "Only SELECT statements are allowed" and execution.gate("DELETE FROM t", "all") is None
    for text in ("-- c\nDROP TABLE t", "/* x */ drop TABLE t", "SELECT 1; DROP TABLE t", ";vacuum", "/* a */ ALTER TABLE ((", "TRUNCATE TABLE t"):
        assert execution.gate(text, "all").startswith("Blocked destructive statement: "), text
    assert execution.gate("SELECT 'drop table t'", "all") is None and execution.gate("SELECT drop_date FROM t", "all") is None
    assert execution.gate(" ") == "Empty SQL" and execution.gate("SELECT a FROM t UNION SELECT b FROM u") is None
    assert execution.gate("SELECT a FROM t UNION SELECT b FROM u", strict_compat=True)
    assert execution.limited("SELECT a FROM t; -- x") == "SELECT a FROM t\nLIMIT 1" and execution.limited("SELECT a FROM t LIMIT 3") == "SELECT a FROM t LIMIT 3"
    c = sqlite3.connect(":memory:", isolation_level=None)
    c.execute("create table t (a)")
    assert execution.attempt(c, "INSERT INTO t VALUES (1)", "all")[0] and c.execute("select count(*) from t").fetchone() == (0,)
    slow = "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT MAX(n) FROM r"
    assert execution.attempt(c, slow, timeout=0.2)[1] == "Query timed out after 0.2s"
    assert "no such table" in execution.attempt(c, "SELECT a FROM zz")[1]


def test_execution_probe_and_sqlite_catalog(spark, tmp_path):
    for db in ("toy",):
        (tmp_path / db).mkdir()
        with sqlite3.connect(tmp_path / db / f"{db}.sqlite") as c:
            c.executescript("create table users (id integer primary key, email text unique); create table orders (id integer primary key, user_id int references users); insert into users values (1, 'a');")
    items = spark.createDataFrame([(1, "toy", "SELECT * FROM users"), (2, "toy", "SELECT x FROM users"), (3, "none", "SELECT 1"), (4, None, "SELECT 1"), (5, "toy", None)], "id int, db_id string, sql string")
    out = {r["id"]: r for r in execution.probe(items, root=str(tmp_path)).collect()}
    assert [out[i]["status"] for i in range(1, 6)] == ["ok", "failed", "failed", "failed", "failed"]
    assert {tuple(r) for r in execution.error_patterns(execution.probe(items, root=str(tmp_path))).collect()} == {("execution error", 1), ("db not accessible", 2)}
    tables, columns, fks, _ = files.sqlite_catalog(spark, str(tmp_path), items.select("db_id").where("db_id is not null"))
    assert {(r["table"], r["is_empty"]) for r in tables.collect()} == {("users", False), ("orders", True)}
    assert {r["name"] for r in columns.where("uniq").collect()} == {"email"}
    assert fks.first()["parent_columns"] == ["id"]
    with pytest.raises(ValueError):
        execution.probe(items, root="x", mode="odd")


def test_execution_of_a_hot_database(spark):
    """Items of one database are tried in many parts, each of which has met its DDL."""
    ddl = spark.createDataFrame([("hot", "CREATE TABLE t (a INT);"), ("cold", "CREATE TABLE u (b INT);"), ("broken", "CREATE nonsense")], "db_id string, ddl string")
    items = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, "cold").when(F.col("id") % 10 == 1, "broken").when(F.col("id") % 10 == 2, None).otherwise("hot").alias("db_id"), F.lit("SELECT a FROM t").alias("sql"))
    out = execution.probe(items, ddl, parts=4)
    assert {tuple(r) for r in out.groupBy("db_id", "status").count().collect()} == {("hot", "ok", 210), ("cold", "failed", 30), ("broken", "failed", 30), (None, "failed", 30)}
    assert {r["pattern"]: r["failures"] for r in execution.error_patterns(out).collect()} == {"execution error": 30, "db not accessible": 60}
    assert execution.totals(out).first().asDict() == {"total": 300, "analyzed": 300, "skipped": 0, "failed": 90, "failed_share": 30.0}
    assert execution.probe(items.limit(0), ddl).count() == 0


def test_databases_written_carelessly(spark):
    from querymill.operators import databases

    catalog = spark.createDataFrame([("shop_1",), ("shop-1",), ("Museum_4",), (None,)], "db_id string")
    rows = spark.createDataFrame([(1, "Museum 4"), (2, "dbs/museum_4.sqlite"), (3, "shop_1"), (4, "SHOP 1"), (5, None), (6, "other"), (7, "  ")], "id int, db_id string")
    assert {r["id"]: r["db_id"] for r in databases.resolved(rows, catalog).collect()} == {1: "Museum_4", 2: "Museum_4", 3: "shop_1", 4: None, 5: None, 6: None, 7: None}


# sources and sinks ----------------------------------------------------------------------------------
def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": 1}\n\n{"q": 2}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"q": 3}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "q int").count() == 2 and files.read_jsonl(spark, f"{tmp_path}/b.jsonl.gz").first()["q"] == 3
    (tmp_path / "bad.jsonl").write_text('{"q": 1}\n{"q"\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "q int").collect()
    (tmp_path / "c.json").write_text('[{"q": 1}, {"q": 2}]')
    assert files.read_json(spark, f"{tmp_path}/c.json").count() == 2
    (tmp_path / "lines.json").write_text('[\n {"q": 1,\n "r": [2]},\n {"q": 2}\n]')
    assert files.read_json(spark, f"{tmp_path}/lines.json").count() == 2
    (tmp_path / "lone.json").write_text('{"q": 1}')
    with pytest.raises(ValueError, match="no array of objects"):
        files.read_json(spark, f"{tmp_path}/lone.json")
    (tmp_path / "d.csv").write_text("number;word\n1;abc\n2;de\n")
    assert files.read_csv(spark, f"{tmp_path}/d.csv", multi_line=False).count() == 2
    from querymill.plans import pipeline  # noqa: F401
    from querymill.registry import get

    for split in ("train", "test"):
        spark.range(2).selectExpr("id", f"'{split}' as s").coalesce(1).toPandas().to_parquet(tmp_path / f"{split}-0.parquet")
    hub = get("loader", "hf")
    assert hub(spark, name=str(tmp_path), split="test").distinct().count() == 2 and hub(spark, name=str(tmp_path), columns=["s"]).count() == 4
    assert hub(spark, {"a": f"{tmp_path}/train-0.parquet", "b": [f"{tmp_path}/test-0.parquet"]}, split="a", columns=["s", "odd"]).distinct().collect()[0].asDict() == {"s": "train", "odd": None}
    assert files.read_csv(spark, f"{tmp_path}/d.csv").columns == ["number", "word"]
    assert files.read_csv(spark, f"{tmp_path}/d.csv", has_header=False).columns == ["col_1", "col_2"] and files.read_csv(spark, f"{tmp_path}/d.csv", has_header=False).count() == 3
    (tmp_path / "p.yaml").write_text("default: two\none: {template: 'x {{dialect}}'}\ntwo: one\n")
    assert files.prompt_template(f"{tmp_path}/p.yaml") == "x {{dialect}}"
    with pytest.raises(KeyError):
        files.prompt_template(f"{tmp_path}/p.yaml", "three")


def test_config():
    assert config.resolve({"a": ["${X}", "${Y:d}", 3]}, {"X": "1"}) == {"a": ["1", "d", 3]}
    with pytest.raises(ValueError):
        config.resolve("${Z}", {})
    assert config.severities({"sqlite": {"low": ["a"]}, "postgresql": {"high": ["b"]}}, "pg") == {"high": ["b"]}
    assert config.severities({"low": ["a"]}, "pg") == {"low": ["a"]} and config.severities({}, "pg") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok", "a|b")], "id int, status string, t string")
    sinks.write_metrics(sinks.envelope(df, "x", "e", "d"), str(tmp_path), "x")
    assert sinks.metric_tables(spark, str(tmp_path)) == ["x"] and spark.read.parquet(f"{tmp_path}/metrics_x").first()["success"]
    assert "a\\|b" in sinks.markdown_table(df)
    assert sinks.run_directory("r/", "d", 5.9) == "r/d_5"
    sinks.write_all(df, lambda x: sinks.write_jsonl(x, f"{tmp_path}/j"), lambda x: sinks.export(x, f"{tmp_path}/c"))
    assert spark.read.json(f"{tmp_path}/j").count() == 1


def _config(tmp_path, items, analyze, **more):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(x) for x in items))
    return {
        "sourceDb": {"dialect": "sqlite", "endpoint": str(tmp_path / "dbs")},
        "load": {"name": "jsonl", "params": {"path": str(tmp_path / "in.jsonl")}},
        "output": {"base_dir": str(tmp_path / "runs")},
        "normalize": [{"name": "alias_mapper", "params": {"mapping": {"sql": "query", "dbId": "db_id"}}}, {"name": "id_assign"}, {"name": "db_identity_assign"}],
        "analyze": [{"name": f"{n}_analyzer", "params": p} for n, p in analyze.items()],
        **more,
    }


def test_pipeline_and_reports(spark, tmp_path):
    from querymill.plans import pipeline

    (tmp_path / "dbs/toy").mkdir(parents=True)
    with sqlite3.connect(tmp_path / "dbs/toy/toy.sqlite") as c:
        c.executescript("create table users (id integer primary key, name text); insert into users values (1, 'a'); create table archive (id int references users); insert into archive values (7); create table empty_one (a int);")
    items = [
        {"question": "q1", "query": "SELECT name FROM users", "db_id": "toy"},
        {"question": "q2", "query": "SELECT nope FROM users", "db_id": "toy"},
        {"question": "q3", "query": "SELECT 1", "db_id": None},
        {"question": "q4", "query": "SELECT FROM", "db_id": "toy"},
        {"question": "q5", "query": "SELECT b FROM a", "db_id": None, "schema": "CREATE TABLE a (b INT); CREATE TABLE c (d INT)"},
        {"question": "q6", "query": "SELECT b FROM a", "db_id": "made", "schema": "CREATE TABLE a (b INT)"},
        {"question": "q7", "query": "SELECT b FROM a", "db_id": "broken", "schema": "CREATE TABLE a (b INT); CREATE TABLE a (b INT)"},
    ]
    judge_ = {"prompt_template": "{{ddl_schema}} {{sql_to_revise}}", "voters": [{"model": "m", "provider": "stub"}]}
    told = []
    out = pipeline.run(spark, _config(tmp_path, items, {"schema_validation": {}, "query_syntax": {}, "query_antipattern": {}, "query_execution": {}, "semantic_llm": judge_}), tell=told.append)
    assert sinks.metric_tables(spark, out) == ["query_audit", "query_execution", "schema_tables", "schema_validation", "semantic_llm_judge"]
    read = lambda name: spark.read.parquet(f"{out}/metrics_{name}")
    names = ("db_identity", "schema_validation", "query_syntax", "query_antipattern", "query_execution", "semantic_llm")
    steps = {r["question"]: {s["name"]: s["status"] for s in r["analysisSteps"]} for r in spark.read.json(f"{out}/annotatedOutputDataset").collect()}
    passed = lambda *x: dict(zip(names, x))
    assert all(v.pop("semantic_llm") for k, v in steps.items() if k in ("q1", "q5", "q6"))
    assert steps == {
        "q1": passed("ok", "errors", "ok", "ok", "ok"), "q2": passed("ok", "errors", "ok", "ok", "failed", "skipped"), "q3": passed("failed", *["skipped"] * 5), "q4": passed("ok", "errors", "failed", "skipped", "skipped", "skipped"),
        "q5": passed("ok", "warns", "ok", "ok", "ok"), "q6": passed("ok", "warns", "ok", "ok", "ok"), "q7": passed("failed", *["skipped"] * 5),
    }
    toy = read("schema_validation").where("db_id = 'toy'").first()
    assert (toy["fk_data_violations_count"], toy["fk_enforcement"], toy["empty_tables"], {e["kind"] for e in toy["errors"]}) == (1, "disabled", ["empty_one"], {"fk_data_violation"})
    assert read("schema_validation").where("status = 'skipped'").count() == 2
    assert sorted(r["status"] for r in read("query_execution").collect()) == ["failed", "ok", "ok", "ok", "skipped", "skipped", "skipped"]
    assert read("semantic_llm_judge").where("total_voters = 1").count() == 3 and len(told) == 5 and "rows" in told[0]
    for name in pipeline.REPORTS:
        assert open(f"{out}/all_reports/{name}_report.md").read().startswith("# ")
    assert json.load(open(f"{out}/run_info.json"))["counts"]["query_execution"]["skipped"] == 3


def test_shared_tables_are_released(spark):
    import os

    from querymill import session

    mark = session.written(spark)
    path = session.write_shared(spark.range(3), "kept").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and session.written(spark) == mark + 1
    assert session.release(spark, mark) == 1 and not os.path.exists(path) and session.written(spark) == mark


def test_pipeline_refuses_what_cannot_work(spark, tmp_path):
    from querymill.plans import pipeline

    with pytest.raises(ValueError, match="load.name"):
        pipeline.run(spark, {})
    with pytest.raises(KeyError):
        pipeline.run(spark, {"load": {"name": "jsonl"}, "analyze": [{"name": "odd"}]})
    (tmp_path / "plain.jsonl").write_text('{"id": "1", "question": "q", "sql": "SELECT 1", "dbId": "d"}')
    out = pipeline.run(spark, {"load": {"name": "jsonl", "params": {"path": str(tmp_path / "plain.jsonl")}}, "output": {"base_dir": str(tmp_path / "plain"), "sinks": ["jsonl"]}, "analyze": [{"name": "query_syntax_analyzer"}], "auto_generate_report": False})
    assert spark.read.json(f"{out}/query_audit_metrics").first()["status"] == "ok" and not (tmp_path / "x").parent.joinpath(out, "all_reports").exists()
    bad = {"prompt_template": "x", "voters": [{"model": "m", "provider": "openai"}]}
    with pytest.raises(ValueError, match="isn't configured"):
        pipeline.run(spark, _config(tmp_path, [{"question": "q", "query": "SELECT 1", "db_id": "d", "schema": "CREATE TABLE a (b INT)"}], {"semantic_llm": bad}))


def test_providers_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from querymill.operators import providers

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            key = self.headers.get("x-goog-api-key") or self.headers.get("x-api-key") or self.headers.get("Authorization")
            seen.append((self.path, key))
            if key == "used up" or (self.path == "/v1/messages" and "temperature" in body):
                self.send_response(429 if key == "used up" else 400)
                self.end_headers()
                return
            text = json.dumps({"verdict": "CORRECT", "explanation": self.path})
            reply = {"choices": [{"message": {"content": text}}], "content": [{"text": text}], "candidates": [{"content": {"parts": [{"text": text}]}}], "message": {"content": text}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        config = [{"name": "openai", "models": ["a"], "api_key": "k", "base_url": base}, {"name": "anthropic", "models": ["b"], "api_key": "k", "base_url": base}, {"name": "gemini", "models": ["c"], "api_keys": ["used up", "good"], "base_url": base}, {"name": "ollama", "models": ["d"], "base_url": base}, {"name": "stub", "models": ["e"]}]
        voters = judge.expand_voters(config)
        items = spark.createDataFrame([("1", "q", "s", "d")], "id string, question string, sql string, ddl string")
        table = spark.createDataFrame([(v["model"], v["provider"], v["weight"]) for v in voters], "model string, provider string, weight double")
        out = {r["provider"]: r for r in judge.ask(items, table, providers.caller(config, voters), "{{sql_to_revise}}").collect()}
        assert {p for p, r in out.items() if r["verdict"] == "CORRECT" and r["error"] is None} >= {"openai", "anthropic", "gemini", "ollama"} and out["stub"]["error"] is None
        assert ("/v1beta/models/c:generateContent", "used up") in seen and ("/v1beta/models/c:generateContent", "good") in seen
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="no provider"):
        providers.caller([{"name": "odd"}], [])
    with pytest.raises(ValueError, match="api_key"):
        providers.caller([{"name": "openai"}], [])("openai", "a", "x")


def test_databases_from_ddl(spark, tmp_path):
    ddl = spark.createDataFrame([("a", "CREATE TABLE t (x INT, y TEXT DEFAULT ';'); CREATE TABLE u (z INT)"), ("b", "CREATE TABLE t (x INT); CREATE nonsense"), ("c", None)], "db_id string, schema string")
    for _ in range(2):
        out = {r["db_id"]: r for r in files.build_databases(ddl, str(tmp_path)).collect()}
        assert (out["a"]["health"], out["b"]["health"], set(out)) == ("ok", "error", {"a", "b"}) and "CREATE nonsense" in out["b"]["err"]
    found = files.sqlite_catalog(spark, str(tmp_path), ddl.select("db_id"))
    assert {(r["db_id"], r["table"]) for r in found.tables.collect()} == {("a", "t"), ("a", "u")}
    assert {r["db_id"]: r["health"] for r in found.health.collect()} == {"a": "ok", "b": "ok", "c": "unknown"}


def test_postgres_catalog_from_its_views(spark):
    s = "public"
    views = {
        "columns": [(s, "p", "id", 1, "integer", "NO"), (s, "p", "code", 2, "text", "YES"), (s, "c", "pid", 1, "integer", "YES"), (s, "c", "a", 2, "text", "NO"), (s, "c", "b", 3, "text", "NO"), ("other", "x", "y", 1, "text", "NO")],
        "table_constraints": [(s, "p_pk", s, "p", "PRIMARY KEY"), (s, "p_code", s, "p", "UNIQUE"), (s, "c_pk", s, "c", "PRIMARY KEY"), (s, "c_fk", s, "c", "FOREIGN KEY")],
        "key_column_usage": [(s, "p_pk", "p", "id", 1, None), (s, "p_code", "p", "code", 1, None), (s, "c_pk", "c", "a", 1, None), (s, "c_pk", "c", "b", 2, None), (s, "c_fk", "c", "pid", 1, 1)],
        "referential_constraints": [(s, "c_fk", s, "p_pk")],
    }
    kinds = {"ordinal_position": "int", "position_in_unique_constraint": "int"}
    frames = {v: spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in files.POSTGRES_VIEWS[v].split(", "))) for v, rows in views.items()}
    found = files.postgres_catalog_of(frames, "db")
    assert {(r["table"], r["name"], r["pk"], r["uniq"], r["nullable"]) for r in found.columns.collect()} == {("p", "id", True, False, False), ("p", "code", False, True, True), ("c", "pid", False, False, True), ("c", "a", True, False, False), ("c", "b", True, False, False)}
    assert [(r["table"], r["local"], r["parent_table"], r["parent_columns"]) for r in found.fks.collect()] == [("c", ["pid"], "p", ["id"])]
    assert schema.fk_classes(found.fks, found.columns, "postgresql").first()["fk_class"] == "valid"


def test_judge_report_lists_all_but_the_partial_items(spark, tmp_path):
    from querymill.plans import pipeline

    votes = [(f"{k}{i}", v) for k, vs in enumerate((("INCORRECT",), ("PARTIALLY_CORRECT",), ("CORRECT",), ("CORRECT", "CORRECT", "INCORRECT"))) for i in range(1200 if k == 0 else 60) for v in vs]
    judged = judge.aggregate(spark.createDataFrame([(*v, 1.0, None) for v in votes], "item_id string, verdict string, weight double, error string"))
    judged.write.parquet(f"{tmp_path}/metrics_semantic_llm_judge")
    path = pipeline.write_reports(spark, str(tmp_path), f"{tmp_path}/r", ["llm_judge_issues"])[0]
    parts = {p.split("\n")[0]: sum(line.startswith("| ") for line in p.split("\n")) - 1 for p in open(path).read().split("## ")[1:]}
    assert {k: parts[k] for k in ("INCORRECT", "PARTIALLY_CORRECT", "CORRECT", "Mixed")} == {"INCORRECT": 1200, "PARTIALLY_CORRECT": 50, "CORRECT": 60, "Mixed": 0}


def test_antipattern_items_lists_every_id(spark):
    from querymill.plans import reports

    found = "array(named_struct('pattern', 'p', 'severity', 's', 'message', 'm'), named_struct('pattern', 'p', 'severity', 's', 'message', 'm'))"
    m = spark.createDataFrame([(i, "d", True) for i in ("10", "9", "ab3f", "11")], "id string, db_id string, parseable boolean").selectExpr("*", f"{found} as antipatterns")
    assert [tuple(r) for r in reports.antipattern_items(m).collect()] == [("p", "s", i) for i in ("9", "10", "11", "ab3f")]


def test_names_in_reports(spark):
    from querymill.plans import reports

    df = spark.createDataFrame([("select_star", "medium", 1, 3), ("own_rule", "odd", 2, 999)], "pattern string, severity string, queries int, severity_order int")
    assert [tuple(r) for r in reports.displayed(df).collect()] == [("SELECT *", "🔵 Medium", 1), ("Own Rule", "⚪ Odd", 2)]


def test_registry():
    from querymill.plans import pipeline  # noqa: F401
    from querymill.registry import get

    assert get("loader", " JSONL ") is files.read_jsonl
    with pytest.raises(KeyError, match="csv"):
        get("loader", "odd")


def test_stream(spark, tmp_path):
    from querymill.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "1", "db_id": "d", "sql": "SELECT 1"}\n')
    for k in (1, 2):
        ingest.audit_stream(ingest.read_items(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out/metrics_query_audit").count() == k
        (tmp_path / "in/b.json").write_text('{"id": "2", "db_id": "d", "sql": "SELECT ("}\n')
    for k in range(2):
        ingest.numbered_stream(ingest.read_items(spark, f"{tmp_path}/in"), f"{tmp_path}/numbered", f"{tmp_path}/check2", ["sql"], once=True).awaitTermination()
        (tmp_path / f"in/n{k}.json").write_text('{"sql": "b"}\n{"sql": "a"}\n{"id": "x", "sql": "c"}\n')
    ingest.numbered_stream(ingest.read_items(spark, f"{tmp_path}/in"), f"{tmp_path}/numbered", f"{tmp_path}/check2", ["sql"], once=True).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/numbered").where("assigned").collect()) == ["1", "2", "3", "4"]
    health = spark.createDataFrame([("d", "ok")], "db_id string, health string")
    q = ingest.with_health(ingest.read_items(spark, f"{tmp_path}/in"), health).writeStream.format("memory").queryName("healthy").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["db_id"], r["health"]) for r in spark.table("healthy").collect()} == {("d", "ok"), (None, "unknown")}
    q = ingest.first_seen(ingest.read_items(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
