import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querymill.llm import components, consensus, defects, exactdup, langid, mixing, neardup, overlap, queries, splits, tokens
from tests.conftest import DATA

RECORD = "id long, question string, query string, key string, unit long, side int, a long, b long, v string, text string, source string, n long"


def records(spark, *triples):
    """Records with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*t, "k", 1, 2, 3, 4, "v", "t", "s", 5) for t in triples], RECORD)


def canonical(r):
    return tuple(sorted(re.sub("[^a-z0-9<>=*+/%]", "", (x or "").lower()) for x in r[1:3]))


def words(r):
    return set(re.findall("[a-z0-9]+", f"{r[1] or ''} {r[2] or ''}".lower()))


def brute(left, right=None):
    out = set()
    for x in left:
        for y in left if right is None else right:
            if x[0] != y[0] and canonical(x) != canonical(y):
                a, b = words(x), words(y)
                if a and b and len(a & b) >= 0.75 * len(a | b):
                    out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


def pairs(df):
    return {tuple(r) for r in df.collect()}


ODD = [(1, None, None), (2, "", " "), (3, None, ""), (4, "A b c d e f g h", "x y z"), (5, "x Y z!", "a B c d e f g h"), (6, "A b c d e f g h i", "x y z"), (6, "A b c d e f g h i", "x y z"), (7, "<", None), (None, "A b c d e f g h", "x y z"), (8, "word " * 20_000, "x"), (9, "ÄÖ ß", "日本"), (10, "h g f e d c b a", "x y z")]


def test_exact_duplicates(spark):
    assert pairs(exactdup.duplicates(records(spark, *ODD))) == {(1, 2), (1, 3), (1, 9), (4, 5)}
    assert {r["keep_id"]: r["copies"] for r in exactdup.collapse(records(spark, *ODD)).collect()} == {1: 4, 4: 2, 6: 1, 7: 1, 8: 1, 10: 1}
    assert exactdup.duplicates(records(spark).limit(0)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "same thing", f"Q{'!' * (i % 3)}") for i in range(400)] + [(i, f"thing {i}", f"q {i}") for i in range(400, 1200)]
    assert exactdup.duplicates(records(spark, *rows)).count() == 399
    assert neardup.similar_pairs(records(spark, *rows)).count() == 0


def test_similar_pairs(spark):
    assert pairs(neardup.similar_pairs(records(spark, *ODD))) == brute({r for r in ODD if r[0]})
    assert neardup.similar_pairs(records(spark).limit(0)).count() == 0


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        base = rng.sample(vocabulary, rng.randint(6, 40))
        for _ in range(rng.choice([1, 1, 2, 4])):
            mine = [w if rng.random() > 0.08 else rng.choice(vocabulary) for w in base]
            cut = rng.randint(0, len(mine))
            rows.append((len(rows), " ".join(mine[:cut]), " ".join(mine[cut:])))
    want = brute(rows)
    assert len(want) > 50 and pairs(neardup.similar_pairs(records(spark, *rows))) == want


def test_similar_pairs_of_the_tables(spark):
    for split in ("train", "dev"):
        df = spark.read.parquet(f"{DATA}/calibration_{split}.parquet")
        rows = {(r["id"], r["question"], r["query"]) for r in df.collect() if r["id"] is not None}
        assert pairs(neardup.similar_pairs(df)) == brute(rows)


def test_similar_pairs_of_a_hot_family_with_words_of_their_own(spark):
    base = [f"common{i}" for i in range(60)]
    rows = [(0, " ".join(base), "")]
    rows += [(i, " ".join(base), " ".join(f"own{i}x{k}" for k in range(8 + i % 12))) for i in range(1, 40)]
    rows += [(100 + i, " ".join(f"other{i}x{k}" for k in range(30)), " ".join(base[:5])) for i in range(60)]
    want = brute(rows)
    assert len(want) > 100 and pairs(neardup.similar_pairs(records(spark, *rows))) == want
    assert pairs(overlap.overlaps(records(spark, *rows[::2]), records(spark, *rows[1::2]))) == brute(rows[::2], rows[1::2])


def test_similar_groups(spark):
    chain = [(20 + i, " ".join(f"c{k}" for k in range(i, i + 12)), "") for i in range(6)]
    rows = [*ODD, *chain, (40, "C0 c1 c2 c3 c4 c5 c6 c7 c8 c9 c10", "c11"), (41, "ab c", ""), (42, "a bc", "")]
    known = {r for r in rows if r[0]}
    group = {r[0]: r[0] for r in known}
    links = brute(known) | {(x[0], y[0]) for x in known for y in known if x[0] < y[0] and canonical(x) == canonical(y)}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = queries.QUERIES["p6_groups"](spark, DATA)
    assert pairs(neardup.similar_groups(records(spark, *rows))) == set(group.items()) and group[25] == group[40] == 20
    assert neardup.similar_groups(records(spark).limit(0)).count() == 0
    assert got.count() == got.select("id").distinct().count() == queries._records(spark, DATA).select("id").distinct().count()


def test_overlaps_against_brute_force(spark):
    train = spark.read.parquet(f"{DATA}/calibration_train.parquet")
    held = queries._held_out(spark, DATA)
    a, b = ({(r["id"], r["question"], r["query"]) for r in df.collect()} for df in (train, held))
    same = {(min(x[0], y[0]), max(x[0], y[0])) for x in a for y in b if canonical(x) == canonical(y)}
    assert pairs(overlap.overlaps(train, held)) == brute(a, b) | same
    assert overlap.overlaps(train.limit(0), held).count() == 0 and overlap.overlaps(train, held.limit(0)).count() == 0
    report = queries.p5_report(spark, DATA).collect()
    assert sum(r["pairs"] for r in report) == len(brute(a, b) | same)


# components and splits ------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(500, x) for x in range(501, 600)] + [(i, i + 1) for i in range(700, 760)] + [(900, 900), (None, 1), (1, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


CATALOG = [("museum_4", None), ("museum_5", "museum_4"), ("museum_6", "museum_5"), ("shop_1", None), ("loop_a", "loop_b"), ("loop_b", "loop_a"), ("lost", "gone")]
WRITTEN = ["museum_4", "Museum 5", "museum6", "`shop_1`", "C:\\data\\museum_6\\museum_6.DB", "./dbs/shop-1.sqlite", "shop1\u00a0", "[ SHOP_1 ]", "museum_44", None, "", "  ", "loop_a", "museum_5.sqlite3", "lost", "ShopOne"]


def test_misnamed_databases(spark):
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(WRITTEN)] + [(1, "Museum 5", "again"), (None, "shop-1", "")], "id long, db_id string, root string")
    catalog = spark.createDataFrame([(*c, "y") for c in CATALOG], "db_id string, derived_from string, key string")
    got = {r["id"]: r["db_id"] for r in splits.misnamed(df, catalog).collect()}
    assert got == {1: "museum_4", 2: "museum_4", 3: "shop_1", 4: "museum_4", 5: "shop_1", 6: "shop_1", 7: "shop_1", 13: "museum_4"}
    assert splits.misnamed(df.limit(0), catalog).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 == 0 else rng.choice([None, f"d{rng.randint(0, 400)}", f"D {rng.randint(0, 400)}"])) for i in range(6000)]
    catalog = spark.createDataFrame([("big", None)] + [(f"d{i}", f"d{i - i % 10}" if i % 10 else None) for i in range(400)], "db_id string, derived_from string")
    df = spark.createDataFrame(rows, "id long, db_id string")
    got = {r["id"]: r["split"] for r in splits.split(df, catalog, {"train": 0.6, "validation": 0.3, "test": 0.1}).collect()}
    assert len(got) == 6000
    groups = defaultdict(set)
    for i, db in rows:
        if db:
            n = re.sub(r"\W", "", db.lower())
            groups[n if n == "big" or int(n[1:]) >= 400 else f"d{int(n[1:]) // 10}"].add(got[i])
    assert all(len(g) == 1 for g in groups.values())
    for name, share in {"train": 0.6, "validation": 0.3, "test": 0.1}.items():
        assert abs(sum(1 for s in got.values() if s == name) / 6000 - share) < 0.005
    assert splits.split(df.limit(0), catalog, {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        splits.split(df, catalog, {"train": 0.0})


def test_splits_of_the_tables(spark):
    got = queries.p2_splits(spark, DATA).collect()
    n = len(got)
    assert n == spark.read.parquet(f"{DATA}/calibration_train.parquet").select("id").distinct().count()
    for r in spark.read.parquet(f"{DATA}/split_targets.parquet").collect():
        assert abs(sum(1 for x in got if x["split"] == r["split_name"]) / n - r["share"]) < 0.02


# defects --------------------------------------------------------------------------------------------
Q = "Show the name, age and city of all singers from France ordered by age"
CASES = [
    (None, "empty"), (" \n\t", "empty"), ("...", "empty"), ("-- ", "empty"), ("```sql\n```", "empty"), ("N/A", "empty"), ("None", "empty"), (";", "empty"), ("{}", "empty"),
    ("SELECT name FROM singer WHERE", "truncated"), ("SELECT name, age FROM singer WHERE city = 'Par", "truncated"), ("SELECT name FROM singer WHERE id IN (SELECT id FROM x", "truncated"), ("SELECT a FROM t WHERE b BETWEEN 1", "truncated"), ("SELECT a FROM t WHERE b = 1 AN", "truncated"), ("WITH x AS (SELECT 1)", "truncated"),
    ("```sql\nSELECT a FROM t WHERE b =\n```", "truncated"), ("SELECT a FROM t WHERE b = 1 …", "truncated"), ("SELECT CASE WHEN a THEN 1 FROM t", "truncated"), ("SELECT a FROM t ORDER", "truncated"), ("SELECT T1.", "truncated"), ("(SELECT a FROM t", "truncated"),
    ("SELECT name FROM singer", None), ("```sql\nSELECT name FROM singer", None), ("/* no */ SELECT a FROM t -- je ne sais pas", None), ("SELECT a FROM t WHERE b = 'I cannot answer this'", None), ("(SELECT a FROM t)", None), ("SELECT a FROM t WHERE b = 'O''Brien';", None), ("select a from t where b = 'O\\'Brien'", None), ("SELECT a AS `order` FROM t GROUP BY a", None), ("-- " + Q + "\nSELECT name FROM singer", None), ("SELECT COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1 LIMIT 3 OFFSET 1;", None), ("(```\nselect a from t where b = 1\n```)", None), ("SQL: SELECT a FROM t", None), ("\ufeffSELECT a FROM t", None),
    ("I'm sorry, but I can't help with that.", "refusal"), ("-- cannot comply with this request", "refusal"), ("As an assistant, I am unable to write this statement!", "refusal"), ("Request declined.", "refusal"), ("No answer can be given for this question.", "refusal"), ("I’m sorry, this goes against my guidelines", "refusal"),
    (Q, "copy"), (Q.upper() + "?", "copy"), ("SQL: " + Q, "copy"), ("You asked: " + Q.lower(), "copy"), ("-- " + Q, "copy"), ('"' + Q + '"', "copy"),
    ("Man muss zuerst die Tabelle filtern und danach die Spalte ausgeben.", "other_language"), ("Сначала нужно отфильтровать таблицу", "other_language"), ("singer %>% filter(age == 3)", "other_language"), ("df = singer[singer['age'] == 3]\nprint(df)", "other_language"), ("db.singer.find({ 'age': 3 }).limit(2)", "other_language"), ("const x = singer.filter(r => r.age === 3);", "other_language"), ("先过滤表格然后输出列", "other_language"),
]


@pytest.mark.parametrize("answer, kind", CASES, ids=lambda x: repr(x)[:40])
def test_defects(answer, kind):
    assert defects.defect(Q, answer) == kind


FOREIGN = """Broj korisnika dobije se brojanjem redaka tablice
Käyttäjien määrä saadaan laskemalla taulun rivit
Jumlah pengguna didapat dengan menghitung baris tabel
Antallet brukere finnes ved å telle radene i tabellen
Počet uživatelů zjistíme spočítáním řádků tabulky
Kullanıcı sayısı tablonun satırları sayılarak bulunur
A felhasználók száma a tábla sorainak megszámlálásával kapható meg
Numărul de utilizatori se obține numărând rândurile tabelului
Số người dùng có được bằng cách đếm các hàng
De gebruikers worden geteld per rij
Lietotāju skaitu iegūst, saskaitot tabulas rindas
Vartotojų skaičius gaunamas suskaičiuojant lentelės eilutes
Kasutajate arv saadakse tabeli ridade loendamisel
Numri i përdoruesve merret duke numëruar rreshtat
Idadi ya watumiaji hupatikana kwa kuhesabu safu za jedwali
Erabiltzaile kopurua taulako errenkadak zenbatuz lortzen da
El nombre d'usuaris s'obté comptant les files de la taula
Fjöldi notenda fæst með því að telja raðir töflunnar
Ang bilang ng mga gumagamit ay makukuha sa pagbilang
Število uporabnikov dobimo s štetjem vrstic tabele""".splitlines()
ENGLISH = ["You need to filter the table first and then count the rows", "Just count all rows of singer grouped by city please", "the answer depends on the year", "Here is the query you asked for", "All departments, sorted alphabetically", "singer Marie Curie from Kraków"]
PROGRAMS = ["users.iter().count()", "return users.stream().filter(u -> u.active).count();", "items.each { |x| puts x }", "len([u for u in users if u['age'] > 3])", "int n = 0; for (int i = 0; i < k; i++) { n += a[i]; }", "users |> Enum.count()", "std::count(v.begin(), v.end(), 3)"]


def test_languages_and_programs_that_no_list_names():
    assert [t for t in FOREIGN if defects.defect(Q, t) != "other_language"] == []
    assert [t for t in ENGLISH if defects.defect(Q, t) is not None] == []
    assert [t for t in PROGRAMS if defects.defect(Q, t) != "other_language"] == []


def test_long_replies_are_read_whole():
    more = "The table has many columns and each of them is described in the notes. " * 30
    assert defects.defect(Q, "I'm sorry, but I can't help with that. " + more) == "refusal"
    assert defects.defect(Q, more + "I cannot write this query.") == "refusal"
    assert defects.defect(Q, more) is None
    wide = "SELECT " + ", ".join(f"column_{i}" for i in range(200))
    assert defects.defect(Q, wide + " FROM t WHERE") == "truncated" and defects.defect(Q, wide + " FROM t") is None


def test_defects_of_exchanged_and_null_fields(spark):
    assert defects.defect("SELECT name FROM singer", Q) is None and defects.defect(None, None) is None
    df = records(spark, (1, Q, None), (1, Q, None), (2, None, None), (None, Q, ""), (3, Q, "SELECT a FROM t WHERE b IN (" + "1, " * 50_000 + "2)"), (4, "", ""))
    assert {(r["id"], r["defect"]) for r in defects.flag(df).collect()} == {(1, "empty"), (4, "empty")}
    assert defects.flag(df.limit(0)).count() == 0


def test_truncation_agrees_with_a_parser(spark):
    """Cut anywhere, a statement is truncated only if SQLite can't read it, and mostly whenever it can't."""
    import sqlite3

    c = sqlite3.connect(":memory:")
    df = spark.read.parquet(f"{DATA}/calibration_train.parquet").where("query like 'SELECT%'").limit(40)
    missed = tried = 0
    for r in df.collect():
        for at in range(40, len(r["query"]), 9):
            text = r["query"][:at]
            try:
                c.execute("explain " + text)
                error = ""
            except sqlite3.Error as e:
                error = str(e)
            broken = any(x in error for x in ("syntax error", "incomplete", "unrecognized"))
            if broken:
                tried += 1
                missed += not defects.truncated(text)
            else:
                assert not defects.truncated(text), text
    assert missed <= 0.02 * tried


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_defects_take_any_text(q, a):
    assert defects.defect(q, a) in (None, "empty", "truncated", "refusal", "copy", "other_language")


def test_tiling():
    assert defects.tiles("a b c x d e f".split(), "d e f y a b c".split()) == 6
    assert defects.tiles("a b".split(), "a b".split()) == 0


# consensus ------------------------------------------------------------------------------------------
def test_consensus_recovers_the_truth(spark):
    rng = random.Random(2)
    V = consensus.VERDICTS
    reliability = {"m1": 0.95, "m2": 0.9, "m3": 0.9, "m4": 0.45, "m5": 0.45, "m6": 0.45, "m7": 0.45}
    truth, rows, majority_right = {}, [], 0
    for i in range(600):
        t = truth[str(i)] = V[rng.choices(range(4), (5, 2, 2, 1))[0]]
        votes = []
        for m, p in reliability.items():
            v = t if rng.random() < p else (V[(V.index(t) + 1) % 4] if m > "m3" else rng.choice(V))
            votes.append(v)
            rows.append((str(i), m, v.lower().replace("_", " ") if rng.random() < 0.1 else v, i, i))
        majority_right += max(V, key=lambda v: (votes.count(v), -V.index(v))) == t
    rows += [("0", "few", V[0], 1, 1), ("1", "m1", "FAILED", 10**6, 1), ("1", "m1", None, 10**6, 2), (None, "m1", V[0], 1, 1), ("9999", "m1", None, 1, 1)]
    df = spark.createDataFrame(rows + rows[:50], "item_id string, model string, verdict string, ts long, received_at long")
    got = {r["item_id"]: r for r in consensus.consensus(df).collect()}
    assert set(got) == set(truth)
    right = sum(got[i]["verdict"] == t for i, t in truth.items())
    assert right >= 0.97 * 600 > majority_right
    found = {r["voter"]: r["reliability"] for r in consensus.reliability(df).collect()}
    assert all(abs(found[m] - p) < 0.12 for m, p in reliability.items()) and 0.3 < found["few"] < 1
    disputed = {r["item_id"] for r in consensus.disputed(df).collect()}
    assert disputed == {i for i, r in got.items() if r["different"] > 1}
    assert consensus.consensus(df.limit(0)).count() == 0 and consensus.reliability(df.limit(0)).count() == 0
    # a model that is called like a panel's side stays a model
    named = df.replace({"m1": "human"}, subset=["model"])
    panel = spark.createDataFrame([(i, "CORRECT", None) for i in range(50)], "id long, original string, human string")
    again = {r["item_id"]: r for r in consensus.consensus(named, panel).collect()}
    assert {i: r["votes"] for i, r in again.items()} == {i: r["votes"] for i, r in got.items()}
    assert {(r["voter"], r["panel"]) for r in consensus.reliability(named, panel).collect()} >= {("human", False), ("original", True)}


def test_latest_usable_vote_counts(spark):
    df = spark.createDataFrame([("a", "m", "CORRECT", 1, 1), ("a", "m", "INCORRECT", 2, 1), ("a", "m", "FAILED", 3, 1), ("a", "n", "INCORRECT", 1, 1)], "item_id string, model string, verdict string, ts long, received_at long")
    assert consensus.disputed(df).count() == 0
    r = consensus.consensus(df).first()
    assert (r["verdict"], r["agreement"], r["votes"]) == ("INCORRECT", 1.0, 2)


def test_held_out_human_verdicts(spark):
    d = "/root/testdata/sf0.01"
    votes = spark.read.parquet(f"{d}/voters.parquet")
    human = spark.read.parquet(f"{d}/calibration_verdicts.parquet").where("human is not null").select(F.col("id").cast("string").alias("item_id"), "human").distinct()
    found = consensus.consensus(votes).join(human, "item_id")
    assert found.agg(F.avg((F.col("verdict") == F.col("human")).cast("int"))).first()[0] > 0.93


# tokens ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def bpe():
    return tokens.BytePairs(tokens.read_ranks(tokens.vocabulary_path()))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60) | st.text("ab '\n\t <|endoftext>1é", max_size=40))
def test_encoding_is_that_of_the_library(bpe, library, text):
    ids = bpe.encode(text)
    assert ids == library(text) and bpe.decode(ids) == text and bpe.count(text) == len(ids)


def test_encode_and_decode(spark, library):
    texts = [None, "", "  \n", "<|endoftext|> x", "a" * 100_000, "naïve Ω " * 9000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, None, "again")], "doc_id long, text string, ids string")
    out = tokens.encode(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)} and out.count() == 7
    assert {r["doc_id"]: r["text"] for r in tokens.decode(out).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0


# mixing ---------------------------------------------------------------------------------------------
def test_plan():
    made = mixing.plan({"a": 100, "b": 100}, {"a": 0.75, "b": 0.25}, {"a": 1, "b": 1})
    assert (made.quota, made.exponent, made.budget) == ({"a": 100.0, "b": pytest.approx(100 / 3)}, 0.0, pytest.approx(400 / 3))
    made = mixing.plan({"a": 100, "b": 100}, {"a": 0.75, "b": 0.25}, {"a": 1, "b": 1}, 180)
    assert 0 < made.exponent < 1 and made.quota["a"] == pytest.approx(100, rel=1e-6) and sum(made.quota.values()) == pytest.approx(180)
    assert mixing.plan({"a": 10}, {"a": 0.5, "none": 0.5}, {"a": 2}).quota == {"a": 20.0, "none": 0.0}
    assert mixing.plan({}, {"a": 1.0}, {}).quota == {"a": 0.0}
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    x = mixing.exponent_for_entropy(shares, 1.0)
    assert mixing.entropy(mixing.temperature_weights(shares, x)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.entropy(mixing.entropy_targets({"a": 700, "b": 200, "c": 100}, 1.0)[0]) == pytest.approx(1.0, abs=1e-6)


def test_targets_that_cant_be_met_and_shares_by_entropy(spark):
    d = "/root/testdata/sf0.01"
    targets = {r["source"]: r for r in spark.read.parquet(f"{d}/mix_targets.parquet").collect()}
    whole = {r["source"]: r for r in queries.p9_report_whole(spark, d).collect()}
    assert 0 < whole[min(whole)]["exponent"] <= 1 and not all(r["met"] for r in whole.values())
    assert all(r["most_copies"] <= targets[s]["max_repeats"] for s, r in whole.items())
    assert sum(r["tokens"] for r in whole.values()) == pytest.approx(whole[min(whole)]["budget"], rel=0.05)
    even = {r["source"]: r for r in queries.p9_report_entropy(spark, d).collect()}
    assert even[min(even)]["temperature"] > 0 and whole[min(whole)]["temperature"] is None
    wanted = mixing.entropy({s: r["target_share"] for s, r in targets.items()})
    if even[min(even)]["exponent"] == 0:  # no repetition limit in the way
        assert mixing.entropy({s: r["share"] for s, r in even.items()}) == pytest.approx(wanted, abs=0.02)


def test_mixture_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    got = queries.p9_mix(spark, d).collect()
    targets = {r["source"]: r for r in spark.read.parquet(f"{d}/mix_targets.parquet").collect()}
    total = sum(r["tokens"] * r["copies"] for r in got)
    for s, t in targets.items():
        mine = [r for r in got if r["source"] == s]
        assert all(1 <= r["copies"] <= t["max_repeats"] for r in mine)
        assert abs(sum(r["tokens"] * r["copies"] for r in mine) / total - t["target_share"]) < 0.01
    report = {r["source"]: r for r in queries.p9_report(spark, d).collect()}
    assert len({r["exponent"] for r in report.values()}) == 1
    assert set(report) == set(targets) and sum(r["share"] for r in report.values()) == pytest.approx(1)


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 0), (2, None, "x", 0), (3, "", "y", 0), (4, "q r s", None, 0), (1, "a b c", "x", 0), (5, "z", "other", 0)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("x", 0.5, 2), ("y", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    assert [(r["doc_id"], r["copies"]) for r in mixed.collect()] == [(1, 2), (1, 2)]
    assert {r["source"]: r["share"] for r in mixing.report(mixed, targets).collect()} == {"x": 1.0, "y": 0.0}
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.report(mixing.mix(docs.limit(0), targets), targets).count() == 2


# languages ------------------------------------------------------------------------------------------
SAMPLES = {
    "en": "The statement joins the table singer but never looks at the column age. When the verdicts differ, keep the reason and do not change the label by hand.",
    "de": "Die Abfrage verknüpft die Tabelle singer, übersieht dabei aber die Spalte age. Wenn die Urteile sich unterscheiden, behalten Sie den Grund und ändern Sie das Label nicht von Hand.",
    "uk": "Помилка виникає лише тоді, коли файл відкривають, а інший процес ще пише до нього. Будь ласка, перевірте, чи обмеження в запиті відповідає тексту питання.",
    "ru": "Ошибка возникает только тогда, когда файл открывают, а другой процесс ещё пишет в него. Пожалуйста, проверьте, что ограничение в запросе соответствует тексту вопроса.",
}


@pytest.fixture(scope="module")
def dictionaries(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_languages(spark, dictionaries):
    sql = " SELECT name, age FROM singer WHERE city = 'Die Stadt ist nicht groß' ORDER BY age DESC\n"
    docs = [(1, SAMPLES["en"], "EN"), (2, SAMPLES["de"], "en"), (3, SAMPLES["en"] + "\n\n" + SAMPLES["de"], "en"), (4, SAMPLES["ru"] + sql, "rus"), (5, SAMPLES["uk"], None), (6, None, None), (7, " ", ""), (8, sql, "en"), (9, SAMPLES["en"] + " “das stimmt so nicht”, the reporter wrote.", "en_GB"), (10, (SAMPLES["en"] + " ") * 400, "English"), (11, SAMPLES["de"] + sql + "| a | INTEGER |\n| the column of the table | TEXT |", "German")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, label string")
    got = {tuple(r) for r in langid.mislabelled(df, dictionaries=dictionaries).collect()}
    assert got == {(2, "de"), (3, "en"), (3, "de"), (5, "uk")}
    found = {(r["doc_id"], r["lang"], df.where(f"doc_id = {r['doc_id']}").first()["text"][r["start"] : r["end"]].strip()[:9]) for r in langid.segments(df.where("doc_id = 3"), dictionaries=dictionaries).collect()}
    assert found == {(3, "en", "The state"), (3, "de", "Die Abfra")}
    assert langid.mislabelled(df.limit(0)).count() == 0 and langid.documents(df, dictionaries={}).count() == 0


def test_short_texts_and_kept_dictionaries(spark, dictionaries, tmp_path):
    docs = {1: "Kurz. Ja. Nein. Gut so.", 2: "Das ist gut. Wie alt?", 3: "It is so. Why? No.", 4: "C'est bon. Pas mal.", 5: "Так. Ні. Це воно.", 6: "No.", 7: "1. 2. 3.", 8: SAMPLES["de"] + " Ja. Nein."}
    df = spark.createDataFrame([(i, t, None) for i, t in docs.items()], "doc_id long, text string, lang string")
    langid.save(dictionaries, spark, str(tmp_path / "dictionaries"))
    kept = langid.load(spark, str(tmp_path / "dictionaries"))
    assert kept == dictionaries
    got = {r["doc_id"]: r["lang"] for r in langid.mislabelled(df, dictionaries=kept).collect()}
    assert got == {1: "de", 2: "de", 3: "en", 4: "fr", 5: "uk", 8: "de"}


def test_held_out_languages(spark, dictionaries):
    """Sentences of documents beyond the training sample, against the documents' own labels, which are right for most."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 0")
    one = langid.documents(df, dictionaries=dictionaries).where("labelled is not null and languages = 1")
    assert one.agg(F.avg((F.col("lang") == F.col("labelled")).cast("int"))).first()[0] > 0.9
    assert one.agg(F.avg("confidence")).first()[0] > 0.9


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("en-US",), ("pt_BR",), ("Ukrainian",), ("und",), ("",), (None,), ("n/a",), ("xx",), (" de ",), ("русский",)], "l string")
    assert [r[0] for r in df.select(langid.label_language(F.col("l"))).collect()] == ["en", "en", "pt", "uk", None, None, None, None, None, "de", "ru"]


# queries --------------------------------------------------------------------------------------------
def test_queries_and_their_sql(spark):
    from querymill.llm.oracles import ORACLES
    from tests.oracle import compare, connect

    c = connect(DATA)
    for name, sql in ORACLES.items():
        compare(queries.QUERIES[name](spark, DATA), sql, c)
    for name in set(queries.QUERIES) - set(ORACLES):
        assert queries.QUERIES[name](spark, DATA).columns
