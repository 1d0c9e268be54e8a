"""Schemas that drift between files: one consistent table and a list of all changes.

Each file's schema graph is matched with the graph of the wanted table by similarity flooding: scores
start from names, types and contents, spread along equal edges of both graphs until they settle, and
consistent correspondences are chosen from them.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querymill.session import spread, write_shared

#: The roles of a raw item: names they are known by, the contents and types they come in, and the
#: keys of objects that hold them.
ROLES = {
    "id": ("id item_id uid question_id ID key index sample_id", "number label", "integer string object", "value id"),
    "question": ("question nl_question utterance sql_prompt prompt natural_language text nl", "prose", "string array object", "text"),
    "sql": ("sql query gold_sql target_query SQL answer statement", "sql", "string object array", "text sql query"),
    "db": ("db_id dbId database DB_ID db_name db database_id", "name", "string object", "name engine db_id"),
    "schema": ("schema ddl sql_context context tables create_statements", "ddl", "string object array", "tables columns foreign_keys"),
    "evidence": ("evidence hint external_knowledge knowledge note explanation", "hint", "string array", "text"),
    "difficulty": ("difficulty hardness level complexity grade", "grade small bit", "string integer", "level"),
    "rows": ("gold_rows row_count n_rows result_rows rows num_rows", "number small", "integer string", "count"),
    "checked": ("checked is_verified verified reviewed is_checked approved", "flag bit", "boolean string integer", "value"),
    "weight": ("weight sample_weight importance w score", "fraction", "decimal string", "value"),
    "tags": ("tags topics labels keywords categories", "words name", "array string", "tags"),
    "metadata": ("metadata extra meta info attributes", "map", "object string", "source author"),
    "created": ("created created_at ts timestamp date time creation_time", "instant", "string integer object", "date time"),
}
#: Rounds after which the scores count as settled at the latest, and the change that ends them.
MOST_ROUNDS, SETTLED = 50, 1e-4
#: A field plays a role only if its name is at least this like one of the role's, or its contents fit as much.
LIKE_NAME, LIKE_CONTENT = 0.45, 0.4

_SQL = re.compile(r"\s*(?:select|with\s+\w+\s+as)\b", re.I)
_INSTANT = re.compile(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d.*)?$")
_GRADES = {"easy", "medium", "hard", "expert", "extra", "simple", "moderate", "challenging", "extra hard", "beginner", "intermediate", "advanced", "low", "high"}
_FLAGS = {"true", "false", "yes", "no", "y", "n", "t", "f"}


def json_type(value: object) -> str:
    """string, integer, decimal, boolean, array or object."""
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "decimal", list: "array", dict: "object"}.get(type(value), "string")


def content(value: object) -> str:
    """What kind of thing a value is, whatever its type."""
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, (int, float)):
        if isinstance(value, float):
            return "fraction"
        return "bit" if value in (0, 1) else "small" if 0 < value < 10 else "instant" if 900_000_000 <= value < 5_000_000_000 or value > 10**12 else "number"
    if isinstance(value, dict):
        keys = {k.lower() for k in value}
        if keys & {"tables", "columns", "foreign_keys"}:
            return "ddl"
        inside = nested(value)
        if "sql" in inside:
            return "sql"
        if keys & {"name", "db_id", "database"}:
            return "name"
        return inside.pop() if len(value) == 1 and len(inside) == 1 else "map"
    if isinstance(value, list):
        texts = [v for v in value if isinstance(v, str)]
        if not texts:
            return "map" if value and isinstance(value[0], dict) else "words"
        if all(len(t.split()) == 1 and len(t) < 40 for t in texts) and texts[0].lower() not in ("select", "with"):
            return "words"
        kind = content(" ".join(texts))
        return kind if kind in ("sql", "ddl", "hint") else "prose"
    text = value.strip()
    low = text.lower()
    if re.search(r"\bcreate\s+table\b", low):
        return "ddl"
    if _SQL.match(text) and re.search(r"\bfrom\b", low):
        return "sql"
    if low in _GRADES:
        return "grade"
    if low in _FLAGS:
        return "flag"
    if _INSTANT.match(text):
        return "instant"
    if text[:1] in "{[":
        try:
            return content(json.loads(text))
        except ValueError:
            pass
    if re.fullmatch(r"[-+]?\d+", text):
        return content(int(text))
    if re.fullmatch(r"[-+]?\d*\.\d+", text):
        return "fraction"
    if re.fullmatch(r"[A-Za-z]{1,6}[-_]?\d+", text) and not re.fullmatch(r"[a-z]+_\d", text):
        return "label"
    if re.fullmatch(r"\w+(?:\s*[,;|]\s*\w+)+", text):
        return "words"
    words = text.split()
    if len(words) <= 1:
        return "name"
    return "hint" if re.search(r"\b(?:refers? to|means|stands for|denotes|is calculated)\b|=", low) or len(words) < 6 else "prose"


def nested(value: object) -> set[str]:
    """The contents of the leaves below an object, however deep."""
    leaves, out = [value], set()
    while leaves:
        leaf = leaves.pop()
        if isinstance(leaf, dict):
            leaves += leaf.values()
        elif leaf is not None:
            out.add(content(leaf))
    return out


def properties(value: object) -> list[str]:
    """The edges of a value in its schema graph: its content and, of an object, its keys and what is nested below them."""
    if not isinstance(value, dict):
        return ["c:" + content(value)]
    return ["c:" + content(value), *("k:" + k.lower() for k in value), *("i:" + c for c in nested(value))]


def _tokens(name: str) -> frozenset[str]:
    return frozenset(re.findall(r"[a-z]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()))


def _grams(name: str) -> Counter:
    plain = f"  {re.sub(r'[^a-z0-9]', '', name.lower())} "
    return Counter(plain[i : i + 3] for i in range(len(plain) - 2))


def name_likeness(a: str, b: str) -> float:
    """0 to 1: 1 for names equal but for case and separators, else shared words and trigrams."""
    x, y = _tokens(a), _tokens(b)
    if x == y or "".join(sorted(x)) == "".join(sorted(y)):
        return 1.0
    g, h = _grams(a), _grams(b)
    dice = 2 * sum((g & h).values()) / max(1, sum(g.values()) + sum(h.values()))
    return 0.5 * len(x & y) / max(1, len(x | y)) + 0.5 * dice


def flood(start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity flooding: the fixpoint of scores spread over the pairwise connectivity graph.

    start: (fields, roles) initial scores. left: (fields, properties) and right: (roles, properties) are
    the weighted edges of the two schema graphs to the properties (types, contents, nesting) they share.
    A pair (field, role) sends its score to the pairs (p, p) of properties both have, and those send
    theirs back, each split over its edges; start is added anew in every round, as the method has it.
    """
    if not start.size:
        return start
    share_l = left / np.maximum(left.sum(0, keepdims=True), 1e-12)
    share_r = right / np.maximum(right.sum(0, keepdims=True), 1e-12)
    norm_l = left / np.maximum(left.sum(1, keepdims=True), 1e-12)
    norm_r = right / np.maximum(right.sum(1, keepdims=True), 1e-12)
    score = start / max(start.max(), 1e-12)
    for _ in range(MOST_ROUNDS):
        mixed = start + score
        properties = np.einsum("fr,fp,rp->p", mixed, norm_l, norm_r)
        spread = np.einsum("p,fp,rp->fr", properties, share_l, share_r)
        new = mixed + spread * len(start)
        new /= max(new.max(), 1e-12)
        if np.abs(new - score).max() < SETTLED:
            return new
        score = new
    return score


def match(profiles: pd.DataFrame, beside: set[tuple[str, str]]) -> dict[str, str]:
    """field → role, for the fields of one feed: profiles has columns field, type, property, n.

    beside: pairs of fields that some file has at the same time. A name has one role in a feed. In the
    order of their scores, fields take the role they fit best unless a field beside them has it already.
    """
    names = sorted(profiles["field"].unique())
    roles = list(ROLES)
    edges = {
        role: [("c:" + c, 3.0 / (j + 1)) for j, c in enumerate(contents.split())] + [("t:" + t, 1.0 / (j + 1)) for j, t in enumerate(types.split())] + [("k:" + k, 0.3) for k in keys.split()] + [("i:" + contents.split()[0], 0.3)]
        for role, (_, contents, types, keys) in ROLES.items()
    }
    known = sorted({p for own in edges.values() for p, _ in own} | set(profiles["property"]) | {"t:" + t for t in profiles["type"]})
    at = {p: i for i, p in enumerate(known)}
    left, right = np.zeros((len(names), len(known))), np.zeros((len(roles), len(known)))
    row = {n: i for i, n in enumerate(names)}
    for field, type_, property_, n in profiles[["field", "type", "property", "n"]].itertuples(index=False):
        if property_.startswith("c:"):
            left[row[field], at["t:" + type_]] += n
            left[row[field], at[property_]] += 3 * n
        else:
            left[row[field], at[property_]] += 0.3 * n
    left /= np.maximum(left.sum(1, keepdims=True), 1)
    for i, role in enumerate(roles):
        for p, weight in edges[role]:
            right[i, at[p]] += weight
    right /= right.sum(1, keepdims=True)
    named = np.array([[max(name_likeness(n, known) for known in ROLES[role][0].split()) for role in roles] for n in names]).reshape(len(names), len(roles))
    fits = np.minimum(left[:, None, :], right[None, :, :]).sum(2)
    score = flood(named * (0.25 + 0.75 * fits / np.maximum(fits.max(1, keepdims=True), 1e-12)) + 0.35 * fits, left, right)
    out: dict[str, str] = {}
    taken = defaultdict(list)
    for _, i, j in sorted(((score[i, j], i, j) for i in range(len(names)) for j in range(len(roles))), key=lambda x: (-x[0], x[1], x[2])):
        name, role = names[i], roles[j]
        if (named[i, j] >= LIKE_NAME or fits[i, j] >= LIKE_CONTENT) and name not in out and not any((min(name, other), max(name, other)) in beside for other in taken[role]):
            out[name] = role
            taken[role].append(name)
    return out


def parse(line: str | None) -> dict | None:
    """The object of a line, None if the line is no valid JSON object."""
    try:
        value = json.loads(line) if line else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def observed(lines: DataFrame) -> DataFrame:
    """(feed, file_no, field, type, property, n, first, last): what each file's fields look like.

    One pass over the lines; each task counts before the shuffle, so a file of any size sends a few rows
    a task. Values that are null and lines that aren't JSON objects don't count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for feed, file_no, line_no, line in batch.itertuples(index=False):
                for field, value in (parse(line) or {}).items():
                    if value is None:
                        continue
                    type_ = json_type(value)
                    for p in properties(value):
                        have = seen.setdefault((feed, file_no, field, type_, p), [0, line_no, line_no])
                        have[0] += 1
                        have[1], have[2] = min(have[1], line_no), max(have[2], line_no)
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=[*keys, "n", "first", "last"])

    keys = ["feed", "file_no", "field", "type", "property"]
    rows = lines.where("feed is not null and file_no is not null and line_no is not null").select("feed", "file_no", "line_no", "line")
    found = spread(rows).mapInPandas(run, "feed string, file_no int, field string, type string, property string, n long, first long, last long")
    return found.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def roles_of(seen: DataFrame) -> DataFrame:
    """(feed, field, role) of the fields that play a role.

    A feed's fields are matched once, from profiles over all its files: the rows that meet in a task are
    as many as the feed has kinds of fields, and pairs of them, however many files and lines there are.
    """
    spans = seen.groupBy("feed", "file_no", "field").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    of_file = spans.groupBy("feed", "file_no").agg(F.collect_list(F.struct("field", "first", "last")).alias("fs"))  # as many as a file has fields
    pairs = of_file.select("feed", F.explode("fs").alias("a"), "fs").select("feed", "a", F.explode("fs").alias("b"))
    pairs = pairs.where("a.field < b.field and a.first <= b.last and b.first <= a.last").select("feed", F.col("a.field").alias("field"), F.col("b.field").alias("other")).distinct()
    profiles = seen.groupBy("feed", "field", "type", "property").agg(F.sum("n").alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        met = group[group["other"].notna()]
        found = match(group[group["other"].isna()], set(zip(met["field"], met["other"])))
        return pd.DataFrame({"feed": group["feed"].iloc[0], "field": list(found), "role": list(found.values())}, columns=["feed", "field", "role"])

    return profiles.unionByName(pairs, allowMissingColumns=True).groupBy("feed").applyInPandas(run, "feed string, field string, role string")


def correspondences(lines: DataFrame) -> DataFrame:
    """(feed, field, role) of every field that plays a role in a feed."""
    return roles_of(observed(lines))


def changes(lines: DataFrame) -> DataFrame:
    """(file_name, change, field_name): how each file's roles differ from those of the feed's file before it.

    lines: (feed, file_no, file_name, line_no, line). A role's name and type in a file are those of the
    last line in which it has a value. added: the role is new; removed: it is gone, under its old name;
    renamed: its name differs, letter case included; retyped: its type differs. A file without a
    predecessor in file_no has no changes, and files count in that order however late they arrive.
    Repeated lines change nothing, invalid lines and null values don't count, fields that play no role
    are left out, other columns are ignored, an empty table gives no rows. A file of which no line is
    valid still has its place: all roles are removed by it.
    """
    # the profiles of the files, a few rows each, are read twice; the lines are not
    seen = write_shared(observed(lines), "drift-observed")
    last = seen.join(roles_of(seen), ["feed", "field"]).groupBy("feed", "file_no", "role").agg(F.max_by(F.struct("field", "type"), F.struct("last", "field", "type")).alias("x"))
    files = lines.where("feed is not null and file_no is not null").groupBy("feed", "file_no").agg(F.max(F.coalesce("file_name", F.lit(""))).alias("file_name"))
    ordered = files.withColumn("next", F.lead("file_no").over(Window.partitionBy("feed").orderBy("file_no")))
    # each file's roles are looked at twice: as what is now, and as what was before the file after it
    seen_by = last.join(ordered, ["feed", "file_no"]).select("feed", F.explode(F.array(F.struct(F.col("file_no").alias("at"), F.lit(True).alias("now")), F.struct(F.col("next").alias("at"), F.lit(False).alias("now")))).alias("y"), "role", "x")
    both = seen_by.where("y.at is not null").groupBy("feed", F.col("y.at").alias("file_no"), "role").agg(F.max(F.when(F.col("y.now"), F.col("x"))).alias("new"), F.max(F.when(~F.col("y.now"), F.col("x"))).alias("old"))
    named = both.join(ordered.withColumn("first", F.row_number().over(Window.partitionBy("feed").orderBy("file_no")) == 1).where("not first"), ["feed", "file_no"])
    kinds = {
        "added": (F.col("old").isNull(), "new"),
        "removed": (F.col("new").isNull(), "old"),
        "renamed": (F.col("new.field") != F.col("old.field"), "new"),
        "retyped": (F.col("new.type") != F.col("old.type"), "new"),
    }
    found = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(kind).alias("change"), F.col(f"{of}.field").alias("field_name"))) for kind, (holds, of) in kinds.items()]))
    return named.select("file_name", F.explode(found).alias("z")).select("file_name", "z.change", "z.field_name")


#: The consistent table.
ITEM = "feed string, file_no int, line_no long, id string, question string, sql string, dbId string, schema string, evidence string, difficulty string, gold_rows long, checked boolean, weight double, tags array<string>, metadata string, created timestamp"


def _text(value: object, joiner: str) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return joiner.join(str(v) for v in value)
    if isinstance(value, dict):
        for key in ("text", "sql", "query", "name", "db_id", "value"):
            if isinstance(value.get(key), (str, int)):
                return str(value[key])
        if len(value) == 1:
            return _text(next(iter(value.values())), joiner)
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def _number(value: object, kind: type) -> object:
    try:
        return kind(str(value).strip()) if not isinstance(value, (bool, type(None))) else None
    except ValueError:
        return None


def cast(role: str, value: object) -> object:
    """A value of any of its role's types as the one type of the consistent table; null where it has no such reading."""
    if value is None:
        return None
    if role in ("question", "sql", "id", "db"):
        return _text(value, " ")
    if role == "evidence":
        return _text(value, "; ")
    if role in ("schema", "metadata"):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if role == "difficulty":
        return {1: "easy", 2: "medium", 3: "hard", 4: "expert"}.get(_number(value, int), _text(value, " "))
    if role == "rows":
        return _number(value, int)
    if role == "weight":
        return _number(value, float)
    if role == "checked":
        return {"true": True, "yes": True, "y": True, "t": True, "1": True, "false": False, "no": False, "n": False, "f": False, "0": False}.get(str(value).strip().lower())
    if role == "tags":
        return [str(v) for v in value] if isinstance(value, list) else [t for t in re.split(r"\s*[,;|]\s*", str(value).strip()) if t]
    number = _number(value, float)
    moment = pd.to_datetime(number if number is None or number < 10**11 else number / 1000, unit="s", utc=True) if number is not None else pd.to_datetime(str(value), utc=True, errors="coerce")
    return None if moment is pd.NaT else moment


def consistent(lines: DataFrame) -> DataFrame:
    """One row per valid line with the columns of ITEM, whatever its file calls and types them.

    Lines that aren't JSON objects are left out, repeated lines (same feed, file and line number) kept
    once. Fields that play no role don't appear. The correspondences, one row a feed, are joined to the
    lines; a feed with a third of all lines is split by the adaptive skew join.
    """
    roles = correspondences(lines).groupBy("feed").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "role")))).alias("roles"))
    names = list(ROLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, str]] = {}
        for batch in batches:
            out = []
            for feed, file_no, line_no, line, packed in batch.itertuples(index=False):
                item = parse(line)
                if item is None:
                    continue
                fields = known.setdefault(packed, json.loads(packed) if packed else {})
                row: dict[str, object] = {}
                for field, value in item.items():
                    role = fields.get(field)
                    if role and value is not None and row.get(role) is None:
                        row[role] = cast(role, value)
                out.append((feed, file_no, line_no, *[row.get(r) for r in names]))
            frame = pd.DataFrame(out, columns=["feed", "file_no", "line_no", "id", "question", "sql", "dbId", "schema", "evidence", "difficulty", "gold_rows", "checked", "weight", "tags", "metadata", "created"])
            frame["gold_rows"] = frame["gold_rows"].astype("Int64")
            frame["created"] = pd.to_datetime(frame["created"], utc=True)
            yield frame

    source = lines.where("feed is not null and file_no is not null and line_no is not null").select("feed", "file_no", F.col("line_no").cast("long").alias("line_no"), "line")
    return source.join(roles, "feed", "left").mapInPandas(run, ITEM).dropDuplicates(["feed", "file_no", "line_no"])
