"""DuckDB SQL for the queries that SQL can express."""

_CANON = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9<>=*+/%]+', '', 'g')"
_LO, _HI = (f"{f}({_CANON.format('question')}, {_CANON.format('query')})" for f in ("least", "greatest"))
_KEYS = f"keys AS (SELECT DISTINCT id, {_LO} AS lo, {_HI} AS hi FROM calibration_train WHERE id IS NOT NULL)"


def _word_sets(name: str, tables: str) -> str:
    """Each record's canonical fields and its distinct words."""
    return f"{name} AS (SELECT *, len(ws) AS n FROM (SELECT DISTINCT id, {_LO} AS lo, {_HI} AS hi, list_distinct(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(query, '')), '[a-z0-9]+')) AS ws FROM {tables} WHERE id IS NOT NULL))"


_ALIKE = "7 * len(list_intersect(a.ws, b.ws)) >= 3 * (a.n + b.n)"


def _meeting(left: str, right: str) -> str:
    """Pairs that may share three quarters of their words: then they share one of the rarest quarter of either."""
    return f"""d AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM {left} UNION ALL SELECT unnest(ws) FROM {right}) GROUP BY 1),
{", ".join(f"p_{t} AS (SELECT id, w FROM (SELECT x.id, x.n, x.w, row_number() OVER (PARTITION BY x.id ORDER BY d.df, x.w) AS r FROM (SELECT id, n, unnest(ws) AS w FROM {t}) x JOIN d USING (w)) WHERE r <= n - ceil(0.75 * n) + 1)" for t in sorted({left, right}))},
m AS (SELECT DISTINCT x.id AS i, y.id AS j FROM p_{left} x JOIN p_{right} y USING (w))"""


_HELD_OUT = "(SELECT id, question, query FROM calibration_dev UNION ALL SELECT id, question, query FROM calibration_test)"
_DB_KEY = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '^[\s\pZ"''`\[\](){{}}]+|[\s\pZ"''`\[\](){{}}]+$', '', 'g'), '^.*[/\\]', ''), '\.[A-Za-z][A-Za-z0-9]{{0,9}}[\s"''`\]]*$', '')), '[^\pL\pN]+', '', 'g')"""

ORACLES = {
    "p2_found": f"""WITH RECURSIVE up AS (SELECT db_id, db_id AS root, derived_from FROM db_catalog UNION ALL SELECT up.db_id, c.db_id, c.derived_from FROM up JOIN db_catalog c ON c.db_id = up.derived_from),
roots AS (SELECT db_id, root, {_DB_KEY.format('db_id')} AS key FROM up WHERE derived_from IS NULL),
r AS (SELECT DISTINCT id, db_id AS written FROM calibration_train WHERE db_id IS NOT NULL),
f AS (SELECT r.id, r.written, coalesce(e.root, k.root) AS root FROM r LEFT JOIN roots e ON e.db_id = r.written LEFT JOIN roots k ON k.key = {_DB_KEY.format('r.written')})
SELECT id, root AS db_id FROM f WHERE root IS NOT NULL AND root <> written""",
    "p5_found": f"WITH {_word_sets('t', 'calibration_train')}, {_word_sets('h', _HELD_OUT)}, {_meeting('t', 'h')} SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM m JOIN t a ON a.id = m.i JOIN h b ON b.id = m.j WHERE {_ALIKE} UNION SELECT least(a.id, b.id), greatest(a.id, b.id) FROM t a JOIN h b USING (lo, hi)",
    "p5_report": f"""WITH {_word_sets('t', 'calibration_train')}, {_word_sets('h', _HELD_OUT)}, {_meeting('t', 'h')},
p AS (SELECT a.id AS train_id, b.id AS eval_id FROM m JOIN t a ON a.id = m.i JOIN h b ON b.id = m.j WHERE {_ALIKE} UNION SELECT a.id, b.id FROM t a JOIN h b USING (lo, hi)),
c AS (SELECT db_id, {_DB_KEY.format('db_id')} AS key FROM db_catalog), u AS (SELECT key, min(db_id) AS db_id FROM c GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT id, 'train' AS split, min(db_id) AS written FROM calibration_train GROUP BY 1 UNION ALL SELECT id, 'dev', min(db_id) FROM calibration_dev GROUP BY 1 UNION ALL SELECT id, 'test', min(db_id) FROM calibration_test GROUP BY 1),
s AS (SELECT r.id, r.split, coalesce(e.db_id, u.db_id) AS db FROM r LEFT JOIN c e ON e.db_id = r.written LEFT JOIN u ON u.key = {_DB_KEY.format('r.written')})
SELECT b.split, b.db AS eval_db, a.db AS train_db, count(*) AS pairs, count(DISTINCT p.eval_id) AS records FROM p JOIN s a ON a.id = p.train_id AND a.split = 'train' JOIN s b ON b.id = p.eval_id AND b.split <> 'train' GROUP BY 1, 2, 3""",
    "p6_found": f"WITH {_word_sets('t', 'calibration_train')}, {_meeting('t', 't')} SELECT a.id AS id_a, b.id AS id_b FROM m JOIN t a ON a.id = m.i JOIN t b ON b.id = m.j WHERE a.id < b.id AND (a.lo <> b.lo OR a.hi <> b.hi) AND {_ALIKE}",
    "p6_groups": f"""WITH RECURSIVE {_word_sets('t', 'calibration_train')}, {_meeting('t', 't')},
e AS (SELECT a.id AS a, b.id AS b FROM m JOIN t a ON a.id = m.i JOIN t b ON b.id = m.j WHERE a.id <> b.id AND {_ALIKE} UNION SELECT a.id, b.id FROM t a JOIN t b USING (lo, hi) WHERE a.id <> b.id),
r AS (SELECT id, id AS other FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS "group" FROM r GROUP BY 1""",
    "p7_found": f"WITH {_KEYS}, k AS (SELECT id, min(id) OVER (PARTITION BY lo, hi) AS keep_id FROM keys) SELECT keep_id, id AS dup_id FROM k WHERE id <> keep_id",
    "p7_copies": f"WITH {_KEYS} SELECT min(id) AS keep_id, count(*) AS copies FROM keys GROUP BY lo, hi",
}
