"""A corpus of SQL statements made from table rows the same way by Spark and by SQL, with its true features.

Statement number key % n of TEMPLATES goes to the order of that key, so any engine can make the corpus
from `orders`; GOLD holds what is true of each statement, written down by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.session import table

TEMPLATES = [
    "SELECT id, name FROM users WHERE id = 1 ORDER BY id LIMIT 1",
    "SELECT * FROM users",
    "SELECT u.name, COUNT(o.id) FROM users u INNER JOIN orders o ON u.id = o.user_id GROUP BY u.name",
    "SELECT name FROM users WHERE id NOT IN (SELECT user_id FROM orders)",
    "SELECT id FROM users UNION ALL SELECT id FROM admins",
    "SELECT a.id FROM a, b",
    "SELECT country, COUNT(*) FROM singer",
    "SELECT id FROM users WHERE name = NULL",
    "SELECT id FROM users WHERE UPPER(name) = 'X'",
    "SELECT id FROM users WHERE name LIKE '%x'",
    "SELECT id FROM users LIMIT 5 OFFSET 2",
    "SELECT DISTINCT user_id FROM orders GROUP BY user_id",
    "SELECT u.id FROM users u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id)",
    "WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c WHERE n < 10) SELECT n FROM c",
    "SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM users",
    "DELETE FROM users",
    "SELECT FROM WHERE",
    "DROP TABLE users",
    "SELECT SUM(total), AVG(total) FROM orders WHERE total > 10 AND user_id = 3 OR total < 1",
    "SELECT name FROM users WHERE id IN (SELECT user_id FROM orders WHERE total > (SELECT AVG(total) FROM orders))",
    "SELECT u.name FROM users u CROSS JOIN orders o WHERE u.id = o.user_id ORDER BY u.name, o.id",
    "SELECT user_id, MAX(total) FROM orders GROUP BY user_id HAVING COUNT(*) > 2 ORDER BY MAX(total) DESC",
    "UPDATE users SET name = 'x'",
    "UPDATE users SET name = 'x' WHERE id = 3",
    "DELETE FROM orders WHERE total < 5",
    "UPDATE orders SET total = total + 1",
    "DELETE FROM admins",
    "SELECT id FROM users WHERE name IN ('a', NULL)",
    "SELECT id FROM users WHERE name <> NULL",
    "SELECT id FROM users WHERE name IS NULL",
    "SELECT id FROM users WHERE NULL = id",
    "SELECT id FROM users WHERE id NOT IN (1, NULL)",
    "SELECT a.id FROM users a CROSS JOIN orders b",
    "SELECT a.id FROM users a JOIN orders b USING (id)",
    "SELECT a.id FROM users a, orders b WHERE a.id = b.user_id",
    "SELECT a.id FROM users a JOIN orders b ON a.id = b.user_id, singer c",
    "SELECT a.id FROM users a JOIN users b ON b.id = b.id",
    "SELECT user_id, SUM(total) FROM orders",
    "SELECT user_id, id, COUNT(*) FROM orders GROUP BY user_id",
    "SELECT user_id AS u, COUNT(*) FROM orders GROUP BY u",
    "SELECT user_id, COUNT(*) FROM orders GROUP BY 1",
    "SELECT id FROM orders ORDER BY COUNT(id)",
    "SELECT id FROM users WHERE LOWER(name) LIKE 'x%'",
    "SELECT id FROM orders WHERE total + 1 > 3",
    "SELECT id FROM orders WHERE total > ABS(3)",
    "SELECT user_id FROM orders GROUP BY user_id HAVING ABS(user_id) > 1",
    "SELECT a.id FROM orders a, users b WHERE a.user_id = b.id AND a.total = b.id * 2",
    "SELECT id FROM users WHERE NOT id IN (SELECT user_id FROM orders)",
    "SELECT id FROM users WHERE id NOT IN (1, 2)",
    "SELECT id FROM users WHERE NOT EXISTS (SELECT 1 FROM orders)",
    "SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM orders WHERE user_id IS NOT NULL)",
    "SELECT id FROM users WHERE name LIKE '_a'",
    "SELECT id FROM users WHERE name LIKE 'a%'",
    "SELECT id FROM users WHERE name NOT LIKE '%a'",
    "SELECT id FROM users WHERE name LIKE '%' || 'a'",
    "SELECT id FROM users UNION SELECT id FROM admins LIMIT 3",
    "SELECT 1 FROM users LIMIT 1",
    "SELECT id FROM users WHERE EXISTS (SELECT 1 FROM orders LIMIT 1)",
    "SELECT id FROM users ORDER BY id LIMIT 5 OFFSET 5",
    "SELECT id FROM users LIMIT 3",
    "SELECT DISTINCT name, COUNT(*) FROM users GROUP BY name",
    "SELECT DISTINCT name FROM users",
    "SELECT COUNT(DISTINCT name) FROM users GROUP BY id",
    "SELECT DISTINCT x.name FROM (SELECT name FROM users GROUP BY name) AS x",
    "SELECT id FROM users WHERE id = (SELECT MAX(user_id) FROM orders WHERE orders.total = users.id)",
    "SELECT name, (SELECT COUNT(*) FROM orders o WHERE o.user_id = u.id) FROM users u",
    "SELECT id FROM users u WHERE id IN (SELECT user_id FROM orders o WHERE o.total > 5)",
    "SELECT u.* FROM users u",
    "SELECT COUNT(*) FROM users",
    "SELECT id FROM (SELECT * FROM users) AS x",
    "SELECT id FROM users u WHERE EXISTS (SELECT o.id FROM orders o)",
    "SELECT id FROM users WHERE EXISTS (SELECT * FROM orders)",
    "SELECT id FROM users WHERE EXISTS (SELECT 1, 'a' FROM orders)",
    "SELECT id, SUM(total) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders",
    "SELECT id, RANK() OVER (ORDER BY total DESC) AS r, LAG(total) OVER (ORDER BY id) AS p FROM orders",
    "SELECT id FROM orders WHERE total BETWEEN 1 AND 10",
    "SELECT CASE WHEN total > 5 THEN 'high' ELSE 'low' END FROM orders",
    "SELECT id FROM users INTERSECT SELECT user_id FROM orders",
    "SELECT id FROM users EXCEPT SELECT user_id FROM orders",
    "SELECT CAST(total AS INTEGER) FROM orders WHERE id BETWEEN 1 AND 3 ORDER BY total DESC, id",
    "SELECT total * 2 + 1, name || '!' FROM orders, users WHERE orders.user_id = users.id",
    "WITH a AS (SELECT id FROM users), b AS (SELECT user_id FROM orders) SELECT a.id FROM a LEFT JOIN b ON a.id = b.user_id",
    "INSERT INTO admins (id) VALUES (1)",
    "CREATE TABLE extra (id INTEGER PRIMARY KEY, name TEXT)",
    "SELECT id FROM users WHERE",
    "SELECT name, FROM users",
    "SELECT * FROM users a, orders b WHERE a.name = NULL",
    "SELECT a.id, COUNT(*) FROM users a, orders b WHERE UPPER(a.name) LIKE '%x'",
    "SELECT * FROM users WHERE name = NULL LIMIT 2 OFFSET 1",
]

#: Tpl, parseable, type, read_only, tables, columns, joins, join types, subqueries, depth, aggregates, aggregate types, where conditions,
#: order columns, ctes, recursive, windows, window types, set operations, their types, flags (w wildcard, d distinct, g group, h having, l limit,
#: o offset, k like, i in, b between, c case, f frame, s select), difficulty, score, antipatterns as pattern:severity.
GOLD = [
    (0, 1, "SELECT", 1, "users", 4, 0, "", 0, 0, 0, "", 1, 1, 0, 0, 0, "", 0, "", "ls", "easy", 10, ""),
    (1, 1, "SELECT", 1, "users", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ws", "easy", 10, "select_star:medium"),
    (2, 1, "SELECT", 1, "orders,users", 5, 1, "INNER", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "gs", "medium", 42, ""),
    (3, 1, "SELECT", 1, "orders,users", 3, 0, "", 1, 1, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "hard", 71, "not_in_nullable:high"),
    (4, 1, "UNION", 1, "admins,users", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 1, "UNION_ALL", "", "medium", 40, ""),
    (5, 1, "SELECT", 1, "a,b", 1, 1, "INNER", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, "cartesian_product:critical"),
    (6, 1, "SELECT", 1, "singer", 1, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "ws", "medium", 41, "missing_group_by:critical"),
    (7, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, "null_comparison_equals:critical"),
    (8, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, "function_in_where:high"),
    (9, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, "leading_wildcard_like:high"),
    (10, 1, "SELECT", 1, "users", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "los", "easy", 10, "limit_without_order_by:high,offset_without_order_by:high"),
    (11, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "dgs", "medium", 40, "redundant_distinct:medium"),
    (12, 1, "SELECT", 1, "orders,users", 3, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 40, "correlated_subquery:medium"),
    (13, 1, "SELECT", 1, "c", 3, 0, "", 0, 0, 0, "", 1, 0, 1, 1, 0, "", 1, "UNION_ALL", "s", "expert", 93, ""),
    (14, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 0, 1, 0, 0, 1, "ROWNUMBER", 0, "", "s", "hard", 71, ""),
    (15, 1, "DELETE", 0, "users", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, "unsafe_delete:critical"),
    (16, 0, "", 0, "", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "unknown", 0, ""),
    (17, 1, "DROP", 0, "users", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, ""),
    (18, 1, "SELECT", 1, "orders", 5, 0, "", 0, 0, 2, "AVG,SUM", 3, 0, 0, 0, 0, "", 0, "", "s", "medium", 42, ""),
    (19, 1, "SELECT", 1, "orders,users", 5, 0, "", 2, 2, 1, "AVG", 1, 0, 0, 0, 0, "", 0, "", "is", "expert", 95, ""),
    (20, 1, "SELECT", 1, "orders,users", 5, 1, "CROSS", 0, 0, 0, "", 1, 2, 0, 0, 0, "", 0, "", "s", "medium", 41, ""),
    (21, 1, "SELECT", 1, "orders", 4, 0, "", 0, 0, 3, "COUNT,MAX", 0, 1, 0, 0, 0, "", 0, "", "wghs", "hard", 73, ""),
    (22, 1, "UPDATE", 0, "users", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, "unsafe_update:critical"),
    (23, 1, "UPDATE", 0, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "", "easy", 10, ""),
    (24, 1, "DELETE", 0, "orders", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "", "easy", 10, ""),
    (25, 1, "UPDATE", 0, "orders", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, "unsafe_update:critical"),
    (26, 1, "DELETE", 0, "admins", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, "unsafe_delete:critical"),
    (27, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "easy", 10, "null_comparison_equals:critical"),
    (28, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, "null_comparison_equals:critical"),
    (29, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, ""),
    (30, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, "null_comparison_equals:critical"),
    (31, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "easy", 10, "null_comparison_equals:critical"),
    (32, 1, "SELECT", 1, "orders,users", 1, 1, "CROSS", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, "cartesian_product:critical"),
    (33, 1, "SELECT", 1, "orders,users", 1, 1, "INNER", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, ""),
    (34, 1, "SELECT", 1, "orders,users", 3, 1, "INNER", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, ""),
    (35, 1, "SELECT", 1, "orders,singer,users", 3, 2, "INNER,INNER", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 42, "cartesian_product:critical"),
    (36, 1, "SELECT", 1, "users", 3, 1, "INNER", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, "cartesian_product:critical"),
    (37, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 1, "SUM", 0, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, "missing_group_by:critical"),
    (38, 1, "SELECT", 1, "orders", 3, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "wgs", "medium", 41, "missing_group_by:critical"),
    (39, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "wgs", "medium", 41, ""),
    (40, 1, "SELECT", 1, "orders", 1, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "wgs", "medium", 41, ""),
    (41, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 1, "COUNT", 0, 1, 0, 0, 0, "", 0, "", "s", "medium", 41, "missing_group_by:critical"),
    (42, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, "function_in_where:high"),
    (43, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, "function_in_where:high"),
    (44, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "easy", 10, ""),
    (45, 1, "SELECT", 1, "orders", 3, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ghs", "hard", 71, "function_in_where:high"),
    (46, 1, "SELECT", 1, "orders,users", 5, 1, "INNER", 0, 0, 0, "", 2, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, ""),
    (47, 1, "SELECT", 1, "orders,users", 3, 0, "", 1, 1, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "hard", 71, "not_in_nullable:high"),
    (48, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "easy", 10, ""),
    (49, 1, "SELECT", 1, "orders,users", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 40, ""),
    (50, 1, "SELECT", 1, "orders,users", 4, 0, "", 1, 1, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "hard", 71, "not_in_nullable:high"),
    (51, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, "leading_wildcard_like:high"),
    (52, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, ""),
    (53, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, "leading_wildcard_like:high"),
    (54, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ks", "easy", 10, "leading_wildcard_like:high"),
    (55, 1, "UNION", 1, "admins,users", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 1, "UNION", "l", "medium", 40, "limit_without_order_by:high"),
    (56, 1, "SELECT", 1, "users", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ls", "easy", 10, ""),
    (57, 1, "SELECT", 1, "orders,users", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ls", "medium", 40, ""),
    (58, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 0, "", 0, 1, 0, 0, 0, "", 0, "", "los", "easy", 10, ""),
    (59, 1, "SELECT", 1, "users", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ls", "easy", 10, "limit_without_order_by:high"),
    (60, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "wdgs", "medium", 41, "redundant_distinct:medium"),
    (61, 1, "SELECT", 1, "users", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ds", "easy", 10, ""),
    (62, 1, "SELECT", 1, "users", 2, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "dgs", "medium", 41, ""),
    (63, 1, "SELECT", 1, "users", 3, 0, "", 1, 1, 0, "", 0, 0, 0, 0, 0, "", 0, "", "dgs", "hard", 71, "redundant_distinct:medium"),
    (64, 1, "SELECT", 1, "orders,users", 5, 0, "", 1, 1, 1, "MAX", 1, 0, 0, 0, 0, "", 0, "", "s", "hard", 72, "correlated_subquery:medium"),
    (65, 1, "SELECT", 1, "orders,users", 3, 0, "", 1, 1, 1, "COUNT", 1, 0, 0, 0, 0, "", 0, "", "ws", "hard", 72, "correlated_subquery:medium"),
    (66, 1, "SELECT", 1, "orders,users", 4, 0, "", 1, 1, 0, "", 1, 0, 0, 0, 0, "", 0, "", "is", "hard", 71, ""),
    (67, 1, "SELECT", 1, "users", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ws", "easy", 10, "select_star:medium"),
    (68, 1, "SELECT", 1, "users", 0, 0, "", 0, 0, 1, "COUNT", 0, 0, 0, 0, 0, "", 0, "", "ws", "medium", 41, ""),
    (69, 1, "SELECT", 1, "users", 1, 0, "", 1, 1, 0, "", 0, 0, 0, 0, 0, "", 0, "", "ws", "hard", 71, "select_star:medium"),
    (70, 1, "SELECT", 1, "orders,users", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 40, "select_in_exists:medium"),
    (71, 1, "SELECT", 1, "orders,users", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ws", "medium", 40, "select_star:medium,select_in_exists:medium"),
    (72, 1, "SELECT", 1, "orders,users", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 40, ""),
    (73, 1, "SELECT", 1, "orders", 4, 0, "", 0, 0, 1, "SUM", 0, 1, 0, 0, 1, "SUM", 0, "", "fs", "hard", 73, ""),
    (74, 1, "SELECT", 1, "orders", 4, 0, "", 0, 0, 1, "LAG", 0, 1, 0, 0, 2, "LAG,RANK", 0, "", "s", "hard", 73, ""),
    (75, 1, "SELECT", 1, "orders", 2, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "bs", "easy", 10, ""),
    (76, 1, "SELECT", 1, "orders", 1, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "cs", "easy", 10, ""),
    (77, 1, "INTERSECT", 1, "orders,users", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 1, "INTERSECT", "", "medium", 40, ""),
    (78, 1, "EXCEPT", 1, "orders,users", 2, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 1, "EXCEPT", "", "medium", 40, ""),
    (79, 1, "SELECT", 1, "orders", 4, 0, "", 0, 0, 0, "", 1, 2, 0, 0, 0, "", 0, "", "bs", "medium", 40, ""),
    (80, 1, "SELECT", 1, "orders,users", 4, 1, "INNER", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "s", "medium", 41, ""),
    (81, 1, "SELECT", 1, "a,b,orders,users", 5, 1, "INNER", 0, 0, 0, "", 0, 0, 2, 0, 0, "", 0, "", "s", "hard", 73, ""),
    (82, 1, "INSERT", 0, "admins", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, ""),
    (83, 1, "CREATE", 0, "extra", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "easy", 10, ""),
    (84, 0, "", 0, "", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "unknown", 0, ""),
    (85, 0, "", 0, "", 0, 0, "", 0, 0, 0, "", 0, 0, 0, 0, 0, "", 0, "", "", "unknown", 0, ""),
    (86, 1, "SELECT", 1, "orders,users", 1, 1, "INNER", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "ws", "medium", 41, "null_comparison_equals:critical,cartesian_product:critical,select_star:medium"),
    (87, 1, "SELECT", 1, "orders,users", 2, 1, "INNER", 0, 0, 1, "COUNT", 1, 0, 0, 0, 0, "", 0, "", "wks", "medium", 42, "cartesian_product:critical,missing_group_by:critical,function_in_where:high,leading_wildcard_like:high"),
    (88, 1, "SELECT", 1, "users", 1, 0, "", 0, 0, 0, "", 1, 0, 0, 0, 0, "", 0, "", "wlos", "easy", 10, "null_comparison_equals:critical,limit_without_order_by:high,offset_without_order_by:high,select_star:medium"),
]
_COLUMNS = (
    "tpl, parseable, statement_type, is_read_only, tables, column_count, join_count, join_types, subquery_count, max_subquery_depth, aggregate_count, aggregate_types, where_condition_count, order_by_columns, "
    "cte_count, recursive, window_fn_count, window_fn_types, set_op_count, set_op_types, flags, difficulty_level, complexity_score, patterns"
)
#: Why the statements that can't be parsed can't.
ERRORS = {16: "expected a name at FROM WHERE", 84: "expected a name at the end", 85: "expected a name at FROM users"}
#: The tables of each database of the corpus, for statements that are tried.
DDL = "CREATE TABLE users (id INTEGER, name TEXT); CREATE TABLE orders (id INTEGER, user_id INTEGER, total REAL); CREATE TABLE singer (country TEXT); CREATE TABLE admins (id INTEGER);"
#: Statements that fail on these tables, besides those that can't be parsed: missing tables, a misused aggregate, and what is no query.
FAIL = (5, 15, 17, 22, 23, 24, 25, 26, 41, 82, 83)
_COST = {"critical": 30, "high": 15, "medium": 5}
FLAGS = {
    "w": "uses_wildcard", "d": "has_distinct", "g": "has_group_by", "h": "has_having", "l": "has_limit", "o": "has_offset", "k": "has_like", "i": "has_in", "b": "has_between", "c": "has_case", "f": "has_window_frame", "s": "is_select",
}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, db_id, question, sql): an item for every order."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    texts = F.array(*[F.lit(t) for t in TEMPLATES])
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("db_"), (F.col("o_custkey") % 7).cast("string")).alias("db_id"),
        F.concat(F.lit("Question "), F.col("o_orderkey").cast("string")).alias("question"),
        F.element_at(texts, (F.col("o_orderkey") % len(TEMPLATES)).cast("int") + 1).alias("sql"),
        (F.col("o_orderkey") % len(TEMPLATES)).cast("int").alias("tpl"),
    )


def _literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def gold_sql() -> str:
    """WITH prefix: gold (by template), items (an item for every order) and m (items with their gold metrics)."""

    def score(row: tuple) -> int:
        return max(0, 100 - sum(_COST[p.split(":")[1]] for p in row[-1].split(",") if p)) if row[1] else 0

    rows = ",\n  ".join(f"({', '.join(_literal(v) for v in row)}, {score(row)}, {_literal('Unparsable error: ' + ERRORS[row[0]]) if row[0] in ERRORS else 'NULL'})" for row in GOLD)
    lists = ", ".join(f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ',') END AS {c}" for c in ("tables", "join_types", "aggregate_types", "window_fn_types", "set_op_types", "patterns"))
    flags = ", ".join(f"contains(flags, '{k}') AS {c}" for k, c in FLAGS.items())
    return f"""WITH gold({_COLUMNS}, quality_score, err) AS (VALUES
  {rows}),
items AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'db_' || CAST(o_custkey % 7 AS VARCHAR) AS db_id, CAST(o_orderkey % {len(TEMPLATES)} AS INTEGER) AS tpl FROM orders),
m AS (SELECT id, db_id, items.tpl, parseable = 1 AS parseable, statement_type, is_read_only = 1 AS is_read_only, column_count, join_count, subquery_count, max_subquery_depth, aggregate_count, where_condition_count, order_by_columns, cte_count,
  recursive = 1 AS has_recursive_cte, window_fn_count, set_op_count, {lists}, {flags}, order_by_columns > 0 AS has_order_by, where_condition_count > 0 AS has_where, difficulty_level, complexity_score, quality_score, err FROM items JOIN gold ON items.tpl = gold.tpl)
"""
