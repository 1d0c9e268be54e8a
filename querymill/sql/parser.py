"""A recursive-descent parser for the statements that audits look at, SQLite first, PostgreSQL second."""

from __future__ import annotations

from querymill.sql.lexer import SqlError, Token, tokenize
from querymill.sql.tree import Node

#: Function name → class label, for functions that aggregate rows.
AGGREGATES = {
    "COUNT": "COUNT", "SUM": "SUM", "TOTAL": "SUM", "AVG": "AVG", "MIN": "MIN", "MAX": "MAX", "GROUP_CONCAT": "GROUPCONCAT", "STRING_AGG": "GROUPCONCAT", "ARRAY_AGG": "ARRAYAGG", "STDDEV": "STDDEV", "STDDEV_POP": "STDDEVPOP", "STDDEV_SAMP": "STDDEVSAMP",
    "VARIANCE": "VARIANCE", "VAR_SAMP": "VARIANCE", "VAR_POP": "VARIANCEPOP", "MEDIAN": "MEDIAN", "PERCENTILE_CONT": "PERCENTILECONT", "PERCENTILE_DISC": "PERCENTILEDISC", "FIRST_VALUE": "FIRSTVALUE", "LAST_VALUE": "LASTVALUE", "NTH_VALUE": "NTHVALUE", "LAG": "LAG", "LEAD": "LEAD",
    "BOOL_AND": "LOGICALAND", "BOOL_OR": "LOGICALOR", "JSON_AGG": "JSONARRAYAGG", "CORR": "CORR", "COVAR_POP": "COVARPOP", "COVAR_SAMP": "COVARSAMP", "ANY_VALUE": "ANYVALUE",
}
#: Words that can't be an alias or a name without quotes.
RESERVED = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS AND OR NOT IN IS LIKE BETWEEN EXISTS CASE WHEN THEN ELSE DISTINCT SET VALUES INTO WITH RETURNING WINDOW OFFSET FETCH CREATE DROP ALTER INSERT UPDATE DELETE COLLATE".split()
)
NOT_ALIAS = RESERVED | frozenset("OUTER ILIKE GLOB REGEXP MATCH ESCAPE ISNULL NOTNULL END ASC DESC NULLS OVER FILTER FOR ALL".split())
_COMPARE = {"=", "==", "<>", "!=", "<", "<=", ">", ">=", "<=>"}
_LIKES = {"LIKE", "ILIKE", "GLOB", "REGEXP", "MATCH", "RLIKE", "SIMILAR"}
_LEVELS = ["| & << >> ^ ~ ~* !~ !~* ~~ ~~* !~~ !~~*", "+ -", "* / %", "|| -> ->>"]
#: How tightly each operator binds.
_LEVEL = {op: i for i, ops in enumerate(_LEVELS) for op in ops.split()}
_COMMANDS = {"PRAGMA", "VACUUM", "ATTACH", "DETACH", "ANALYZE", "REINDEX", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "SHOW", "SET", "GRANT", "REVOKE", "COPY", "EXPLAIN", "DESCRIBE", "USE", "CALL", "COMMENT"}


class Parser:
    def __init__(self, sql: str) -> None:
        self.tokens = tokenize(sql)
        self.at = 0
        self.depth = 0

    # tokens -------------------------------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.tokens[self.at]
        if token.kind == "end":
            raise SqlError("unexpected end")
        self.at += 1
        return token

    def fail(self, wanted: str) -> SqlError:
        return SqlError(f"expected {wanted} at {' '.join(t.text for t in self.tokens[self.at : self.at + 4]).strip() or 'the end'}")

    def is_(self, *uppers: str) -> bool:
        return self.tokens[self.at].upper in uppers

    def take(self, *uppers: str) -> str:
        """The upper-cased token if it is one of uppers, else ""."""
        upper = self.tokens[self.at].upper
        if upper and upper in uppers:
            self.at += 1
            return upper
        return ""

    def words(self, *uppers: str) -> bool:
        """Takes all of a sequence of words or none."""
        if all(self.ahead(i).upper == u for i, u in enumerate(uppers)):
            self.at += len(uppers)
            return True
        return False

    def need(self, upper: str) -> None:
        if not self.take(upper):
            raise self.fail(upper)

    def made(self, node: Node, start: int) -> Node:
        node.span = (self.tokens, start, self.at)
        return node

    def name(self, reserved: frozenset[str] = RESERVED) -> str:
        t = self.now
        if t.kind == "name" or t.kind == "word" and t.upper not in reserved:
            self.at += 1
            return t.text
        raise self.fail("a name")

    def listed(self, item, closing: str | None = None) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # statements ---------------------------------------------------------------------------------
    def statements(self) -> list[Node]:
        out = []
        while self.now.kind != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end" and not self.is_(";"):
                raise self.fail("the end of the statement")
        return out

    def statement(self) -> Node:
        start = self.at
        with_ = self.with_clause() if self.is_("WITH") else None
        word = self.now.upper
        if word in ("SELECT", "(", "VALUES"):
            node = self.query()
        elif word in ("INSERT", "REPLACE") and self.ahead().upper in ("INTO", "OR", "OVERWRITE"):
            node = self.insert()
        elif word == "UPDATE":
            node = self.update()
        elif word == "DELETE":
            node = self.delete()
        elif word == "MERGE":
            node = self.rest("Merge")
        elif word == "CREATE":
            node = self.create()
        elif word == "DROP":
            node = self.drop()
        elif word == "ALTER":
            node = self.rest("Alter")
        elif word == "TRUNCATE":
            node = self.rest("TruncateTable")
        elif word in _COMMANDS and not with_:
            node = self.rest("Command")
        else:
            raise self.fail("a statement")
        if with_:
            node.parts = {"with": with_, **node.parts}
        return self.made(node, start)

    def rest(self, kind: str) -> Node:
        """A statement of which only the kind and the table matter."""
        head = self.next()
        tables = []
        while self.now.kind != "end" and not self.is_(";"):
            token = self.next()
            if kind != "Command" and token.upper in ("TABLE", "INTO") and (self.now.kind in ("word", "name")) and not tables:
                self.words("IF", "EXISTS")
                tables.append(self.table_name())
        if kind != "Command" and self.tokens[self.at - 1] is head:
            raise self.fail("more of the statement")
        return Node(kind, head.upper, tables=tables)

    def table_name(self) -> Node:
        start = self.at
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name(frozenset()))
        return self.made(Node("Table", parts[-1]), start)

    def insert(self) -> Node:
        self.next()
        if self.take("OR"):
            self.next()
        self.need("INTO")
        table = self.table_name()
        if self.take("AS"):
            self.name()
        if self.is_("(") and self.ahead().upper not in ("SELECT", "WITH"):
            self.next()
            self.listed(self.name)
            self.need(")")
        if self.words("DEFAULT", "VALUES"):
            query = None
        else:
            inner_with = self.with_clause() if self.is_("WITH") else None
            query = self.query()
            if inner_with:
                query.parts = {"with": inner_with, **query.parts}
        if self.words("ON", "CONFLICT"):
            while self.now.kind != "end" and not self.is_(";", "RETURNING"):
                self.next()
        return Node("Insert", "INSERT", table=table, query=query, returning=self.returning())

    def returning(self) -> list[Node] | None:
        return self.listed(self.select_item) if self.take("RETURNING") else None

    def update(self) -> Node:
        self.next()
        if self.take("OR"):
            self.next()
        table = self.from_item()
        self.need("SET")
        sets = self.listed(self.assignment)
        source = self.from_clause() if self.is_("FROM") else (None, [])
        return Node("Update", "UPDATE", table=table, sets=sets, source=source[0], joins=source[1], where=self.where(), returning=self.returning(), order=self.order(), limit=self.limit())

    def assignment(self) -> Node:
        start = self.at
        if self.take("("):
            target = Node("Tuple", items=self.listed(self.column))
            self.need(")")
        else:
            target = self.column()
        self.need("=")
        return self.made(Node("Assign", "=", left=target, right=self.expression()), start)

    def delete(self) -> Node:
        self.next()
        self.need("FROM")
        table = self.from_item()
        using = self.listed(self.from_item) if self.take("USING") else None
        return Node("Delete", "DELETE", table=table, using=using, where=self.where(), returning=self.returning(), order=self.order(), limit=self.limit())

    def create(self) -> Node:
        self.next()
        while self.take("OR", "REPLACE", "TEMP", "TEMPORARY", "UNIQUE", "VIRTUAL", "EXTERNAL", "MATERIALIZED", "UNLOGGED"):
            pass
        what = self.take("TABLE", "VIEW", "INDEX", "TRIGGER", "SCHEMA", "DATABASE", "FUNCTION", "SEQUENCE", "TYPE", "EXTENSION", "USER", "ROLE")
        if not what:
            raise self.fail("what to create")
        self.words("IF", "NOT", "EXISTS")
        table = self.table_name() if self.now.kind in ("word", "name") else None
        node = Node("Create", what, table=table)
        if what in ("TABLE", "VIEW"):
            if self.is_("(") and self.ahead().upper not in ("SELECT", "WITH"):
                self.next()
                members = self.listed(self.table_member)
                self.need(")")
                node.parts["members"] = members
            if self.take("AS"):
                with_ = self.with_clause() if self.is_("WITH") else None
                query = self.query()
                if with_:
                    query.parts = {"with": with_, **query.parts}
                node.parts["query"] = query
            elif "members" not in node.parts:
                raise self.fail("columns")
        while self.now.kind != "end" and not self.is_(";"):
            self.next()
        return node

    def table_member(self) -> Node:
        """A column definition or a constraint of CREATE TABLE."""
        start = self.at
        if self.take("CONSTRAINT"):
            self.name()
        if self.is_("PRIMARY", "FOREIGN", "CHECK", "EXCLUDE") or self.is_("UNIQUE", "KEY", "INDEX") and self.ahead().upper == "(":
            kind = self.next().upper
            node = Node("Constraint", kind)
            if kind in ("PRIMARY", "FOREIGN"):
                self.need("KEY")
            if kind in ("PRIMARY", "FOREIGN", "UNIQUE"):
                node.flags = frozenset()
                node.parts["columns"] = self.name_list()
                if kind == "FOREIGN":
                    self.need("REFERENCES")
                    node.parts["target"] = self.table_name()
                    if self.is_("("):
                        node.parts["target_columns"] = self.name_list()
            self.skip_member()
            return self.made(node, start)
        node = Node("ColumnDef", self.name(frozenset()))
        kind, flags = [], set()
        while self.now.kind in ("word", "name") and not self.is_("NOT", "NULL", "PRIMARY", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "COLLATE", "CONSTRAINT", "GENERATED", "AUTOINCREMENT", "AS", "COMMENT"):
            kind.append(self.next().text)
        if kind and self.is_("("):
            begin = self.at
            self.parenthesised()
            kind[-1] += "".join(t.text for t in self.tokens[begin : self.at])
        if self.words("[", "]"):
            kind.append("[]")
        node.parts["type"] = Node("DataType", " ".join(kind))
        while self.now.kind != "end" and not self.is_(",", ")"):
            if self.words("NOT", "NULL"):
                flags.add("not_null")
            elif self.words("PRIMARY", "KEY"):
                flags.add("primary")
            elif self.take("UNIQUE"):
                flags.add("unique")
            elif self.take("REFERENCES"):
                node.parts["target"] = self.table_name()
                if self.is_("("):
                    node.parts["target_columns"] = self.name_list()
            elif self.is_("("):
                self.parenthesised()
            else:
                self.next()
        node.flags = frozenset(flags)
        return self.made(node, start)

    def name_list(self) -> list[Node]:
        self.need("(")

        def one() -> Node:
            node = Node("Name", self.name(frozenset()))
            while self.now.kind != "end" and not self.is_(",", ")"):
                self.next()
            return node

        out = self.listed(one)
        self.need(")")
        return out

    def parenthesised(self) -> None:
        depth = 0
        while True:
            t = self.next()
            depth += (t.upper == "(") - (t.upper == ")")
            if not depth:
                return

    def skip_member(self) -> None:
        while self.now.kind != "end" and not self.is_(",", ")"):
            if self.is_("("):
                self.parenthesised()
            else:
                self.next()

    def drop(self) -> Node:
        self.next()
        what = self.take("TABLE", "VIEW", "INDEX", "TRIGGER", "SCHEMA", "DATABASE", "COLUMN", "FUNCTION", "SEQUENCE", "TYPE")
        if not what:
            raise self.fail("what to drop")
        self.words("IF", "EXISTS")
        tables = self.listed(self.table_name)
        self.take("CASCADE", "RESTRICT")
        return Node("Drop", what, tables=tables)

    # queries ------------------------------------------------------------------------------------
    def with_clause(self) -> Node:
        start = self.at
        self.need("WITH")
        recursive = bool(self.take("RECURSIVE"))

        def one() -> Node:
            begin = self.at
            name = self.name()
            if self.is_("("):
                self.name_list()
            self.need("AS")
            self.words("NOT", "MATERIALIZED") or self.take("MATERIALIZED")
            self.need("(")
            body = self.statement()
            self.need(")")
            return self.made(Node("CTE", name, query=body), begin)

        node = Node("With", "RECURSIVE" if recursive else "", ctes=self.listed(one))
        return self.made(node, start)

    def query(self) -> Node:
        """A SELECT or a set operation, with its ORDER BY and LIMIT."""
        start = self.at
        node = self.intersect()
        while self.is_("UNION", "EXCEPT", "MINUS"):
            op = self.next().upper
            every = bool(self.take("ALL"))
            self.take("DISTINCT")
            node = self.made(Node("Except" if op != "UNION" else "Union", "ALL" if every else "", left=node, right=self.intersect()), start)
        return self.tail(node, start)

    def intersect(self) -> Node:
        start = self.at
        node = self.arm()
        while self.take("INTERSECT"):
            every = bool(self.take("ALL"))
            self.take("DISTINCT")
            node = self.made(Node("Intersect", "ALL" if every else "", left=node, right=self.arm()), start)
        return node

    def tail(self, node: Node, start: int) -> Node:
        order, limit = self.order(), self.limit()
        for key, part in (("order", order), *(limit or {}).items()):
            if part is not None:
                node.parts[key] = part
        if self.take("FOR"):
            self.need("UPDATE") if self.is_("UPDATE") else self.next()
        return self.made(node, start)

    def arm(self) -> Node:
        start = self.at
        if self.take("("):
            inner = self.with_query()
            self.need(")")
            return self.made(Node("Subquery", "", query=inner), start)
        if self.take("VALUES"):
            return self.made(Node("Values", "", rows=self.listed(self.value_row)), start)
        if self.take("TABLE"):
            return self.made(Node("Select", "", items=[Node("Star", "*")], **{"from": self.table_name()}), start)
        return self.select()

    def value_row(self) -> Node:
        self.need("(")
        row = Node("Tuple", items=self.listed(self.expression))
        self.need(")")
        return row

    def with_query(self) -> Node:
        self.depth += 1
        if self.depth > 60:
            raise SqlError("nested too deeply")
        with_ = self.with_clause() if self.is_("WITH") else None
        node = self.query()
        if with_:
            node.parts = {"with": with_, **node.parts}
        self.depth -= 1
        return node

    def select(self) -> Node:
        start = self.at
        self.need("SELECT")
        distinct = None
        if self.take("DISTINCT"):
            on = None
            if self.take("ON"):
                self.need("(")
                on = self.listed(self.expression)
                self.need(")")
            distinct = Node("Distinct", "", on=on)
        else:
            self.take("ALL")
        node = Node("Select", "", distinct=distinct, items=self.listed(self.select_item))
        if self.is_("FROM"):
            source, joins = self.from_clause()
            node.parts["from"] = source
            if joins:
                node.parts["joins"] = joins
        for key, part in (("where", self.where()), ("group", self.group()), ("having", self.having()), ("windows", self.named_windows())):
            if part is not None:
                node.parts[key] = part
        return self.made(node, start)

    def select_item(self) -> Node:
        start = self.at
        if self.take("*"):
            return self.made(Node("Star", "*"), start)
        node = self.expression()
        if self.take("AS"):
            alias = self.next()
            if alias.kind not in ("word", "name", "string"):
                raise self.fail("an alias")
            return self.made(Node("Alias", alias.text, this=node), start)
        if self.now.kind in ("name", "string") or self.now.kind == "word" and self.now.upper not in NOT_ALIAS:
            return self.made(Node("Alias", self.next().text, this=node), start)
        return node

    def from_clause(self) -> tuple[Node, list[Node]]:
        self.need("FROM")
        source = self.from_item()
        joins: list[Node] = []
        while True:
            start = self.at
            if self.take(","):
                joins.append(self.made(Node("Join", "", this=self.from_item()), start))
                continue
            join = self.join()
            if join is None:
                return source, joins
            joins.append(join)

    def join(self) -> Node | None:
        start = self.at
        method = self.take("NATURAL")
        side = self.take("LEFT", "RIGHT", "FULL")
        kind = self.take("INNER", "CROSS", "OUTER", "SEMI", "ANTI")
        if not self.take("JOIN", "STRAIGHT_JOIN"):
            if method or side or kind:
                raise self.fail("JOIN")
            return None
        this = self.from_item()
        on = using = None
        if self.take("ON"):
            on = self.expression()
        elif self.take("USING"):
            using = self.name_list()
        node = Node("Join", kind, this=this, on=on, using=using)
        node.flags = frozenset(x for x in (method, side) if x)
        return self.made(node, start)

    def from_item(self) -> Node:
        start = self.at
        self.take("LATERAL")
        if self.take("("):
            if self.is_("SELECT", "WITH", "VALUES") or self.is_("(") and self._query_follows():
                inner = self.with_query()
                self.need(")")
                node = Node("Subquery", "", query=inner)
            else:
                inner = self.from_item()
                joins = []
                while True:
                    begin = self.at
                    if self.take(","):
                        joins.append(self.made(Node("Join", "", this=self.from_item()), begin))
                    elif (j := self.join()) is not None:
                        joins.append(j)
                    else:
                        break
                self.need(")")
                node = Node("ParenFrom", "", this=inner, joins=joins)
        else:
            self.take("ONLY")
            node = self.table_name()
            if self.is_("("):
                self.next()
                args = [] if self.is_(")") else self.listed(self.expression)
                self.need(")")
                node = Node("TableFunc", node.value, args=args)
        alias = ""
        if self.take("AS"):
            alias = self.next().text
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.upper not in NOT_ALIAS and not self.is_("INDEXED", "TABLESAMPLE"):
            alias = self.next().text
        if alias and self.is_("("):
            self.name_list()
        if self.words("INDEXED", "BY"):
            self.name()
        elif self.words("NOT", "INDEXED"):
            pass
        node.flags = frozenset([alias]) if alias else frozenset()
        return self.made(node, start)

    def _query_follows(self) -> bool:
        i = 0
        while self.ahead(i).upper == "(":
            i += 1
        return self.ahead(i).upper in ("SELECT", "WITH", "VALUES")

    def where(self) -> Node | None:
        start = self.at
        return self.made(Node("Where", "", this=self.expression()), start) if self.take("WHERE") else None

    def having(self) -> Node | None:
        start = self.at
        return self.made(Node("Having", "", this=self.expression()), start) if self.take("HAVING") else None

    def group(self) -> Node | None:
        start = self.at
        if not self.is_("GROUP"):
            return None
        self.next()
        self.need("BY")
        return self.made(Node("Group", "", items=self.listed(self.expression)), start)

    def named_windows(self) -> list[Node] | None:
        if not self.take("WINDOW"):
            return None

        def one() -> Node:
            name = self.name()
            self.need("AS")
            return Node("NamedWindow", name, over=self.over())

        return self.listed(one)

    def order(self) -> Node | None:
        start = self.at
        if not self.is_("ORDER"):
            return None
        self.next()
        self.need("BY")
        return self.made(Node("Order", "", items=self.listed(self.ordered)), start)

    def ordered(self) -> Node:
        start = self.at
        node = Node("Ordered", "", this=self.expression())
        node.value = self.take("ASC", "DESC")
        if self.take("NULLS") and not self.take("FIRST", "LAST"):
            raise self.fail("FIRST or LAST")
        return self.made(node, start)

    def limit(self) -> dict[str, Node] | None:
        out: dict[str, Node] = {}
        while True:
            start = self.at
            if "limit" not in out and self.take("LIMIT"):
                if self.take("ALL"):
                    continue
                first = self.expression()
                if self.take(","):
                    out["offset"] = self.made(Node("Offset", "", this=first), start)
                    first = self.expression()
                out["limit"] = self.made(Node("Limit", "", this=first), start)
            elif "offset" not in out and self.take("OFFSET"):
                out["offset"] = self.made(Node("Offset", "", this=self.expression()), start)
                self.take("ROW", "ROWS")
            elif "limit" not in out and self.take("FETCH"):
                self.take("FIRST", "NEXT")
                n = Node("Literal", "1") if self.is_("ROW", "ROWS") else self.expression()
                self.take("ROW", "ROWS")
                self.take("ONLY")
                out["limit"] = self.made(Node("Limit", "", this=n), start)
            else:
                return out or None

    # expressions --------------------------------------------------------------------------------
    def expression(self) -> Node:
        start = self.at
        self.depth += 1
        if self.depth > 150:
            raise SqlError("nested too deeply")
        node = self.conjunction()
        while self.take("OR"):
            node = self.made(Node("Or", "OR", left=node, right=self.conjunction()), start)
        self.depth -= 1
        return node

    def conjunction(self) -> Node:
        start = self.at
        node = self.negation()
        while self.take("AND"):
            node = self.made(Node("And", "AND", left=node, right=self.negation()), start)
        return node

    def negation(self) -> Node:
        start = self.at
        if self.take("NOT"):
            return self.made(Node("Not", "NOT", this=self.negation()), start)
        return self.predicate()

    def predicate(self) -> Node:
        start = self.at
        node = self.binary(0)
        while True:
            upper = self.now.upper
            if upper in _COMPARE:
                self.next()
                quantifier = self.take("ANY", "SOME", "ALL") if self.ahead().upper == "(" else ""
                if quantifier:
                    begin = self.at
                    self.next()
                    inner = self.with_query() if self.is_("SELECT", "WITH", "(") else self.expression()
                    self.need(")")
                    right = self.made(Node("Any", quantifier, this=inner), begin)
                else:
                    right = self.binary(0)
                node = self.made(Node("Compare", {"==": "=", "!=": "<>"}.get(upper, upper), left=node, right=right), start)
            elif upper == "IS":
                self.next()
                negated = bool(self.take("NOT"))
                if self.words("DISTINCT", "FROM"):
                    right = self.binary(0)
                else:
                    right = self.binary(0)
                node = self.made(Node("Is", "IS", left=node, right=right), start)
                if negated:
                    node = self.made(Node("Not", "NOT", this=node), start)
            elif upper in ("ISNULL", "NOTNULL"):
                self.next()
                node = self.made(Node("Is", "IS", left=node, right=Node("Null", "NULL")), start)
            elif upper == "NOT" and self.ahead().upper in (_LIKES | {"IN", "BETWEEN", "NULL"}):
                self.next()
                if self.take("NULL"):
                    node = self.made(Node("Is", "IS", left=node, right=Node("Null", "NULL")), start)
                else:
                    node = self.made(Node("Not", "NOT", this=self.test(node, start)), start)
            elif upper in _LIKES or upper in ("IN", "BETWEEN"):
                node = self.test(node, start)
            else:
                return node

    def test(self, node: Node, start: int) -> Node:
        upper = self.next().upper
        if upper == "IN":
            if self.now.kind in ("word", "name") and not self.is_("("):
                return self.made(Node("In", "IN", this=node, query=self.table_name()), start)
            self.need("(")
            if self.is_("SELECT", "WITH", "VALUES") or self.is_("(") and self._query_follows():
                begin = self.at - 1
                inner = self.with_query()
                self.need(")")
                return self.made(Node("In", "IN", this=node, query=self.made(Node("Subquery", "", query=inner), begin)), start)
            items = [] if self.is_(")") else self.listed(self.expression)
            self.need(")")
            return self.made(Node("In", "IN", this=node, items=items), start)
        if upper == "BETWEEN":
            self.take("SYMMETRIC")
            low = self.binary(0)
            self.need("AND")
            return self.made(Node("Between", "BETWEEN", this=node, low=low, high=self.binary(0)), start)
        if upper == "SIMILAR":
            self.need("TO")
        right = self.binary(0)
        if self.take("ESCAPE"):
            self.binary(0)
        return self.made(Node({"LIKE": "Like", "ILIKE": "ILike", "GLOB": "Glob"}.get(upper, "RegexpLike"), upper, this=node, pattern=right), start)

    def binary(self, level: int) -> Node:
        """Operators of at least this level, by precedence climbing; those of one level group from the left."""
        start = self.at
        node = self.unary()
        while (now := self.tokens[self.at]).kind == "op" and _LEVEL.get(now.upper, -1) >= level:
            self.at += 1
            node = self.made(Node("Arith", now.upper, left=node, right=self.binary(_LEVEL[now.upper] + 1)), start)
        return node

    def unary(self) -> Node:
        start = self.at
        if self.now.kind == "op" and self.take("-", "+", "~"):
            return self.made(Node("Sign", "-", this=self.unary()), start)
        node = self.primary()
        while True:
            if self.take("::"):
                node = self.made(Node("Func", "CAST", args=[node], type=self.type_name()), start)
            elif self.take("COLLATE"):
                self.name()
                node = self.made(Node("Collate", "", this=node), start)
            elif self.is_("["):
                self.next()
                node = self.made(Node("Index", "", this=node, at=self.expression()), start)
                self.need("]")
            elif self.words("AT", "TIME", "ZONE"):
                node = self.made(Node("Func", "ATTIMEZONE", args=[node, self.unary()]), start)
            else:
                return node

    def type_name(self) -> Node:
        words = [self.next().text]
        while self.now.kind == "word" and self.is_("PRECISION", "VARYING", "UNSIGNED", "WITH", "WITHOUT", "TIME", "ZONE"):
            words.append(self.next().text)
        if self.is_("("):
            self.parenthesised()
        if self.words("[", "]"):
            words.append("[]")
        return Node("DataType", " ".join(words))

    def primary(self) -> Node:
        start = self.at
        t = self.now
        if t.kind in ("number", "string"):
            self.next()
            return self.made(Node("Literal", t.text), start) if t.kind == "number" else self._string(start, t)
        if t.kind == "param":
            self.next()
            return self.made(Node("Param", t.text), start)
        if self.take("("):
            if self.is_("SELECT", "WITH", "VALUES") or self.is_("(") and self._query_follows():
                inner = self.with_query()
                self.need(")")
                return self.made(Node("Subquery", "", query=inner), start)
            items = self.listed(self.expression)
            self.need(")")
            return self.made(Node("Paren", "", this=items[0]) if len(items) == 1 else Node("Tuple", "", items=items), start)
        if t.kind == "word":
            upper = t.upper
            if upper == "NULL":
                self.next()
                return self.made(Node("Null", "NULL"), start)
            if upper in ("TRUE", "FALSE") and self.ahead().upper not in (".", "("):
                self.next()
                return self.made(Node("Boolean", upper), start)
            if upper == "CASE":
                return self.case()
            if upper == "EXISTS":
                self.next()
                self.need("(")
                inner = self.with_query()
                self.need(")")
                return self.made(Node("Exists", "EXISTS", this=inner), start)
            if upper in ("CAST", "TRY_CAST") and self.ahead().upper == "(":
                self.next()
                self.next()
                arg = self.expression()
                self.need("AS")
                kind = self.type_name()
                self.need(")")
                return self.made(Node("Func", "CAST", args=[arg], type=kind), start)
            if upper == "INTERVAL" and self.ahead().kind in ("string", "number"):
                self.next()
                self.next()
                if self.now.kind == "word" and self.now.upper in ("DAY", "DAYS", "MONTH", "MONTHS", "YEAR", "YEARS", "HOUR", "HOURS", "MINUTE", "MINUTES", "SECOND", "SECONDS", "WEEK", "WEEKS"):
                    self.next()
                return self.made(Node("Interval", ""), start)
            if upper in ("DATE", "TIMESTAMP", "TIME") and self.ahead().kind == "string":
                self.next()
                self.next()
                return self.made(Node("Func", "CAST", args=[Node("Literal", "")]), start)
            if upper == "ARRAY" and self.ahead().upper == "[":
                self.next()
                self.next()
                items = [] if self.is_("]") else self.listed(self.expression)
                self.need("]")
                return self.made(Node("Func", "ARRAY", args=items), start)
            if upper in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP") and self.ahead().upper != "(":
                self.next()
                return self.made(Node("Func", upper.replace("_", "")), start)
            if self.ahead().upper == "(" and (upper not in RESERVED or upper in ("LEFT", "RIGHT", "VALUES")):
                return self.call()
        return self.column()

    def _string(self, start: int, t: Token) -> Node:
        node = self.made(Node("Literal", t.text), start)
        node.flags = frozenset(["string"])
        return node

    def column(self) -> Node:
        start = self.at
        parts = [self.name()]
        while self.is_(".") and self.ahead().kind in ("word", "name", "op"):
            self.next()
            if self.take("*"):
                return self._starred(parts[-1], start)
            parts.append(self.name(frozenset()))
        if self.is_("."):
            raise self.fail("a name after the dot")
        if self.is_("(") and len(parts) > 1:
            return self.call(start, parts[-1])
        node = self.made(Node("Column", parts[-1]), start)
        node.flags = frozenset([parts[-2]]) if len(parts) > 1 else frozenset()
        return node

    def _starred(self, table: str, start: int) -> Node:
        node = self.made(Node("Column", "*", star=Node("Star", "*")), start)
        node.flags = frozenset([table])
        return node

    def case(self) -> Node:
        start = self.at
        self.need("CASE")
        this = None if self.is_("WHEN") else self.expression()
        branches = []
        while self.take("WHEN"):
            condition = self.expression()
            self.need("THEN")
            branches += [condition, self.expression()]
        if not branches:
            raise self.fail("WHEN")
        other = self.expression() if self.take("ELSE") else None
        self.need("END")
        return self.made(Node("Case", "CASE", this=this, branches=branches, other=other), start)

    def call(self, start: int | None = None, name: str | None = None) -> Node:
        if start is None:
            start, name = self.at, self.next().text
        upper = name.upper()
        self.need("(")
        args: list[Node] = []
        distinct = None
        if self.take("*"):
            args = [Node("Star", "*")]
        elif not self.is_(")"):
            if self.take("DISTINCT"):
                distinct = Node("Distinct", "", items=self.listed(self.expression))
            elif self.is_("SELECT", "WITH") or self.is_("(") and self._query_follows() and upper in ("ANY", "ALL", "SOME", "ARRAY"):
                args = [self.with_query()]
            else:
                self.take("ALL")
                args = self.listed(self.argument)
        order = self.order()
        if self.take("SEPARATOR"):
            self.next()
        self.need(")")
        if upper in ("ANY", "ALL", "SOME") and args:
            return self.made(Node("Any", upper, this=args[0]), start)
        label = AGGREGATES.get(upper)
        node = Node("Agg" if label else "Func", label or upper.replace("_", ""), distinct=distinct, args=args, order=order)
        self.made(node, start)
        if self.words("WITHIN", "GROUP"):
            self.need("(")
            node.parts["within"] = self.order()
            self.need(")")
        if self.is_("FILTER") and self.ahead().upper == "(":
            self.next()
            self.next()
            where = self.where()
            self.need(")")
            node = self.made(Node("Filter", "", this=node, where=where), start)
        if self.take("IGNORE", "RESPECT"):
            self.need("NULLS")
        if self.take("OVER"):
            window = self.over() if self.is_("(") else {"named": Node("Name", self.name())}
            node = self.made(Node("Window", "", this=node, **(window if isinstance(window, dict) else {"over": window})), start)
        return node

    def argument(self) -> Node:
        node = self.expression()
        if self.take("AS"):
            self.type_name()
        elif self.take("FROM"):  # EXTRACT(part FROM x), TRIM(x FROM y)
            node = Node("Tuple", "", items=[self.expression()])
        elif self.take("FOR"):
            node = Node("Tuple", "", items=[node, self.expression()])
        return node

    def over(self) -> Node:
        start = self.at
        self.need("(")
        if self.now.kind == "word" and not self.is_("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS", ")"):
            self.name()
        partition = None
        if self.words("PARTITION", "BY"):
            partition = self.listed(self.expression)
        order = self.order()
        frame = None
        if self.take("ROWS", "RANGE", "GROUPS"):
            frame = Node("WindowSpec", "")
            while not self.is_(")"):
                self.next()
        self.need(")")
        return self.made(Node("Over", "", partition=partition, order=order, frame=frame), start)


def parse(sql: str) -> list[Node]:
    """The statements of sql. Raises SqlError where it can't be parsed."""
    out = Parser(sql).statements()
    if not out:
        raise SqlError("no statement")
    return [n.link() for n in out]


def parse_one(sql: str) -> Node:
    """The first statement of sql; all of them must be sound."""
    return parse(sql)[0]
