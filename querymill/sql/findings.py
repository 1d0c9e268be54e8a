"""Antipatterns of a statement: rules over its levels, one level for each SELECT, and over its other nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

from querymill.sql.tree import Node

#: The default severities of the patterns.
SEVERITIES = {
    "critical": ["unsafe_update_delete", "null_comparison_equals", "cartesian_product", "missing_group_by"],
    "high": ["function_in_where", "not_in_nullable", "leading_wildcard_like", "limit_without_order_by", "offset_without_order_by"],
    "medium": ["redundant_distinct", "correlated_subquery", "select_star", "select_in_exists"],
}
#: What each pattern is called in reports.
LABELS = {
    "unsafe_update_delete": "Unsafe UPDATE/DELETE (no WHERE)",
    "unsafe_delete": "Unsafe DELETE (no WHERE)",
    "unsafe_update": "Unsafe UPDATE (no WHERE)",
    "null_comparison_equals": "= NULL comparison",
    "cartesian_product": "Cartesian product",
    "missing_group_by": "Missing GROUP BY",
    "function_in_where": "Function in WHERE",
    "not_in_nullable": "NOT IN with nullable",
    "leading_wildcard_like": "Leading wildcard LIKE",
    "limit_without_order_by": "LIMIT without ORDER BY",
    "offset_without_order_by": "OFFSET without ORDER BY",
    "redundant_distinct": "Redundant DISTINCT",
    "correlated_subquery": "Correlated subquery",
    "select_star": "SELECT *",
    "select_in_exists": "SELECT in EXISTS",
}
#: The switches of the patterns, in the order in which findings are listed.
SWITCHES = tuple(pattern for patterns in SEVERITIES.values() for pattern in patterns)

#: What a finding of each pattern says.
MESSAGES = {
    "unsafe_delete": "every row is removed: there is no condition",
    "unsafe_update": "every row is changed: there is no condition",
    "null_comparison_equals": "nothing equals or differs from NULL; IS NULL asks for it",
    "cartesian_product": "some sources are not related to the others, so all their rows are combined",
    "missing_group_by": "aggregated and single values stand in one list, and not all of the single ones are grouped",
    "function_in_where": "computed from columns for every row, past any index on them",
    "not_in_nullable": "no row passes once the subquery gives a NULL; NOT EXISTS has no such trap",
    "leading_wildcard_like": "a search that may begin anywhere reads every row",
    "limit_without_order_by": "which rows are kept is left to chance",
    "offset_without_order_by": "which rows are passed over is left to chance",
    "redundant_distinct": "groups are distinct already",
    "correlated_subquery": "run again for each row of the query around it",
    "select_star": "the columns are not named",
    "select_in_exists": "values are selected though only their existence counts",
}

#: (pattern, location)
Finding = tuple[str, str]
SETS = ("Union", "Intersect", "Except")
CALLS = ("Func", "Agg", "Case", "Any", "Exists")


def qualifier(column: Node) -> str:
    """The source a column names, in lower case, or ""."""
    return next(iter(column.flags), "").lower()


def windowed(aggregate: Node) -> bool:
    """Whether an aggregate, with or without FILTER, is a window function."""
    around = aggregate.parent
    if around is not None and around.kind == "Filter":
        around = around.parent
    return around is not None and around.kind == "Window"


class Level:
    """A SELECT with what its own clauses, not those of queries inside it, are made of."""

    def __init__(self, select: Node) -> None:
        self.select = select
        self.joins: list[Node] = select["joins"] or []
        self.items = [i["this"] if i.kind == "Alias" else i for i in select["items"]]

    def own(self, part: Node | None, *kinds: str) -> list[Node]:
        return [n for n in part.find(*kinds) if n.scope is self.select] if part else []

    @staticmethod
    def called(source: Node) -> str:
        return (next(iter(source.flags), "") or (source.value if source.kind in ("Table", "TableFunc") else "")).lower()

    @cached_property
    def sources(self) -> list[str]:
        """What the sources are called, in order; those without a name are left out."""
        first = [self.select["from"]] if self.select["from"] else []
        return [name for source in first + [j["this"] for j in self.joins] if (name := self.called(source))]

    # sources as a graph -------------------------------------------------------------------------
    def ties(self) -> Iterator[set[str]]:
        """The edges of the graph of sources: sets of names, one for each condition that relates them."""
        known = set(self.sources)
        for clause in [self.select["where"], *(j["on"] for j in self.joins)]:
            for pair in self.equated(clause):
                if pair <= known and len(pair) == 2:
                    yield pair
                elif clause is not self.select["where"] and len(known) == 2 and len(pair) == 2 and pair & known:
                    yield known  # a column without its source can only be the other one's
        for join in self.joins:
            name = self.called(join["this"])
            if join["using"] or "NATURAL" in join.flags:
                yield {name, *self.sources[:1]}
            mentioned = {qualifier(c) for c in join["on"].find("Column")} & known if join["on"] else set()
            if name in mentioned:
                yield mentioned

    def equated(self, clause: Node | None) -> Iterator[set[str]]:
        """The qualifiers on both sides of each equality of two columns."""
        for n in self.own(clause, "Compare"):
            if n.value == "=" and n["left"].kind == n["right"].kind == "Column":
                yield {qualifier(n["left"]), qualifier(n["right"])}

    def components(self) -> int:
        """How many parts the graph of sources falls into; sources without any tie are a part each."""
        ties = list(self.ties())
        if not ties:
            return len(self.sources)
        parts = [{name} for name in set(self.sources)]
        for tie in ties:
            met = [p for p in parts if p & tie]
            parts = [p for p in parts if not p & tie] + ([set().union(*met)] if met else [])
        return len(parts)

    # grouping -----------------------------------------------------------------------------------
    @cached_property
    def keys(self) -> list[Node]:
        """What is grouped by; ordinals and aliases stand for the items they name."""
        named = {i.value: i["this"] for i in self.select["items"] if i.kind == "Alias"}
        out = []
        for key in self.select["group"]["items"] if self.select["group"] else []:
            if key.kind == "Paren" and key["this"].kind == "Column":
                key = key["this"]
            if key.kind == "Column" and not key.flags:
                key = named.get(key.value, key)
            elif key.kind == "Literal" and "string" not in key.flags and key.value.isdigit() and 0 < int(key.value) <= len(self.items):
                key = self.items[int(key.value) - 1]
            out.append(key)
        return out

    def grouped(self, e: Node) -> bool:
        """Whether an expression is a key: a column by name, and by source where both tell it, anything else by its text."""
        if e.kind != "Column":
            return any(k.kind != "Column" and k.text == e.text for k in self.keys)
        return any(k.kind == "Column" and k.value.lower() == e.value.lower() and (k.flags == e.flags or not (k.flags and e.flags)) for k in self.keys)

    def exposed(self, e: Node) -> Iterator[Node]:
        """Columns of this level in an expression that no aggregate folds and no key covers."""
        if e.kind in ("Select", "Subquery") or e.kind == "Agg" and not windowed(e):
            return
        if e.kind == "Column" and e.scope is self.select and not self.grouped(e):
            yield e
        for part in e.children():
            yield from self.exposed(part)

    @cached_property
    def aggregates(self) -> bool:
        parts = [*self.select["items"], self.select["having"], self.select["order"]]
        return any(not windowed(a) for p in parts for a in self.own(p, "Agg"))


def levels(s) -> list[Level]:
    return [Level(n) for n in s.all("Select")]


class Burden:
    """What an index on this level's columns would not help with, collected from the leaves of a clause up."""

    def __init__(self, clause: Node) -> None:
        self.level, self.having = clause.scope, clause.kind == "Having"
        self.calls: list[Node] = []
        self.sums: list[Node] = []
        self.visit(clause)

    def visit(self, n: Node) -> bool:
        """Whether a column of the level is below n."""
        if n.kind == "Column":
            return n.scope is self.level
        before = len(self.sums)
        touched = [self.visit(part) for part in n.children() if part.kind != "Select"]
        if not any(touched):
            return False
        if n.kind in CALLS:
            del self.sums[before:]  # arithmetic inside a call is the call's burden
            if n.kind != "Agg" or not self.having:
                self.calls.append(n)
        elif n.kind == "Arith" and n.value in ("+", "-", "*", "/", "%", "||"):
            self.sums.append(n)
        elif n.kind == "Compare":
            self.sums[before:] = [x for x in self.sums[before:] if not self.relates(n, x)]
        return True

    def relates(self, compare: Node, side: Node) -> bool:
        """Whether a side of a comparison is arithmetic over other sources than the bare column on its other side."""
        other = {id(compare["left"]): compare["right"], id(compare["right"]): compare["left"]}.get(id(side))
        if other is None or other.kind != "Column" or not other.flags or other.scope is not self.level:
            return False
        inside = {qualifier(c) for c in side.find("Column") if c.flags}
        return bool(inside) and qualifier(other) not in inside


_RULES: dict[str, Callable] = {}


def _rule(f: Callable) -> Callable:
    """Registers the rule of a switch: a statement → findings."""
    _RULES[f.__name__] = f
    return f


@_rule
def unsafe_update_delete(s) -> Iterator[Finding]:
    for n in s.all("Delete", "Update"):
        if next(n.find("Where"), None) is None:
            yield f"unsafe_{n.kind.lower()}", n["table"].text


@_rule
def null_comparison_equals(s) -> Iterator[Finding]:
    compared = (n for n in s.all("Compare") if n.value != "<=>" and "Null" in (n["left"].kind, n["right"].kind))
    listed = (n for n in s.all("In") if any(x.kind == "Null" for x in n["items"] or []))
    for n in [*compared, *listed][:1]:
        yield "null_comparison_equals", n.text


@_rule
def cartesian_product(s) -> Iterator[Finding]:
    for level in levels(s):
        if level.components() > 1:
            yield "cartesian_product", ", ".join(level.sources)
            return


@_rule
def missing_group_by(s) -> Iterator[Finding]:
    for level in levels(s):
        if not level.aggregates:
            continue
        bare = sorted({c.text for item in level.items if not level.grouped(item) for c in level.exposed(item)})
        if level.select["group"] and bare:
            yield "missing_group_by", ", ".join(bare)
            return
        if not level.select["group"] and (bare or any(i.kind == "Star" for i in level.items)):
            yield "missing_group_by", ", ".join(bare) or "*"


@_rule
def function_in_where(s) -> Iterator[Finding]:
    for clause in (c for c in s.all("Where", "Having") if c.scope is not None):
        burden = Burden(clause)
        for n in (burden.calls + burden.sums)[:1]:
            yield "function_in_where", f"{clause.kind.upper()} {n.text}"
            return


@_rule
def not_in_nullable(s) -> Iterator[Finding]:
    for n in s.all("Not"):
        if any(next(i.find("Subquery"), None) for i in n.find("In")):
            yield "not_in_nullable", "NOT IN"
            return


@_rule
def leading_wildcard_like(s) -> Iterator[Finding]:
    for pattern in (n["pattern"] for n in s.all("Like")):
        if (pattern.value if pattern.kind == "Literal" else pattern.text).strip(" '\"\t\n")[:1] in ("%", "_"):
            yield "leading_wildcard_like", pattern.text
            return


def _unordered(s, part: str, spared: Callable[[Node], bool]) -> Iterator[Node]:
    """Queries, set operations first, with LIMIT or OFFSET (`part`) but no order."""
    return (n for n in s.all(*SETS, "Select") if n[part] and not n["order"] and not spared(n))


def _any_row_will_do(n: Node) -> bool:
    """Inside EXISTS, or of literals only."""
    around = n.above("Exists", "Select")
    return n.kind == "Select" and (around is not None and around.kind == "Exists" or all(i.kind == "Literal" for i in n["items"]))


@_rule
def limit_without_order_by(s) -> Iterator[Finding]:
    for n in _unordered(s, "limit", _any_row_will_do):
        yield "limit_without_order_by", n["limit"].text
        return


@_rule
def offset_without_order_by(s) -> Iterator[Finding]:
    for n in _unordered(s, "offset", lambda _: False):
        yield "offset_without_order_by", n["offset"].text
        return


@_rule
def redundant_distinct(s) -> Iterator[Finding]:
    if any(n["distinct"] and next(n.find("Group"), None) for n in s.all("Select")):
        yield "redundant_distinct", "DISTINCT"


@_rule
def correlated_subquery(s) -> Iterator[Finding]:
    names = {id(x.select): set(x.sources) for x in levels(s)}
    for inner in s.all("Select"):
        used = {qualifier(c) for c in inner["where"].find("Column")} - names[id(inner)] if inner["where"] else set()
        outer = inner.scope
        while outer is not None:
            if used & names[id(outer)]:
                yield "correlated_subquery", ", ".join(sorted(used & names[id(outer)]))
                return
            outer = outer.scope


@_rule
def select_star(s) -> Iterator[Finding]:
    for item in (i for n in s.all("Select") for i in n["items"]):
        if item.kind == "Star" or item.kind == "Column" and item["star"]:
            yield "select_star", item.text
            return


@_rule
def select_in_exists(s) -> Iterator[Finding]:
    for n in s.all("Exists"):
        if n["this"].kind == "Select" and any(i.kind != "Literal" for i in n["this"]["items"]):
            yield "select_in_exists", ", ".join(i.text for i in n["this"]["items"])
            return


def antipatterns(s, severities: dict[str, list[str]] | None = None) -> list[tuple[str, str, str, str]]:
    """(pattern, severity, message, location) of the patterns that severities enables, None for the default."""
    level = {p: severity for severity, patterns in (SEVERITIES if severities is None else severities).items() for p in patterns}
    return [(pattern, level[name], MESSAGES[pattern], location) for name in SWITCHES if name in level for pattern, location in _RULES[name](s)]


def switch_of(pattern: str) -> str:
    """The switch a found pattern belongs to."""
    return "unsafe_update_delete" if pattern in ("unsafe_delete", "unsafe_update") else pattern
