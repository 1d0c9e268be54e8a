"""Tokens of SQL text in the SQLite and PostgreSQL dialects."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """SQL text that can't be parsed."""


#: Words whose letter case says nothing.
_KEYWORDS = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER BY LIMIT UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS AND OR NOT IN IS NULL LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END DISTINCT ASC DESC OVER PARTITION".split()
)


class Token(NamedTuple):
    kind: str  # word, name (quoted), string, number, op, param, end
    text: str  # words as written; names and strings without quotes
    upper: str  # upper-cased text of words and operators, else ""


_TOKEN = re.compile(
    r"""[\s﻿]*(?:(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>[xXeEbBnN]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[A-Za-z_][^\]\[]*\])
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$])|(?P<word>[^\W\d][\w$]*)|(?P<param>\?\d*|[:@$]\w+|%s)
    |(?P<op><=>|->>|->|<>|<=|>=|!=|==|\|\||::|<<|>>|!~~?\*?|~~?\*?|[-+*/%=<>&|^(),.;:\[\]{}])|(?P<end>\Z))""",
    re.X | re.S,
)


_BLANK = re.compile("[\\s\ufeff]*")


def tokenize(sql: str) -> list[Token]:
    """The tokens of sql, closed by one of kind end. Raises SqlError at text that is none."""
    out, at = [], 0
    match = _TOKEN.match
    while True:
        m = match(sql, at)
        if not m:
            at = _BLANK.match(sql, at).end()
            raise SqlError(f"unexpected {sql[at : at + 20]!r} at {at}")
        kind = m.lastgroup
        text, at = m.group(kind), m.end()
        if kind == "word":
            upper = text.upper()
            # keywords have one spelling, so that a node's text doesn't depend on their case
            out.append(Token("word", upper if upper in _KEYWORDS else text, upper))
        elif kind == "name":
            out.append(Token("name", text[1:-1].replace(text[-1] * 2, text[-1]), ""))
        elif kind == "string":
            out.append(Token("string", text[text.index("'") + 1 : -1].replace("''", "'"), ""))
        elif kind == "end":
            out.append(Token("end", "", ""))
            return out
        elif kind != "comment":
            out.append(Token(kind, text, text))
