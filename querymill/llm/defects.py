"""Broken prompt and response pairs: what is wrong with a query that should answer a question."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that stand for no value.
PLACEHOLDERS = {
    "null", "none", "nil", "nan", "n a", "na", "undefined", "empty", "blank", "missing", "void", "tbd", "todo", "no value", "no answer",
    "no query", "no sql", "not available", "not applicable", "unknown",
}
#: Words that open a statement.
OPENERS = {
    "select", "with", "insert", "update", "delete", "create", "drop", "alter", "values", "replace", "merge", "explain", "pragma", "truncate",
}
#: Words after which SQL can't stop.
OPEN_WORDS = {
    "select", "distinct", "from", "where", "and", "or", "not", "in", "like", "ilike", "glob", "regexp", "rlike", "between", "is", "on", "join",
    "inner", "left", "right", "full", "outer", "cross", "natural", "as", "by", "group", "order", "having", "limit", "offset", "union",
    "except", "intersect", "with", "recursive", "exists", "case", "when", "then", "else", "set", "into", "values", "using", "over",
    "partition", "escape", "collate", "nulls", "insert", "update", "delete", "create", "drop", "alter", "table", "interval", "any", "some",
    "explain", "merge", "returning",
}
#: Words that are never a name without quotes.
RESERVED = OPEN_WORDS | {"all", "asc", "desc", "end", "null", "true", "false", "first", "last", "only"}
JOINERS = {"join", "inner", "left", "right", "full", "outer", "cross", "natural"}
SETS = {"union", "except", "intersect"}
#: Words that are names where an operand is due.
SOFT = JOINERS - {"join"} | {"first", "last", "only", "any", "some", "interval", "partition", "over", "recursive", "explain", "nulls", "glob", "regexp", "rlike", "ilike", "like", "returning", "offset", "escape", "asc", "desc", "end", "by", "outer"}

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|$))|(?P<string>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|(?P<cut>['\"`])"
    r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$]*(?:\s*\.\s*[^\W\d][\w$]*)*)|(?P<op><>|<=|>=|!=|==|\|\||::|->>?|[-+*/%=<>&|~^!])|(?P<mark>[(),.;\[\]])|(?P<other>.)",
    re.S,
)
_BACKSLASHED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"", re.S)
_FENCE = re.compile(r"(?:```|~~~)[\w+-]*")
_TAG = re.compile(r"</?(?:pre|code|sql|p|div|span|br|b|i|em|strong|answer|query)\b[^<>]*/?>", re.I)
_LABEL = re.compile(r"^\W*(?:[\w']+\W+){0,3}?[\w']+\s*:\s+")
_LEAD = re.compile("^[\\s\ufeff\u200b\u200c\u200d\u2060>#*_\\-`~\"'“”‘’«»(\\[{\\d.)]+")
_SPARQL = re.compile(r"select\s+(?:distinct\s+)?\?\w+", re.I)


_WORD = re.compile(r"[^\W_]+")
_LETTER, _NOT_LATIN = regex.compile(r"\p{L}"), regex.compile(r"[^\P{L}\p{Latin}]")


class Pushdown:
    """Reads SQL token by token and says whether it could stop at its end.

    The stack holds open brackets and CASE words, each with the clause it was opened in, so that an
    inner SELECT has clauses of its own. It is lenient: what it can't name it lets pass, and only an
    end at which every parser would still wait for more counts as cut off.
    """

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.stack: list[tuple[str, str, int, int]] = []
        self.clause, self.run, self.between = "", 0, 0
        self.kind = self.word = ""
        self.first, self.main = "", False

    def read(self, kind: str, text: str) -> None:
        low = text.lower() if kind == "word" else text
        if kind == "word" and self.word == "as":  # an alias, whatever it is called
            self.kind, self.word, self.run = "name", "alias", 2
        elif kind == "word" and self.word != "." and low in RESERVED and not (low in SOFT and self.word in ("where", "and", "or", "=", "<>", "<", ">", "<=", ">=", ",", "select", "on")):
            self._keyword(low)
        elif kind in ("word", "string", "number", "other"):
            self.run = 1 if self.word in (".", "::") or (self.kind == "op") else self.run + 1
            self.kind, self.word = "operand" if kind != "word" else "name", low
        elif text in "([":
            self.stack.append((text, self.clause, self.run, self.between))
            self.clause, self.run, self.between = self.clause if text == "[" else "", 0, 0
            self.kind, self.word = "open", text
        elif text in ")]":
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in "([":
                    _, self.clause, self.run, self.between = self.stack[i]
                    del self.stack[i:]
                    break
            self.run = max(self.run, 1)
            self.kind, self.word = "operand", text
        elif text == ";":
            if not self.stack:
                self.reset()
            else:
                self.kind, self.word = "op", text
        elif text == "*" and self.word in ("select", "distinct", ",", ".", "(", "all"):
            self.kind, self.word, self.run = "operand", text, self.run + 1
        else:
            self.run = 0
            self.kind, self.word = "op", text

    def _keyword(self, low: str) -> None:
        if not self.stack and not self.first:
            self.first = low
        if low == "case":
            self.stack.append(("case", self.clause, self.run, self.between))
            self.between = 0
        elif low == "end" and self.stack and self.stack[-1][0] == "case":
            _, self.clause, self.run, self.between = self.stack.pop()
            self.run, self.kind, self.word = max(self.run, 1), "operand", low
            return
        elif low == "between":
            self.between += 1
        elif low == "and" and self.between:
            self.between -= 1
        elif low in ("select", "insert", "update", "delete", "values", "merge"):
            if not self.stack and (self.first != "with" or low != "with"):
                self.main = True
            self.clause, self.between = low, 0
        elif low in ("from", "where", "having", "group", "order", "limit", "offset", "on", "set", "into", "using"):
            self.clause = low
        elif low in JOINERS:
            self.clause = "from"
        elif low in SETS:
            self.clause = low
        if low in ("asc", "desc", "null", "true", "false", "end", "first", "last", "only", "all"):
            # words that may end a statement; after a set operator ALL waits for more
            self.kind = "open" if low == "all" and self.word in SETS | {"select", "=", "<>", "<", ">"} else "operand"
            self.run = 1
        else:
            self.kind, self.run = "open", 0
        self.word = low

    def complete(self) -> bool:
        if self.stack or self.between or self.kind in ("op", "open"):
            return not self.kind and not self.stack
        if self.first == "with" and not self.main:
            return False
        if self.first == "update" and self.clause == "update" or self.first == "insert" and self.clause in ("insert", "into"):
            return False
        if self.kind == "name" and self.run >= 2 and self.clause in ("where", "having", "on", "group", "order", "limit", "offset"):
            return False  # the beginning of a word that no name can be
        return not (self.kind == "name" and self.run >= 3 and self.clause == "from")


def _stops_early(sql: str) -> bool:
    machine = Pushdown()
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup
        if kind == "cut":
            return True
        if kind != "space" and kind != "comment":
            machine.read(kind, m.group())
    return not machine.complete()


def truncated(sql: str) -> bool:
    """Whether SQL stops before it is complete. Brackets, CASE, quotes and clauses must close; a trail of dots is a cut."""
    text = sql.rstrip()
    stripped = re.sub(r"\s*(?:\.{3,}|…)\s*;?$", "", text)
    if stripped != text:
        return True
    if not _stops_early(text):
        return False
    if "\\" in text:  # a dialect that escapes quotes by a backslash
        return _stops_early(_BACKSLASHED.sub("'x'", text))
    return True


def tiles(a: list[str], b: list[str], shortest: int = 3) -> int:
    """Greedy string tiling: the number of words of a covered by common runs with b, longest runs first."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    covered = 0
    while True:
        best, at = shortest - 1, []
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in where.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k >= shortest:
                    at.append((i, j))
        if not at:
            return covered
        for i, j in at:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best


def _plain(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def copied(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question again, but for case, punctuation and a label in front."""
    q, a = _plain(question), _plain(answer)
    if not q or not a or len(a) > len(q) + 6 or len(q) > 2 * len(a) + 6:
        return False
    if q == a or "".join(q) == "".join(a):
        return True
    front = _LABEL.match(answer)
    if front and _plain(answer[front.end() :]) == q:
        return True
    if len(a) - len(q) > 4 or len(set(q) & set(a)) < 0.8 * len(set(q)):
        return False
    extra = len(a) - tiles(a, q)
    return tiles(q, a) >= 0.98 * len(q) and (extra == 0 or a[extra:] == q)


#: The grammar of refusals, as opening, inability and object.
_CANNOT = r"(?:can(?:no|')?t|can not|could(?: not|n't)|(?:am|'m|is|are) (?:not able|unable|not allowed|not permitted|not in a position)|won't be able|will not be able|won't|will not|would rather not|(?:must|have to|will|need to) (?:decline|refuse|pass)|do(?: not|n't) have (?:enough|access|the|any|sufficient)|not possible|unable to|decline to|refuse to|not comfortable)"
_REFUSAL = [
    re.compile(r"\b(?:i|we|it|this assistant|the assistant)\b.{0,40}?" + _CANNOT, re.S),
    re.compile(r"^(?:i(?:'m| am) )?(?:so |very )?(?:sorry|afraid)\b"),
    re.compile(r"^(?:i |my |our |please accept my )?(?:apologi[sz]e|apologies|regrettably|unfortunately)\b"),
    re.compile(r"^(?:as|being) an? (?:\w+ ){0,3}(?:assistant|model|ai)\b"),
    re.compile(r"\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules|principles)\b"),
    re.compile(r"^(?:request|access|query|question|answer)?\s*(?:declined|denied|refused|rejected|withheld)\b"),
    re.compile(r"\b(?:no|not an?) (?:answer|response|query|statement|sql) (?:can|could|may|will) be (?:given|provided|generated|written|produced)"),
    re.compile(r"\b(?:this|that|it|the (?:question|request))\b.{0,30}?(?:cannot|can't|can not|could not) be (?:answered|done|fulfilled|completed|written|processed|translated)"),
    re.compile(r"^(?:i )?(?:cannot|can't|can not|unable to|not able to|won't|will not) (?:comply|help|answer|assist|do|generate|produce|provide|write|create|fulfil)"),
    re.compile(r"^thanks? (?:you )?for (?:asking|your).{0,30}\bbut\b"),
    re.compile(r"\b(?:must|have to) (?:decline|refuse)\b|\brather not (?:answer|say|do)\b"),
]


_SENTENCE_END = re.compile(r"(?<=[.!?;])\s+")


def refuses(text: str) -> bool:
    """Whether a reply in English declines to answer, in any of its sentences."""
    low = re.sub(r"\s+", " ", text.replace("’", "'").replace("‘", "'").replace("`", "'").lower()).strip(" \t\n-/*#>\"'([{.")
    sentences = _SENTENCE_END.split(low)
    return any(p.search(part) for part in ([low] if len(sentences) == 1 else [*sentences, " ".join(sentences[:2])]) for p in _REFUSAL)


#: Signs of program code other than SQL.
_CODE = [
    re.compile(p, re.M)
    for p in (
        r"%>%|\|>\s*\w+\(|<-\s*\w+|\blibrary\(",
        r"\bdb(?:\.\w+|\[.+?\])+\.(?:find|aggregate|count|distinct)\w*\(",
        r"=>|===|\b(?:const|let|var)\s+\w+\s*=|\bfunction\b.*\{|console\.log",
        r"^\s*(?:for \w+(?:\s*,\s*\w+)* in \S.*|(?:while|if|elif)\b.*[=<>()\[\]].*|def \w+\(.*\).*|class \w+(?:\(.*\))?|with \w[\w.]*\(.*\) as \w+):\s*$",
        r"^\s*(?:from \w[\w.]* )?import \w|\bprint\(|\blambda \w*:",
        r"\w+\[\w*\[?['\"].+?['\"]\]|\bpd\.\w+|\bdf\b\s*[=.\[]",
        r"\b(?:public|private|static|void|System\.out|new \w+\()|\w::\w+",
        r"<\?php|\$\w+\s*(?:=|->)|->\w+\(",
        r"\b(?:puts|fmt\.Print\w*|println!?|printf|func \w*\()|\bdo \|\w+\|",
        r"^\s*(?:awk|grep|sed|cat|curl|jq|cut|sort)\s.+\|?|\$\{\w+\}|^\s*\$\w+\s*=",
        r"\bMATCH\s*\(.*\).*\bRETURN\b",
        r"^=\s*[A-Z]+\(.+\)$",
        r"^\s*\{\s*(?:\w+\s*(?:\(.*?\))?\s*\{|[\"']\w+[\"']\s*:)",
        r"\bfrom \w+ in \w+\b.*\bselect\b",
        r"^\s*\w+\s*=\s*\w[\w.]*\(.*\);?\s*$|\)\s*\{\s*$",
        # of any language: a call of a member, of what a call gave or on a closing bracket
        r"(?<![.\w])[A-Za-z_]\w*(?:\.\w+)*[.]\w+!?\(|[)\]}]\s*\.\s*\w+!?\s*[({]",
    )
]
#: Marks that prose hardly has; of more than DENSE of the characters, if at least MARKS, text is code.
_MARK = re.compile(r"[{}()\[\]=<>|&$@\\;*+]|->|:=|::")
DENSE, MARKS = 0.12, 6

#: The model of English: a sequence of GRAM letters, word edges included, is English if the training text has it
#: at least twice. Text of at least LEAST_WORDS words is foreign if less than ENGLISH of its sequences are English.
GRAM, LEAST_WORDS, ENGLISH = 4, 3, 0.7
_OF_CODE = regex.compile(r"[\d_=<>{}\[\]/\\@#|`]")
_LETTERS = regex.compile(r"\p{L}+")


def _grams(word: str) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + GRAM] for i in range(max(1, len(edged) - GRAM + 1))]


@lru_cache(maxsize=1)
def english() -> frozenset[str]:
    """The model, trained once a worker on the English that comes with Python: the topics of its documentation."""
    from pydoc_data.topics import topics

    seen: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(" ".join(topics.values()).lower())).items():
        for g in _grams(word):
            seen[g] += n
    return frozenset(g for g, n in seen.items() if n >= 2)


def prose(text: str, known: str = "") -> list[str]:
    """The words of a text, without identifiers, numbers, names (capitals within a sentence) and the words of `known`."""
    skipped = set(_LETTERS.findall(known.lower()))
    out: list[str] = []
    first = True
    for token in text.split():
        if not _OF_CODE.search(token):
            for word in _LETTERS.findall(token):
                if word.lower() not in skipped and (first or not word[0].isupper()):
                    out.append(word.lower())
                first = False
        first = token[-1] in ".!?:;"
    return out


def foreign(text: str, question: str = "") -> bool:
    """Whether text is prose in a human language other than English: by its script, else by the model of English.

    Words of the question say nothing: an answer in any language names the tables and values it is about.
    """
    letters = len(_LETTER.findall(text))
    if not letters:
        return False
    if len(_NOT_LATIN.findall(text)) >= 0.3 * letters:
        return True
    words = prose(text, question)
    if len(words) < LEAST_WORDS:
        return False
    grams = [g for w in words for g in _grams(w)]
    return sum(g in english() for g in grams) < ENGLISH * len(grams)


def coded(text: str) -> bool:
    """Whether text, which is no SQL, is program code."""
    if any(p.search(text) for p in _CODE):
        return True
    marks = len(_MARK.findall(text))
    return marks >= MARKS and marks > DENSE * len(re.sub(r"\s", "", text))


def _unwrapped(answer: str) -> tuple[str, str]:
    """(text outside fences, tags and comments, text of the comments)."""
    text = answer.replace("\ufeff", "").replace("\u200b", "").replace("\u200d", "")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "--" not in text and "/*" not in text:
        return text, ""
    out, said, end = [], [], 0
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "cut":  # an apostrophe of prose, or an open quotation: the rest is text
            break
        if m.lastgroup == "comment":
            out.append(text[end : m.start()])
            said.append(m.group())
            end = m.end()
    out.append(text[end:])
    return " ".join(out), " ".join(said)


def defect(question: str | None, answer: str | None) -> str | None:
    """The kind of defect of answer, or None: empty, truncated, refusal, copy or other_language."""
    if question is None:
        return None
    if answer is None:
        return "empty"
    text, comments = _unwrapped(answer)
    words = [m.group() for m, _ in zip(_WORD.finditer(text), range(4))]
    if not words:
        if not _WORD.search(comments):
            return "empty"
        said = re.sub(r"--|/\*|\*/", " ", comments)
        return "copy" if copied(question, said) else "refusal" if refuses(said) else "other_language" if foreign(said, question) else "empty"
    if len(words) <= 3 and " ".join(words).lower() in PLACEHOLDERS:
        return "empty"
    bare = _LEAD.sub("", text)
    opener = re.match(r"[A-Za-z]+", bare)
    label = _LABEL.match(bare)
    if (not opener or opener.group().lower() not in OPENERS) and label:
        inner = re.match(r"\W*([A-Za-z]+)", bare[label.end() :])
        if inner and inner.group(1).lower() in OPENERS and re.search(r"\b(?:from|values|set|table)\b", bare, re.I):
            bare, opener = bare[label.end() :], inner
    if opener and opener.group().lower() in OPENERS and not _SPARQL.match(bare):
        first = _WORD.search(question)
        if not first or first.group().lower() != opener.group().lower() or not copied(question, text):
            if _sql_like(bare):
                start = text.find(bare[:20]) if bare[:20] in text else 0
                sql = ("(" * text[:start].count("(") + bare).rstrip()
                if re.match(r"[\s>#*_]*[*_`\"'“]", text[:start]) and sql[-1:] in "*_`\"'”":
                    sql = sql.rstrip("*_`\"'”")
                return "truncated" if truncated(sql) else None
    if copied(question, text) or comments and copied(question, f"{comments} {text}"):
        return "copy"
    if _is_sql(question):  # the two fields are exchanged
        return None
    if len(words) == 1 and len(words[0]) >= 3 and any(o.startswith(words[0].lower()) for o in ("select", "insert", "update", "delete")):
        return "truncated"
    if refuses(text):
        return "refusal"
    if _SPARQL.match(bare) or coded(text) or foreign(text, question):
        return "other_language"
    return None


def _sql_like(text: str) -> bool:
    """Whether text that begins with a statement's word is SQL rather than an English sentence such as "Select the ..."."""
    head = text.lower()
    if head.startswith("select"):
        rest = head[6:].strip()
        if not rest:
            return True
        if re.match(r"(?:the|all the|every|each|any|those|which|for)\b", rest) and not re.search(r"\bfrom\b", head):
            return False
        return bool(re.search(r"\bfrom\b|[,*(=._]|^\S+$|^\w+ as \w+", rest))
    if head.startswith("with"):
        return bool(re.match(r"with\s+(?:recursive\s+)?[\w\"`\[\]]+\s*(?:\(|as\b|$)", head))
    return bool(re.search(r"\b(?:into|set|from|table|view|index|values|select|database)\b|\(", head))


def _is_sql(text: str) -> bool:
    bare = _LEAD.sub("", _unwrapped(text)[0])
    opener = re.match(r"[A-Za-z]+", bare)
    return bool(opener) and opener.group().lower() in OPENERS and not _SPARQL.match(bare) and _sql_like(bare)


def flag(df: DataFrame, id_column: str = "id", prompt: str = "question", response: str = "query") -> DataFrame:
    """(id, defect): the records whose response is no usable SQL answer to the prompt.

    empty, truncated, refusal, copy or other_language; sound records give no row. A null prompt is no
    case, a null response is empty. Rows that repeat an id count once; a null id is no record; other
    columns are ignored; an empty table gives no rows. Texts are read whole, in one narrow Arrow pass
    without a shuffle of texts: only the flagged (id, defect) are made distinct.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [defect(q, a) for q, a in zip(batch["p"], batch["r"])]
            keep = [k is not None for k in kinds]
            yield pd.DataFrame({"id": batch["id"][keep], "defect": [k for k in kinds if k is not None]})

    kind = df.schema[id_column].dataType.simpleString()
    source = df.where(F.col(id_column).isNotNull() & F.col(prompt).isNotNull()).select(F.col(id_column).alias("id"), F.col(prompt).alias("p"), F.col(response).alias("r"))
    return source.mapInPandas(judge, f"id {kind}, defect string").distinct()
