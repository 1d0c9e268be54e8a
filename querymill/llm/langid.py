"""Languages of documents and of their stretches, by compression with per-language dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a language is written in labels besides its two-letter code.
SPELLINGS = {
    "en": "eng english anglais englisch inglés",
    "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch",
    "es": "spa spanish español espanol castellano castilian spanisch",
    "it": "ita italian italiano italienisch",
    "pt": "por portuguese português portugues portugiesisch",
    "nl": "nld dut dutch nederlands flemish niederländisch",
    "pl": "pol polish polski polnisch",
    "uk": "ukr ukrainian українська ukrainisch",
    "ru": "rus russian русский russisch",
}
LANGUAGES = tuple(SPELLINGS)

#: The training sample: at most about SAMPLE labelled documents a language, none longer than LONGEST
#: characters. Only the dictionaries come from it; every document is classified whole.
SAMPLE, LONGEST = 250, 20_000
#: Bytes of each dictionary, level of compression, and rounds in which the sample's wrong labels are weeded out.
DICTIONARY, LEVEL, ROUNDS = 24_576, 6, 1
#: A sentence is left undecided unless the best language saves this many bytes and this share over the next.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.03
#: Letters below which zstandard can't tell a sentence's language: it counts with the stretch it stands in.
SHORT = 12
#: Bits by which the best language of a document must win if zstandard decides none of its sentences.
MARGIN_BITS = 2.0
#: A language counts if at least this share of the letters of a document's sentences is in it.
SHARE = 0.2

#: Sentences a worker remembers the language of.
REMEMBERED = 200_000

_KEYWORDS = (
    "SELECT|FROM|WHERE|AND|OR|NOT|IN|LIKE|BETWEEN|IS|NULL|ON|JOIN|INNER|LEFT|RIGHT|OUTER|CROSS|AS|BY|GROUP|ORDER|HAVING|LIMIT|OFFSET|UNION|ALL|EXCEPT|"
    "INTERSECT|WITH|EXISTS|CASE|WHEN|THEN|ELSE|END|DISTINCT|COUNT|SUM|AVG|MIN|MAX|ASC|DESC|INSERT|INTO|VALUES|UPDATE|SET|DELETE|CREATE|TABLE|PRIMARY|KEY|FOREIGN|REFERENCES|INTEGER|TEXT|REAL|DATE|VARCHAR"
)
_QUOTED = r"'(?:[^'\n]|'')*'|\"[^\"\n]*\""
#: Where a statement may begin, and how far its tokens reach: literals, operators, keywords, and names
#: that something of SQL follows.
_OPENER = re.compile(r"SELECT|select|Select|WITH|with|With|INSERT|insert|UPDATE|update|DELETE|delete|CREATE|create")
_STATEMENT = re.compile(
    rf"(?:SELECT|WITH\s+\w+\s+AS\b|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE)\b(?:\s+|{_QUOTED}|[-+*/%=<>!|(),.;]+|\b(?:{_KEYWORDS})\b|\b\d[\w.:-]*|\b[A-Za-z]\d?\b(?:\.\w+)?|\b\w+\.\w+\b|\b\w*_\w*\b|\b\w+\b(?=\s*(?:[-+*/%=<>!(),.;|]|$|\n|\b(?:{_KEYWORDS})\b|[A-Za-z]\d?\b)))*",
    re.I,
)
_HAS_CLAUSE = re.compile(r"\b(?:FROM|INTO|SET|TABLE)\b", re.I)
_FENCED = re.compile(r"```[\w+-]*\n.*?(?:```|\Z)|```", re.S)
_TABLE = re.compile(r"\|(?:[^|\n]*\|)+")
#: A short quotation says nothing about the language around it.
_QUOTATION = re.compile(r"[“„«][^“”„«»\n]{1,80}[”“»]|»[^«»\n]{1,80}«|\"[^\"\n]{1,80}\"")
_NOT_BREAK = re.compile(r"[^\n]")
#: Characters that no word of prose has: identifiers, numbers, addresses, markup.
_NO_WORD = re.compile(r"[\d_@#{}<>|\\=`\u200b-\u200f\ufeff\u2060]|://")
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+(?!\s|$)[^.!?…\n]+)*[.!?…]*[\"”»')]*")
_NO_LETTER = re.compile(r"[\W\d_]+")
_LETTERS = regex.compile(r"\p{L}")
_WORDS = re.compile(r"[^\W\d_]+")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")


def label_language(label: Column) -> Column:
    """The two-letter code a label stands for, whatever its spelling; null if it stands for none of LANGUAGES."""
    first = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([\p{L}]+)(?:[-_ .(/].*)?\s*$", 1))
    names = F.create_map(*[F.lit(x) for code, others in SPELLINGS.items() for name in [code, *others.split()] for x in (name, code)])
    return names[F.when(first != "", first)]


def _without_statements(text: str) -> str:
    out, end = [], 0
    for m in _OPENER.finditer(text):
        if m.start() < end or (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            continue
        found = _STATEMENT.match(text, m.start())
        if found and _HAS_CLAUSE.search(found.group()):
            out += [text[end : m.start()], ".", _NOT_BREAK.sub(" ", found.group()[1:])]
            end = found.end()
    return "".join(out) + text[end:] if out else text


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, prose, letters) of each sentence of a text, SQL, tables and identifiers left out.

    Positions are those of the text; letters are those of the sentence's words. Prose is what is
    classified: names belong to no language either, so words with a capital within a sentence are dropped.
    Sentences of fewer than SHORT letters in a row are taken together.
    """
    if "```" in text:
        text = _FENCED.sub(lambda m: _NOT_BREAK.sub(" ", m.group()), text)
    if "|" in text:
        text = _TABLE.sub(lambda m: "." + " " * (len(m.group()) - 1), text)
    text = _without_statements(text)
    text = _QUOTATION.sub(lambda m: " " * len(m.group()), text)
    strange = _NO_WORD.search
    out = []
    short: list[tuple[str, int]] = []  # short sentences in a row, and where they are
    begin = end = 0

    def close() -> None:
        if short:
            out.append((begin, end, " ".join(p for p, _ in short), sum(n for _, n in short)))
            short.clear()

    for m in _SENTENCE.finditer(text):
        words = [w for w in m.group().split() if not strange(w)]
        prose, letters = _prose(words)
        if letters >= SHORT:
            close()
            out.append((m.start(), m.end(), prose, letters))
        elif letters:
            begin, end = begin if short else m.start(), m.end()
            short.append((prose, letters))
    close()
    return out


def _prose(words: list[str]) -> tuple[str, int]:
    """(what is classified of a sentence's words, their letters)."""
    letters = len(_NO_LETTER.sub("", "".join(words)))
    common = words[:1] + [w for w in words[1:] if not w[0].isupper()]
    return " ".join(common) if len(common) * 2 > len(words) else " ".join(words).lower(), letters


class Classifier:
    """Chooses the language whose raw-content dictionary lets zstandard make a text smallest."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by_script: dict[bool, list[tuple[str, object]]] = {False: [], True: []}
        self.plain: dict[str, str] = {}
        self.known: dict[str, tuple[str | None, float]] = {}
        for language, content in sorted(dictionaries.items()):
            if len(content) < 8:
                continue
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
            text = content.decode("utf-8", "ignore")
            self.plain[language] = _plain(text)
            self.by_script[len(_CYRILLIC.findall(text)) * 2 > len(_LETTERS.findall(text))].append((language, compressor.compress))

    def __call__(self, prose: str) -> tuple[str | None, float]:
        """(language, confidence) of a sentence; those of frequent wording are remembered, up to REMEMBERED."""
        if (found := self.known.get(prose)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[prose] = self._classify(prose)
        return found

    def _classify(self, prose: str) -> tuple[str | None, float]:
        """None where the margin is narrow. Only dictionaries of the text's script compete."""
        candidates = self.by_script[len(_CYRILLIC.findall(prose)) * 2 > len(_LETTERS.findall(prose))]
        if not candidates:
            return None, 0.0
        packed = prose.encode("utf-8", "surrogatepass")
        sizes = sorted([(len(compress(packed)), language) for language, compress in candidates])
        best = sizes[0][0]
        confidence = 1.0 / sum(2.0 ** ((best - size) / 2) for size, _ in sizes)
        if len(sizes) > 1 and sizes[1][0] - best < max(MARGIN_BYTES, MARGIN_SHARE * sizes[1][0]):
            return None, confidence
        return sizes[0][1], confidence


    def by_phrases(self, prose: str) -> tuple[str | None, float]:
        """The same decision for text of which zstandard, which counts bytes, saves too few.

        The text is cut into the longest phrases that a dictionary has, each at the bits of how rare it is there.
        """
        text = _plain(prose)
        bits = sorted((_phrase_bits(text, content), language) for language, content in self.plain.items())
        if not text.strip() or not bits:
            return None, 0.0
        confidence = 1.0 / sum(2.0 ** min(bits[0][0] - b, 0.0) for b, _ in bits)
        return (bits[0][1] if len(bits) == 1 or bits[1][0] - bits[0][0] >= MARGIN_BITS else None), confidence


def _plain(text: str) -> str:
    return f" {' '.join(_WORDS.findall(text.lower()))} "


def _phrase_bits(text: str, content: str) -> float:
    at, bits = 0, 0.0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in content:
            end += 1
        bits += math.log2((len(content) + 1) / (content.count(text[at:end]) + 0.1))
        at = end
    return bits


def _dictionaries(pool: dict[str, list[str]]) -> dict[str, bytes]:
    """Of each language, up to DICTIONARY bytes of sentences that cover its word pairs.

    The sentences of the most frequent pairs come first, those whose pairs are mostly covered are passed
    over; in the dictionary the first come last, where zstandard finds them cheapest.
    """
    out = {}
    for language, found in pool.items():
        pairs = Counter(p for s in found for p in _pairs(s))
        order = sorted(set(found), key=lambda s: (-sum(pairs[p] for p in _pairs(s)) / max(1, len(_pairs(s))), hash_of(s), s))
        chosen, covered, size = [], set(), 0
        for s in order:
            own = set(_pairs(s))
            packed = s.encode("utf-8", "surrogatepass") + b" "
            if len(own - covered) * 4 < len(own) or size + len(packed) > DICTIONARY:
                continue
            covered |= own
            chosen.append(packed)
            size += len(packed)
        out[language] = b"".join(reversed(chosen))
    return out


def _pairs(prose: str) -> list[tuple[str, str]]:
    words = prose.lower().split()
    return list(zip(words, words[1:]))


def hash_of(text: str) -> int:
    """A stable hash: the same order of the sample on every driver."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def train(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """Dictionaries from (label, text); labels may be wrong in part and texts may be mixed.

    The sample is halved by text. Each half is classified by the other half's dictionaries, and a
    sentence leaves its pool if it is decided for another language. After ROUNDS of this the pools hold
    what their languages have in common rather than what their labels say.
    """
    items = [(label, s[2], hash_of(text) & 1) for label, text in sample for s in sentences(text) if s[3] >= SHORT]
    # a sentence stays under its label if its words are more at home there than under any other label
    size = Counter(label for label, _, _ in items)
    times: dict[str, Counter] = defaultdict(Counter)
    for label, prose, _ in items:
        for word in set(prose.lower().split()):
            times[word][label] += 1
    home = {}
    for prose in {x[1] for x in items}:
        score: Counter = Counter()
        for word in set(prose.lower().split()):
            rates = {label: n / size[label] for label, n in times[word].items()}
            total = sum(rates.values())
            for label, rate in rates.items():
                score[label] += rate / total
        home[prose] = max(score.items(), key=lambda x: (x[1], x[0]))[0]
    labels = [label if home[prose] == label else None for label, prose, _ in items]
    for _ in range(ROUNDS):
        halves = []
        for half in (0, 1):
            pool = defaultdict(list)
            for (_, prose, h), label in zip(items, labels):
                if h == half and label:
                    pool[label].append(prose)
            halves.append(Classifier(_dictionaries(pool)))
        found = [halves[1 - h](prose)[0] for _, prose, h in items]
        labels = [label if by in (None, label) else None for label, by in zip(labels, found)]
    pool = defaultdict(list)
    for (_, prose, _), label in zip(items, labels):
        if label:
            pool[label].append(prose)
    return _dictionaries(pool)


def fit(df: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> dict[str, bytes]:
    """train() on a sample of about `sample` labelled documents a language, chosen by a hash of their ids."""
    spread = 1 << 20
    known = df.select(F.pmod(F.xxhash64(id_column), F.lit(spread)).alias("h"), label_language(F.col(label)).alias("l"), F.col(text).alias("t")).where("l is not null")
    counts = dict(known.groupBy("l").count().collect())  # reads the labels only
    if not counts:
        return {}
    below = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(spread, spread * sample // n))])
    chosen = known.where((F.col("h") < below[F.col("l")]) & F.length("t").between(1, LONGEST))
    return train([(r["l"], r["t"]) for r in chosen.select("l", "t").collect()])


def save(dictionaries: dict[str, bytes], spark: SparkSession, path: str) -> None:
    """Writes fitted dictionaries, so that later runs need no training pass."""
    spark.createDataFrame(sorted((k, bytearray(v)) for k, v in dictionaries.items()), "lang string, content binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, bytes]:
    """Dictionaries that save() wrote, DICTIONARY bytes a language."""
    return {r["lang"]: bytes(r["content"]) for r in spark.read.parquet(path).collect()}


@lru_cache(maxsize=2)
def _classifier(packed: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(packed))


def segments_of(text: str, classify: Classifier) -> list[tuple[int, int, str | None, float, int]]:
    """(start, end, language, confidence, letters) of the stretches of one language.

    An undecided sentence joins the stretch before it, or the first one after it. If none is decided, all
    of them are one stretch, of the language its phrases tell, if any.
    """
    out: list[list] = []
    found = sentences(text)
    for start, end, prose, letters in found:
        language, confidence = classify(prose) if letters >= SHORT else (None, 0.0)
        if out and (language is None or language == out[-1][2] or out[-1][2] is None):
            last = out[-1]
            last[1], last[2] = end, last[2] or language
            last[3] += confidence * letters
            last[4] += letters
        else:
            out.append([start, end, language, confidence * letters, letters])
    if len(out) == 1 and out[0][2] is None:
        language, confidence = classify.by_phrases(" ".join(x[2] for x in found))
        out[0][2:4] = language, confidence * out[0][4]
    return [(a, b, lang, c / n, n) for a, b, lang, c, n in out if lang is not None]


def _run(df: DataFrame, dictionaries: dict[str, bytes], schema: str, rows) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = _classifier(shared.value)
        for batch in batches:
            found = [(i, *row) for i, text, label in zip(batch["doc_id"], batch["text"], batch["label"]) if text for row in rows(segments_of(text, classify), label)]
            yield pd.DataFrame(found, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return df.mapInPandas(run, schema)


def _labelled(df: DataFrame, id_column: str, text: str, label: str) -> DataFrame:
    return df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), label_language(F.col(label)).alias("label"))


def segments(df: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, start, end, lang, confidence): the stretches of each document in one language, by character positions."""
    dictionaries = fit(df, id_column, text, label) if dictionaries is None else dictionaries
    kind = df.schema[id_column].dataType.simpleString()
    return _run(_labelled(df, id_column, text, label), dictionaries, f"doc_id {kind}, start int, end int, lang string, confidence double", lambda found, _: [(a, b, lang, c) for a, b, lang, c, _ in found])


def languages(found: list[tuple[int, int, str | None, float, int]]) -> list[tuple[str, float, float]]:
    """(language, share of letters, confidence) of the languages that count, the largest first."""
    letters: dict[str, int] = defaultdict(int)
    sure: dict[str, float] = defaultdict(float)
    for _, _, lang, confidence, n in found:
        letters[lang] += n
        sure[lang] += confidence * n
    total = sum(letters.values())
    return [(lang, n / total, sure[lang] / n) for lang, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])) if n >= SHARE * total]


def documents(df: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, lang, share, confidence, labelled): one row per document and language that counts in it.

    labelled is the language the document's own label stands for, null if for none. Null, empty and
    blank texts and those without prose give no row, as does an empty table. Repeated rows give a row
    each; other columns are ignored. The texts are read whole in one narrow pass; what is broadcast
    are the dictionaries, DICTIONARY bytes a language.
    """
    dictionaries = fit(df, id_column, text, label) if dictionaries is None else dictionaries
    kind = df.schema[id_column].dataType.simpleString()
    return _run(_labelled(df, id_column, text, label), dictionaries, f"doc_id {kind}, lang string, share double, confidence double, labelled string, languages int", lambda found, own: [(*x, own, len(every)) for every in [languages(found)] for x in every])


def mislabelled(df: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, lang): the documents() rows of documents whose label is missing or wrong or that hold several languages."""
    found = documents(df, id_column, text, label, dictionaries)
    return found.where("labelled is null or languages > 1 or labelled <> lang").select("doc_id", "lang").distinct()
