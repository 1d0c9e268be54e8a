"""Near-duplicate records: an exact prefix filter over words, the rarest first, a bound by parity sketches in the join and an exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.components import components
from querymill.llm.records import lowered, record_digest
from querymill.session import write_shared

#: Bits of a word's hash that choose its counter. The counters, 8 bytes each, are all that is broadcast,
#: whatever the number of records and words; words that share one only share a place in the order.
COUNTERS = 20

MIX = np.uint64(0x9E3779B97F4A7C15)


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_BYTE = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x5851F42D4C957F2D


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): the sorted 64-bit hashes of each text's distinct runs of a-z and 0-9.

    Texts are lower-cased UTF-8. One pass over the bytes of all texts together, without a loop over words.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = _IS_WORD[raw]
    edges = np.diff(np.r_[False, inside].astype(np.int8))
    starts = np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    sizes = np.flatnonzero(edges == -1) - starts
    at = np.flatnonzero(inside)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    place = np.arange(len(at)) - np.repeat(first, sizes)
    hashes = np.add.reduceat(_BYTE[raw[at]] * _powers(int(sizes.max()))[place], first)
    hashes ^= hashes >> np.uint64(31)
    hashes *= MIX
    hashes ^= hashes >> np.uint64(29)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    owner = np.searchsorted(ends, starts, side="right")
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)


def _units(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each (non-empty) word set."""
    place = np.arange(len(hashes)) - np.repeat(_starts(lengths), lengths)
    out = np.add.reduceat((hashes ^ (hashes >> np.uint64(30))) * _powers(int(lengths.max()))[place], _starts(lengths))
    out ^= out >> np.uint64(32)
    return out * MIX


def _key(fields: list[bytes]) -> int:
    """The hash of a record's canonicalised fields in sorted order."""
    return int.from_bytes(record_digest(fields)[:8], "little", signed=True)


def word_table(df: DataFrame) -> DataFrame:
    """(id, side, key, unit, w) of (id, side, fields…): each record with words, its words, and what stands for both.

    key: the record, canonicalised; unit: its word set; w: the hashes of its words. The texts are read
    this once; all that follows reads the written table, column by column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[lowered(v) for v in c.to_pylist()] for c in batch.columns[2:]]
            hashes, lengths = word_sets([b" ".join(fields) for fields in zip(*columns)])
            has = np.flatnonzero(lengths)
            if len(has):
                lengths = lengths[has]
                keys = np.array([_key([c[i] for c in columns]) for i in has], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield _batch(id=batch.column(0).take(pa.array(has)), side=batch.column(1).take(pa.array(has)), key=keys, unit=_units(hashes, lengths), w=lists)

    return write_shared(df.mapInArrow(run, "id long, side int, key long, unit long, w array<long>"), "similar-words")


def _each(df: DataFrame, schema: str, make: Callable[..., pa.RecordBatch]) -> DataFrame:
    """make(hashes, lengths, units) of each batch of (w, unit…)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = batch.column(0)
                units = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) if batch.num_columns > 1 else None
                yield make(w.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(w.offsets.to_numpy()).astype(np.int64), units)

    return df.mapInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)


def frequencies(words: DataFrame) -> np.ndarray:
    """How many words of the records fall on each of 2^COUNTERS counters; that many rows at most reach the driver."""

    def count(hashes, lengths, units) -> pa.RecordBatch:
        n = np.bincount(_counter(hashes))
        used = np.flatnonzero(n)
        return _batch(counter=used, n=n[used])

    rows = _each(words.select("w"), "counter long, n long", count).groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTERS, dtype=np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefixes(frequency: np.ndarray, threshold: float, smaller: bool) -> Callable[..., pa.RecordBatch]:
    """One row per prefix word of each different word set of a batch: its copies go no further.

    All sets are in one order of words: by the frequency of their counters, then by hash. Similar sets
    share one of the first n - ceil(t n) + 1 of the n words of either, and it is one of the first
    n - ceil(2 t / (1 + t) n) + 1 of the smaller one. place: how many words of the set come before the
    word. odd: which of 64 bits an odd number of the set's words fall on.
    """
    t = round(threshold * 1000)
    part, whole = (2 * t, 1000 + t) if smaller else (t, 1000)

    def make(hashes, lengths, units) -> pa.RecordBatch:
        first = np.sort(np.unique(units, return_index=True)[1])
        chosen = np.zeros(len(lengths), dtype=bool)
        chosen[first] = True
        flat = hashes[np.repeat(chosen, lengths)]
        units, lengths = units[first], lengths[first]
        starts = _starts(lengths)
        odd = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((flat, frequency[_counter(flat)], owner))
        place = np.arange(len(flat)) - np.repeat(starts, lengths)
        keep = place <= np.repeat(lengths + (-lengths * part) // whole, lengths)
        rows = owner[keep]
        return _batch(unit=units[rows], n=lengths[rows], place=place[keep], odd=odd[rows], word=flat[order][keep])

    return make


def candidates(words: DataFrame, across: bool, threshold: float) -> DataFrame:
    """(a, b): pairs of different word sets that may be similar, a < b; across: of side 0 with side 1.

    They share a prefix word, and neither their sketches, nor the words before the shared one, nor their
    sizes show too many differences: two sets differ in at least as many words as their sketches in
    bits, and the first shared word has only unshared ones before it. All of it is compared inside the
    join, so that a chance candidate hardly ever leaves the task that met it; no similar pair fails there.
    """
    shared = words.sparkSession.sparkContext.broadcast(frequencies(words))

    def rows(side: int, smaller: bool) -> DataFrame:
        def make(*args):
            return _prefixes(shared.value, threshold, smaller)(*args)

        mine = words.where(F.col("side") == side) if across else words
        return _each(mine.select("w", "unit"), "unit long, n long, place long, odd long, word long", make)

    t = round(threshold * 1000)
    most = (F.col("a.n") + F.col("b.n")) * (1000 - t)
    on = (F.col("a.word") == F.col("b.word")) & (F.bit_count(F.col("a.odd").bitwiseXOR(F.col("b.odd"))) * (1000 + t) <= most)
    on = on & ((F.col("a.place") + F.col("b.place")) * (1000 + t) <= most) & (F.col("b.n") * t <= F.col("a.n") * 1000)
    on = on & ((F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.unit") < F.col("b.unit")))
    met = [rows(x, True).alias("a").join(rows(1 - x, False).alias("b"), on) for x in ((0, 1) if across else (0,))]
    return reduce(DataFrame.union, [m.select(F.least("a.unit", "b.unit").alias("a"), F.greatest("a.unit", "b.unit").alias("b")) for m in met]).distinct()


def exact(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose word sets share at least `threshold` of the words in either."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            wa, wb = batch.column("wa"), batch.column("wb")
            la, lb = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (wa, wb))
            rows = np.r_[np.repeat(np.arange(n), la), np.repeat(np.arange(n), lb)]
            values = np.r_[wa.flatten().to_numpy(zero_copy_only=False), wb.flatten().to_numpy(zero_copy_only=False)]
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            shared = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])], minlength=n)
            # in integers: shared / (la + lb - shared) >= threshold, with the threshold in thousandths
            keep = shared * 1000 >= (la + lb - shared) * round(threshold * 1000)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    both = pairs.join(units.select(F.col("unit").alias("a"), F.col("w").alias("wa")), "a").join(units.select(F.col("unit").alias("b"), F.col("w").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(check, "a long, b long").distinct()


def _linked(tables: tuple[DataFrame, ...], id_column: str, columns: tuple[str, ...], threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, side, key, unit) of the records with words, (a, b) of the similar different word sets)."""
    parts = [x.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.lit(side).alias("side"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)]) for side, x in enumerate(tables)]
    words = word_table(reduce(DataFrame.union, parts))
    # kept, so that only candidates' words are sent, past a broadcast of their units where they are few
    pairs = write_shared(candidates(words, len(tables) > 1, threshold), "similar-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    sets = words.select("unit", "w").join(asked, "unit", "left_semi").groupBy("unit").agg(F.first("w").alias("w"))
    return words.select("id", "side", "key", "unit").distinct(), exact(pairs, sets, threshold)


def similar_groups(df: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("question", "query"), threshold: float = 0.75) -> DataFrame:
    """(id, group): every record with the smallest id of its group, its own if it is like no other.

    A group is what similar pairs and copies connect, directly or over others. Components are of word
    sets, so copies add no edges. Records without words are similar to none: only copies share their
    group. Rows that repeat an id count once; null ids are no records.
    """
    ids, found = _linked((df,), id_column, columns, threshold)
    # copies whose words are divided differently are different word sets of one key
    least = ids.groupBy("key").agg(F.min("unit").alias("b"), F.max("unit").alias("most")).where("b <> most").drop("most")
    copies = ids.join(least, "key").where("unit <> b").select(F.col("unit").alias("a"), "b").distinct()
    of = components(found.union(copies)).select(F.col("node").alias("unit"), "component")
    records = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), *columns)
    signs = F.array_join(F.array_sort(F.array(*[F.regexp_replace(F.coalesce(c, F.lit("")), "[^<>=*+/%]+", "") for c in columns])), " ")
    # few have no ASCII letter or digit, and some of them have words once lowered: only these are looked up
    bare = records.where(~F.concat_ws(" ", *columns).rlike("[A-Za-z0-9]"))
    wordless = bare.join(ids.select("id"), "id", "left_anti").select("id", signs.alias("class"))
    known = ids.select("id", "unit").join(of, "unit", "left").select("id", F.coalesce("component", "unit").cast("string").alias("class"))
    members = write_shared(known.union(wordless).groupBy("id").agg(F.min("class").alias("class")), "similar-members")
    return members.join(members.groupBy("class").agg(F.min("id").alias("group")), "class").select("id", "group")


def similar_pairs(left: DataFrame, right: DataFrame | None = None, id_column: str = "id", columns: tuple[str, ...] = ("question", "query"), threshold: float = 0.75) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of similar records that are not the same when canonicalised.

    Pairs within left, or of a record of left with one of right. Two records are similar if the
    words in both are at least `threshold` of the words in either. Null fields are empty; records
    without words are similar to none; rows that repeat an id count once; null ids are no records;
    other columns are ignored; empty tables give no pairs.

    Word sets rather than records meet: copies are one unit. Similar sets share a word of their
    prefixes, rarest words first, so none is missed for how its words fall; common words meet only
    in sets that have hardly any rarer ones. A candidate's difference is first bounded by sizes, places
    and parity sketches, in the join itself, then its similarity computed from the words. No word is
    capped: a hot one is split by the adaptive skew join.
    """
    across = right is not None
    ids, found = _linked((left, right) if across else (left,), id_column, columns, threshold)
    # records that are the same count as one class here, so a hot group of copies is paired once
    classes = ids.select("unit", "key", "side").distinct()
    one, two = (classes.select(F.col("unit").alias(u), F.col("key").alias(f"k{u}"), F.col("side").alias(f"s{u}")) for u in "ab")
    links = found.union(found.select("b", "a")) if across else found
    apart = links.join(one, "a").join(two, "b")
    # one word set may hold records that differ in the order of their words
    mixed = classes.groupBy("unit").agg(F.countDistinct("key").alias("n")).where("n > 1").select(F.col("unit").alias("a"), F.col("unit").alias("b"))
    together = mixed.join(one, "a").join(two, "b").where(F.lit(across) | (F.col("ka") < F.col("kb")))
    pairs = apart.unionByName(together).where("ka <> kb")
    pairs = pairs.where("sa = 0 and sb = 1") if across else pairs
    for u in "ab":
        pairs = pairs.join(ids.select(F.col("unit").alias(u), F.col("key").alias(f"k{u}"), F.col("side").alias(f"s{u}"), F.col("id").alias(f"i{u}")), [u, f"k{u}", f"s{u}"])
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
