"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of eight words of the template are hash-joined with those of the
benchmark, and what stood in the placeholders is compared. Matches are judged by alignment, document position less item position, so
that other variants of an item in the same document, or windows alike by accident, don't count against one: a place of the item must
meet one value in an alignment of neighbouring differences. Over the whole document one value of the item must always meet one value.

Whether a capitalised word is a name depends on context, and lower-case or upper-case copies show no names. So windows of documents
come in three forms: names but at sentence starts, every capitalised word a name, and no names; windows of items come with each
choice for the words at sentence starts. Items under eight words are one window of their own length. Items none of whose windows
holds enough words besides the placeholders, such as sums, are met by windows of their exact words.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import _BYTE, NULL_ID, _pow, grams, id_in, id_out, mix, scratch, ship, staged, texts, trimmed, word_hashes

WINDOW = 8
#: Words of a window that are no placeholder, at least; windows of an item that a document must hold (all, if fewer); share of slots that must agree.
LITERALS = 4
MATCHED = 6
#: Words of an item without such windows from which on it is found at any place of a text, by its exact words; shorter ones must be the text.
EXACT_WORDS = 5
CONSISTENT = 0.8
#: Differences of position between an item and a document that lie so near are one alignment: a word more or less within the item.
NEAR = 3
#: Bits by which windows of documents are sifted before the join: 512 KB, whatever the size of the benchmark.
SIEVE_BITS = 22

# Names of units that follow a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr hrs hours days weeks months years usd eur gbp dollars euros cents percent meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres minutes seconds degrees watts volts"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x9D3C0B6C1F2E7A55, 0x3B4F90D2A86E1C77, 0x71C6E5A3D9084B2F))


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word: its hash, that of its form where numbers and units are placeholders (names are not), and whether it is a name or, at
    the start of a sentence, may be one. Punctuation and, but for names, case don't count."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").split())
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    keep = ~_PUNCT[raw]
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    power, inverse = _pow(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power[place[:-1]] * keep, out=run[1:])
    long = place[ends] - place[starts]
    word = mix((run[ends] - run[starts]) * inverse[place[starts]] + long.astype(np.uint64))
    some = long > 0
    number = np.add.reduceat(_DIGIT[raw], starts, dtype=np.int64) > 0
    upper = np.add.reduceat(_UPPER[raw], starts, dtype=np.int64) > 0
    new = np.concatenate(([True], _END[raw[ends - 1]][:-1]))
    word, number, upper, new = word[some], number[some], upper[some], new[some]
    unit = np.concatenate(([False], number[:-1])) & np.isin(word, _UNITS) if number.any() else np.zeros(len(word), bool)
    form = word.copy()
    form[unit] = _UNIT
    form[number] = _NUMBER
    upper &= form == word
    return word, form, upper & ~new, upper & new


_UNITS = np.sort(word_hashes(UNITS.encode())[0])


def _grams(form: np.ndarray, size: int) -> np.ndarray:
    return grams(form, WINDOW) if size == WINDOW else mix(grams(form, size) + np.uint64(size))


def _usable(word: np.ndarray, form: np.ndarray, size: int) -> np.ndarray:
    literal = np.concatenate(([0], np.cumsum(form == word)))
    return literal[size:] - literal[:-size] >= LITERALS


def _exact(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of the words as they are, numbers and units too."""
    return mix(grams(word, size) + np.uint64(64 + size))


def _slots(word: np.ndarray, form: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(at), WINDOW), np.uint64)
    out[:, :size] = np.where(form != word, word, np.uint64(0))[at[:, None] + np.arange(size)]
    return out


def _whole(word: np.ndarray) -> tuple:
    """A text of few words, to be met by a text of the same words only."""
    return np.zeros(1, np.int64), mix(grams(word, len(word)) + np.uint64(WINDOW + len(word))), np.zeros((1, WINDOW), np.uint64)


def _named(form: np.ndarray, names: np.ndarray) -> np.ndarray:
    return np.where(names, _NAME, form)


def _of_text(text: str, sizes: tuple[int, ...], exact: tuple[int, ...] = ()) -> list[tuple]:
    """Position, hash and slots of the windows of a document, for each form."""
    word, plain, name, maybe = template(text)
    out = [_whole(word)] if 0 < len(word) < WINDOW else []
    for size in exact:
        if len(word) >= size:
            h = _exact(word, size)
            out.append((np.arange(len(h)), h, (word, word, size)))
    for size in sizes:
        if len(word) < size:
            continue
        seen = []
        for form in (_named(plain, name), _named(plain, name | maybe), plain):
            h = _grams(form, size)
            new = _usable(word, form, size)
            for other in seen:
                new = new & (h != other)
            seen.append(h)
            at = np.flatnonzero(new)
            out.append((at, h[at], (word, form, size)))
    return out


def _of_item(text: str) -> tuple[list[tuple], int, int, int]:
    """Position, hash and slots of the windows of an item, the number of windows, how many of them a document must hold, and the words of a window
    (negative: exact ones)."""
    word, plain, name, maybe = template(text)
    size = min(WINDOW, len(word))
    if not size:
        return [], 0, 0, 0
    forms = [_named(plain, name), plain]
    if len(word) < EXACT_WORDS and not _usable(word, plain, size).any():
        return [_whole(word)], 1, 1, 0
    ok = [_usable(word, f, size) for f in forms]
    found = {(int(i), int(h)): (f, i) for f, u in zip(forms, ok) for i, h in zip(np.flatnonzero(u), _grams(f, size)[u])}
    touched = np.concatenate(([0], np.cumsum(maybe)))
    for i in np.flatnonzero(touched[size:] > touched[:-size]):
        which = i + np.flatnonzero(maybe[i : i + size])
        for choice in product((False, True), repeat=len(which)):
            form = forms[0].copy()
            form[which[list(choice)]] = _NAME
            w = slice(i, i + size)
            if (form[w] == word[w]).sum() >= LITERALS:
                found.setdefault((int(i), int(_grams(form[w], size)[0])), (form, i))
    if not found:  # its own words, all in their order
        h = _exact(word, size)
        return [(np.arange(len(h)), h, np.zeros((len(h), WINDOW), np.uint64))], len(h), len(h), -size
    usual, sure = int(ok[0].sum()), int(_usable(word, _named(plain, name | maybe), size).sum())
    # an item of few windows may miss those that are none once the words at sentence starts are names
    need = MATCHED if usual > MATCHED else max(1, sure)
    out = [(np.array([i]), np.array([h], np.uint64), _slots(word, f, np.array([i]), size)) for (i, h), (f, _) in found.items()]
    return out, len({i for i, _ in found}), min(need, len({i for i, _ in found})), size


_HITS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64())), ("n", pa.int64()), ("need", pa.int64()), ("size", pa.int64())])
_HITS_DDL = "doc_id long, row_key long, pos long, hash long, slots array<long>, n long, need long, size long"


def _hits(batches, sieve, sizes=(), exact=()):
    """Windows of documents that pass the sieve; without one, those of items."""
    bits = None if sieve is None else np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little").astype(bool)
    for batch in batches:
        cols = [[] for _ in range(8)]
        for d, row, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"]):
            some, n, need, size = _of_item(text.as_py()) if bits is None else (_of_text(text.as_py(), sizes, exact), 0, 0, 0)
            for at, h, slots in some:
                if bits is not None:
                    ok = bits[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
                    at, h = at[ok], h[ok]
                    slots = slots[ok] if isinstance(slots, np.ndarray) else _slots(*slots[:2], at, slots[2])
                for c, x in zip(cols, (np.full(len(at), d), np.full(len(at), row), at, h.view(np.int64), slots.view(np.int64), *(np.full(len(at), v) for v in (n, need, size)))):
                    c.append(x)
        if cols[0]:
            d, row, at, h, slots, *more = map(np.concatenate, cols)
            slots = pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, WINDOW), pa.int32()), pa.array(slots.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(row), pa.array(at.astype(np.int64)), pa.array(h), slots, *(pa.array(x) for x in more)], schema=_HITS)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and row_key of the texts that leak items, with item_ids, coverage and consistency."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(id_in("item_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.groupBy("text").agg(F.min("doc_id").alias("doc_id")).withColumn("row_key", F.lit(0).cast("long"))
    known = staged(items.mapInArrow(lambda b: _hits(b, None), _HITS_DDL), "benchmark").select(F.col("doc_id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), F.col("n").alias("n_windows"), "need", "size")
    found = {r.size for r in known.select("size").distinct().collect()}  # ten at most
    sizes, exact = tuple(sorted({WINDOW} | {n for n in found if n > 0})), tuple(sorted(-n for n in found if n < 0))
    bit = F.shiftrightunsigned("hash", 64 - SIEVE_BITS)
    width = 8 * 4096  # bits of a part that bitmap_construct_agg makes
    parts = known.groupBy((bit / width).cast("long").alias("part")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(width))).alias("bits"))
    sieve = bytearray(1 << (SIEVE_BITS - 3))
    for r in parts.collect():  # 128 parts of 4 KB at most
        sieve[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    sieve = spark.sparkContext.broadcast(bytes(sieve))
    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    hits = rows.mapInArrow(lambda b: trimmed(_hits(b, sieve, sizes, exact)), _HITS_DDL).drop("n", "need", "size").distinct()
    key = ["doc_id", "row_key", "item_id"]
    counts = [F.first(c).alias(c) for c in ("n_windows", "need")]
    both = hits.join(known, "hash").select(*key, "item_pos", "n_windows", "need", (F.col("pos") - F.col("item_pos")).alias("shift"), F.arrays_zip("item_slots", "slots").alias("s"))
    both = staged(both, "matches")
    share = lambda name: F.avg((F.col(name) == 1).cast("double")).alias("consistency")
    # an alignment by a single difference: each place of the item meets one place of the document
    by_shift = both.groupBy(*key, "shift").agg(F.count_distinct("item_pos").alias("matched"), *counts).withColumn("consistency", F.lit(1.0))
    # neighbouring differences as one alignment: each place meets one value
    order = Window.partitionBy(*key).orderBy("shift")
    group = by_shift.select(*key, "shift", (F.col("shift") - F.lag("shift").over(order) <= NEAR).alias("near"))
    group = group.select(*key, "shift", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(order).alias("group"))
    grouped = both.join(group, [*key, "shift"])
    near = grouped.groupBy(*key, "group").agg(F.count_distinct("item_pos").alias("matched"), *counts)
    values = grouped.select(*key, "group", "item_pos", F.posexplode("s").alias("k", "s")).where("s.item_slots <> 0")
    values = values.groupBy(*key, "group", (F.col("item_pos") + F.col("k")).alias("place")).agg(F.count_distinct("s.slots").alias("values"))
    near = near.join(values.groupBy(*key, "group").agg(share("values")), [*key, "group"], "left")
    # the whole document: each value meets one value
    matched = both.groupBy(*key).agg(F.count_distinct("item_pos").alias("matched"), *counts)
    slots = both.select(*key, F.explode("s").alias("s")).where("s.item_slots <> 0").groupBy(*key, "s.item_slots").agg(F.count_distinct("s.slots").alias("values"))
    whole = matched.join(slots.groupBy(*key).agg(share("values")), key, "left")
    found = by_shift.drop("shift").unionByName(near.drop("group")).unionByName(whole).withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    found = found.where((F.col("matched") >= F.col("need")) & (F.col("consistency") >= CONSISTENT))
    coverage = F.col("matched") / F.col("n_windows")
    found = found.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(coverage).alias("coverage"), F.max_by("consistency", coverage).alias("consistency"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (those it leaks, ascending), coverage (largest share of an item's windows), consistency (of its slots).

    Every row comes back, repeated ones too. Items of equal text count as the smallest item_id among them; items of fewer than
    eight words must be held whole. Items none of whose windows holds four words besides numbers, names and units are found by their exact words, all in
    order, at any place of a text; those of them with fewer than five words must be the whole text. Items without words take no part, null or empty
    texts hold nothing, and very long ones are taken whole. Without documents the result is empty; without items all rows are clean.
    """
    found = leaks(docs, benchmark)
    slim = texts(docs).select("doc_id", F.xxhash64("text").alias("row_key"))
    out = slim.join(found, ["doc_id", "row_key"], "left")
    return out.select(id_out("doc_id").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "consistency")


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all their columns; see decontaminate. Null and empty texts stay, of repeated rows all, and an empty table is empty."""
    with scratch(docs.sparkSession):
        found = staged(leaks(docs, benchmark).select(F.col("doc_id").alias("id"), "row_key"), "leaks", keep=True)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(found, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == found["id"]) & (F.xxhash64(text) == found["row_key"]), "left_anti")
