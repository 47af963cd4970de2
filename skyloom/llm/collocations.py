"""Phrase collocations by sorted fixed-width keys.

Texts become blocks of word numbers that hold for their block alone. Words are counted over all blocks, and those frequent enough get an id, by falling
frequency. Each block then learns the ids of its own words, so that no dictionary is ever held whole: words without an id break a piece, as do
its ends. The ids of every longest run of consecutive words, padded with zeros at a piece's end, are one key of fixed width. Keys are sorted by radix
and counted by runs within a block, dealt out by range, and sorted and counted again; shorter phrases are the prefixes of sorted keys.
Ranges hold about equal numbers of keys, for the frequencies of first words are known; a very frequent first word is cut by its second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import partitions, scratch, ship, staged, trimmed

#: Bytes of text of a block; keys of a range; keys that wait for a merge.
BLOCK_BYTES = 16 << 20
RANGE_KEYS = 4_000_000
#: Keys that are sorted at a time: a sort takes some 60 bytes a key beside its input.
SORT_KEYS = 400_000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _LOWER + b" " + b"\n" * len(_ENDS))
#: Stands for the end of a piece; no UTF-8 text holds this byte.
_END = b"\xff"


def _encoded(texts) -> pa.DictionaryArray:
    data = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_TABLE) + b"\n"
    return pa.array(data.replace(b"\n", b" \xff ").split(), pa.binary()).dictionary_encode()


def _block(lang: str, parts: list[pa.DictionaryArray]) -> pa.RecordBatch:
    whole = pa.chunked_array(parts).unify_dictionaries()
    words = whole.chunk(0).dictionary
    at = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
    counts = np.bincount(at, minlength=len(words)).astype(np.int64)
    end = words.index(pa.scalar(_END, pa.binary())).as_py()
    kept = np.delete(np.arange(len(words)), end)
    number = np.zeros(len(words), "<u4")  # zero: an end
    number[kept] = np.arange(1, len(kept) + 1)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), x) for x in (words.take(pa.array(kept)).cast(pa.string()), pa.array(counts[kept]))]
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(counts[kept].sum())]), *lists, pa.array([number[at].tobytes()], pa.binary())], ["lang", "n", "words", "counts", "tokens"])


def _blocks(batches):
    held: dict[str, list] = {}
    load = 0
    for b in batches:
        lang, text = b.column("lang").to_numpy(zero_copy_only=False), b.column("text").to_numpy(zero_copy_only=False)
        of = {}
        for i, x in enumerate(lang):
            of.setdefault(x, []).append(i)
        for x, rows in of.items():
            held.setdefault(x, []).append(_encoded(text[rows]))
        load += b.nbytes
        if load >= BLOCK_BYTES:
            yield from (_block(x, parts) for x, parts in held.items())
            held, load = {}, 0
    yield from (_block(x, parts) for x, parts in held.items())


def _radix(m: np.ndarray) -> np.ndarray:
    """The order of rows of word ids: stable sorts by 16 bits at a time, the last ones first."""
    order = np.arange(len(m))
    for col in m.T[::-1]:
        for shift in (0, 16):
            digit = (col >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _starts(m: np.ndarray, size: int) -> np.ndarray:
    """Where the first `size` ids of sorted rows change."""
    change = np.ones(len(m), bool)
    change[1:] = (m[1:, :size] != m[:-1, :size]).any(axis=1)
    return np.flatnonzero(change)


def _counted(m: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = _radix(m)
    m, counts = m[order], counts[order]
    at = _starts(m, m.shape[1])
    return m[at], np.add.reduceat(counts, at) if len(at) else counts


def _keys(g: np.ndarray, first: np.ndarray, longest: int) -> np.ndarray:
    """The ids of the runs of two words or more that begin at the places `first` of g, ids in order of the text (zero: none, or an end)."""
    m = np.zeros((len(first), longest), np.uint32)
    m[:, 0] = g[first]
    for j in range(1, longest):
        m[:, j] = np.where(m[:, j - 1] > 0, g[first + j], 0)
    return m


def _first_two(m: np.ndarray) -> np.ndarray:
    return m[:, 0].astype(np.uint64) << np.uint64(32) | m[:, 1]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of sorted values, the highest of all values first: they pack well."""
    return np.ascontiguousarray(x.astype(">u4").view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4 * width, n).T).view(">u4").astype(np.uint32)


def _dealt(batches, longest: int, bounds: np.ndarray):
    """Counted keys of every block, a row for each range."""
    for b in batches:
        for tokens, codes in zip(b.column("tokens"), b.column("codes")):
            tokens, codes = np.frombuffer(tokens.as_buffer(), "<u4"), codes.values.to_numpy()
            ids = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
            ids[(codes >> 32) + 1] = codes & 0xFFFFFFFF
            g = np.concatenate((ids[tokens], np.zeros(longest, np.uint32)))
            first = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0)).astype(np.uint32)
            of = np.zeros(len(first), np.int32)
            for i in range(0, len(first), SORT_KEYS):
                some = first[i : i + SORT_KEYS]
                of[i : i + SORT_KEYS] = np.searchsorted(bounds, g[some].astype(np.uint64) << np.uint64(32) | g[some + 1], "right")
            sizes = np.bincount(of, minlength=len(bounds) + 1)
            group = (np.cumsum(sizes) - sizes) // SORT_KEYS  # of ranges that are sorted together
            mine = group[of].astype(np.int32)
            for k in np.unique(group[sizes > 0]):
                m = _keys(g, first[mine == k], longest)
                m, counts = _counted(m, np.ones(len(m), np.uint32))
                yield _row_of_each(m, counts, bounds)


def _row_of_each(m: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A row for each range that sorted keys fall into."""
    of = np.searchsorted(bounds, _first_two(m), "right")
    cut = np.searchsorted(of, np.arange(len(bounds) + 2))
    rows = [(r, a, z) for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([z - a for _, a, z in rows], pa.int32()), pa.array([_planes(m[a:z]) for _, a, z in rows], pa.binary()), pa.array([_planes(counts[a:z]) for _, a, z in rows], pa.binary())],
        ["range", "n", "keys", "counts"],
    )


def _phrases(m: np.ndarray, counts: np.ndarray, least: int) -> list[pa.RecordBatch]:
    out = []
    for size in range(2, m.shape[1] + 1):
        at = _starts(m, size)
        f = np.add.reduceat(counts, at) if len(at) else counts
        kept = (m[at, size - 1] > 0) & (f >= least)
        ids = m[at[kept], :size].astype(np.int32)
        for i in range(0, len(ids), 50_000):
            part = ids[i : i + 50_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, size), pa.int32()), pa.array(part.ravel()))
            out.append(pa.RecordBatch.from_arrays([lists, pa.array(f[kept][i : i + 50_000])], ["ids", "f"]))
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]):
    """Sorted keys and their counts, from parts each sorted, to counted pieces in order; keys of the same first two ids stand in one piece."""
    n = -(-sum(len(m) for m, _ in parts) // SORT_KEYS)
    if n <= 1:
        if parts:
            yield _counted(*(np.concatenate(x) for x in zip(*parts)))
        return
    step = max(1, SORT_KEYS // 200)
    seen = np.sort(np.concatenate([_first_two(m[::step]) for m, _ in parts]))
    edges = np.unique(seen[[len(seen) * i // n for i in range(1, n)]])
    cuts = [np.concatenate(([0], np.searchsorted(_first_two(m), edges), [len(m)])) for m, _ in parts]
    for i in range(len(edges) + 1):
        some = [(m[c[i] : c[i + 1]], counts[c[i] : c[i + 1]]) for (m, counts), c in zip(parts, cuts) if c[i + 1] > c[i]]
        if some:
            yield _counted(*(np.concatenate(x) for x in zip(*some)))


def _runs(batches, longest: int, least: int):
    """Rows sorted by range: the phrases of at least `least` occurrences in each."""
    at, held, wait, load = None, [], [], 0
    for b in batches:
        for r, n, keys, counts in zip(b.column("range").to_pylist(), b.column("n").to_pylist(), b.column("keys"), b.column("counts")):
            if r != at:
                for piece in _merged(held + wait):
                    yield from _phrases(*piece, least)
                at, held, wait, load = r, [], [], 0
            elif load > RANGE_KEYS:
                held, wait, load = list(_merged(held + wait)), [], 0
            wait.append((_from_planes(keys.as_buffer(), n, longest), _from_planes(counts.as_buffer(), n, 1).ravel().astype(np.int64)))
            load += n
    for piece in _merged(held + wait):
        yield from _phrases(*piece, least)


def _dictionary(words: DataFrame, least: int) -> DataFrame:
    """id (from 1), lang, word, f of the words of at least `least` occurrences, and upto: occurrences of all words up to this one."""
    spark = words.sparkSession
    frequent = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    frequent = frequent.repartitionByRange(partitions(spark), F.desc("f"), "lang", "word").sortWithinPartitions(F.desc("f"), "lang", "word")
    frequent = staged(frequent.withColumn("at", F.monotonically_increasing_id()), "frequent")
    part = F.shiftright("at", 33)
    sums = sorted(frequent.groupBy(part.alias("part")).agg(F.count("*"), F.sum("f")).collect())  # one row for each partition
    rows, before, upto = [], 0, 0
    for p, n, f in sums:
        rows.append((p, before, upto))
        before, upto = before + n, upto + f
    offsets = spark.createDataFrame(rows, "part long, before long, passed long")
    known = frequent.withColumn("part", part).join(F.broadcast(offsets), "part")
    running = F.sum("f").over(Window.partitionBy("part").orderBy("at"))
    known = known.select((F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1).alias("id"), "lang", "word", "f", (F.col("passed") + running).alias("upto"))
    return staged(known, "dictionary")


def _bounds(dictionary: DataFrame, at_least: int) -> np.ndarray:
    """First keys (two ids in 64 bits) of all ranges but the lowest: ranges of about equal frequency of first words, a very frequent one cut by second words."""
    total = dictionary.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    n = max(at_least, -(-total // RANGE_KEYS))
    share = max(1, -(-total // n))
    crossing = F.expr(f"upto div {share} > (upto - f) div {share}")
    rows = dictionary.where(crossing).select("id", "f", "upto").orderBy("id").collect()  # at most one for each range
    seconds = np.array([r.upto for r in rows])
    out = set()
    for r in rows:
        out.add((r.id + 1) << 32)
        parts = r.f // share
        if parts > 1:
            out.add(r.id << 32)
            out |= {r.id << 32 | rows[min(int(np.searchsorted(seconds, total * j // parts)), len(rows) - 1)].id for j in range(1, parts)}
    return np.array(sorted(out), np.uint64)


def _ranked(df: DataFrame, by: list, top: int, how=F.rank) -> DataFrame:
    return df.withColumn("rank", how().over(Window.partitionBy(*by[0]).orderBy(*by[1]))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: each language's best phrases of two to `longest` words, of at least `least` occurrences.

    Texts are lower-cased (A to Z) and split at full stops, commas, semicolons, colons, exclamation and question marks and line ends into pieces, and
    these at spaces and tabs into words; n counts a language's words. A phrase's score is the lowest, over its cuts into two parts of l and r occurrences, of
    floor(1000000 a^2 / (l r)); exact below 10^15 occurrences. Phrases inside of a longer candidate with at least `inside` hundredths of their
    own occurrences are dropped. Ties go to more occurrences and then to the smaller phrase, by its bytes.

    Null texts are empty, a null lang is `und`; repeated rows count as often as they stand, whatever their doc_id; texts are taken whole, however long. Tables
    without candidates give an empty result. Other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark):
        rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        blocks = rows.mapInArrow(lambda b: trimmed(_blocks(b)), "lang string, n long, words array<string>, counts array<long>, tokens binary")
        blocks = staged(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
        words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "of"))
        words = words.select("block", "lang", "pos", F.col("of.words").alias("word"), F.col("of.counts").alias("count"))
        dictionary = _dictionary(words.select("lang", "word", "count"), least)
        bounds = _bounds(dictionary, partitions(spark))
        codes = words.select("block", "lang", "pos", "word").join(dictionary.select("lang", "word", "id"), ["lang", "word"])
        codes = codes.groupBy("block").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("id"))).alias("codes"))
        dealt = blocks.select("block", "tokens").join(codes.hint("merge"), "block").select("tokens", "codes")
        dealt = dealt.mapInArrow(lambda b: trimmed(_dealt(b, longest, bounds)), "range int, n int, keys binary, counts binary")
        runs = dealt.repartition(len(bounds) + 1, "range").sortWithinPartitions("range")
        grams = staged(runs.mapInArrow(lambda b: trimmed(_runs(b, longest, least)), "ids array<int>, f long"), "grams")
        out = staged(_scored(grams, dictionary, inside), "scored")
        best = _best(out, dictionary, top)
        n = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
        out = best.join(n, "lang").select("lang", "rank", "phrase", F.size("ids").alias("words"), "a", "l", "r", "n", "score")
        return staged(out, "collocations", keep=True)


def _scored(grams: DataFrame, dictionary: DataFrame, inside: int) -> DataFrame:
    """ids, lang, a, l, r, score of the candidates that stay."""
    size = F.size("ids")
    one = F.array(F.col("id").cast("int"))
    known = dictionary.select(one.alias("part"), "f").unionByName(grams.select(F.col("ids").alias("part"), "f"))
    cuts = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", 1, F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(known.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    whole = lambda c: f"cast({c} as decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"{whole('a')} * {whole('a')} * cast(1000000 as decimal(7,0)) div ({whole('l')} * {whole('r')})"))
    found = cuts.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low")).select("ids", "low.a", "low.l", "low.r", "low.score")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
    longer = grams.where(size > 2).select(F.explode(spans).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    found = found.join(longer, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    langs = dictionary.select(F.col("id").cast("int").alias("first"), "lang")
    return found.withColumn("first", F.col("ids")[0]).join(langs, "first").drop("first")


def _best(found: DataFrame, dictionary: DataFrame, top: int) -> DataFrame:
    """The first of each language: those of a share first, then of all; only these get their words."""
    order = [F.desc("score"), F.desc("a")]
    share = F.pmod(F.xxhash64("ids"), F.lit(partitions(found.sparkSession)))
    best = _ranked(found.withColumn("share", share), [["lang", "share"], order], top).drop("share")
    best = staged(_ranked(best, [["lang"], order], top), "best")
    said = best.select("ids", F.posexplode("ids").alias("pos", "id")).join(dictionary.select(F.col("id").cast("int").alias("id"), "word"), "id")
    said = said.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return _ranked(best.drop("rank").join(said, "ids"), [["lang"], [*order, "phrase"]], top, F.row_number)
