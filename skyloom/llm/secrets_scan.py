"""Secret scans: patterns, and a battery of randomness tests; DataFrame functions only.

Beside the patterns, each long run of key-like characters is a candidate. Its encoding is inferred from the characters it has, and its symbols are
tested for uniformity (chi-squared over the alphabet) and for serial correlation: a candidate that fails is no secret. How unlike
ordinary text it is, three tests say, each by a Chernoff bound for the candidate's length. Runs: in words neighbours are of one character
class, and in plain numbers of one half of the digits. Alphabet: words seldom have the letters that random ones have as often as
others. Serial: in words vowels and consonants take turns, and in plain numbers neighbours are near. Fisher's sum combines the tests that an
encoding allows, and Benjamini-Hochberg over the candidates of all documents keeps false discoveries at a set rate, whatever the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import id_in, id_out, staged

# Patterns of the base kinds (kind, pattern, group whose length counts, its least length).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: In ordinary text: chance of a class change between neighbours, share of rare letters, of pairs of letters that are vowel and consonant; in
#: ordinary numbers: chance that neighbours lie in unlike halves of the digits, and that they differ by one at most.
CHANGE, RARE, TURNS = 0.08, 0.10, 0.50
HALVES, STEPS = 0.25, 0.50
RARE_LETTERS = "jkqvwxyz"
#: Rate of false discoveries; level at which a candidate fails uniformity and correlation.
FALSE_DISCOVERIES = 0.001
REJECT_Z = 3.5
#: p values are counted in bins of a hundredth of a power of ten, up to this many powers.
POWERS = 60


_BLOCK = 64


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, token) of the matches, by code points: the pieces between matches tell where they stand."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    size = lambda x: F.char_length(x["gap"]) + F.char_length(x["m"])

    def step(acc, x):
        begin = acc["at"] + F.char_length(x["gap"])
        token = F.struct(begin.alias("start"), (acc["at"] + size(x)).alias("end"), x["m"].alias("token"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(F.char_length(x["g"]) >= least, F.concat(acc["found"], F.array(token))).otherwise(acc["found"]).alias("found"))

    # in blocks, as lists are copied while they grow
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda i: F.slice(x, i * _BLOCK + 1, F.lit(_BLOCK)))
    long = lambda b: F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + size(y)))
    starts = lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda s, y: s + y))
    of_block = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("found")), step)["found"]
    found = _let(zipped, lambda x: F.when(F.size(x) > 0, _let(cut(x), lambda b: _let(long(b), lambda n: F.flatten(F.zip_with(b, starts(n), of_block))))).otherwise(none))
    return found


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body and what is inside of it name it."""
    return F.transform(F.array(value), body)[0]


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    rows = docs.select(id_in("doc_id").alias("doc_id"), text.alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    t = F.col("text")
    for kind, pattern, group, least in PATTERNS:
        rows = rows.withColumn(kind, F.when(t.rlike(pattern), _matches(t, pattern, group, least)).otherwise(none))
    rows = rows.withColumn("candidates", F.when(t.rlike(CANDIDATE), _matches(t, CANDIDATE, 0, 20)).otherwise(none))
    return rows.drop("text")


def _tail(count: Column, n: Column, rate: float, above: bool) -> Column:
    """Logarithm of the chance, by Chernoff, that of n trials at this rate so many (above) or so few succeed."""
    q = F.least(F.greatest(count / F.greatest(n, F.lit(1)), F.lit(1e-9)), F.lit(1 - 1e-9))
    far = q * F.log(q / rate) + (1 - q) * F.log((1 - q) / (1 - rate))
    return F.when(q > rate if above else q < rate, -n * far).otherwise(0.0)


def _tested(c: DataFrame) -> DataFrame:
    """c has token: adds log10_p, by how little chance ordinary text is so, and random, whether uniformity and correlation pass."""
    c = c.withColumn("body", F.regexp_replace("token", "=+$", "")).withColumn("n", F.char_length("body")).where("n >= 16")
    # the smallest alphabet that holds all characters
    size = F.when(F.col("body").rlike("^[0-9]+$"), 10).when(F.col("body").rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(F.col("body").rlike("^[A-Z2-7]+$"), 32).when(F.col("body").rlike("^[A-Z0-9]+$|^[a-z0-9]+$"), 36).when(F.col("body").rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    c = c.withColumn("k", size).withColumn("chars", F.slice(F.split("body", ""), 1, F.col("n")))
    # sum of squared counts: one pass over the sorted characters
    sorted_ = F.aggregate(
        F.array_sort("chars"),
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, x: F.when(a["last"] == x, F.struct(x.alias("last"), (a["run"] + 1).alias("run"), (a["sum"] + 2 * a["run"] + 1).alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + 1).alias("sum"))),
    )["sum"]
    chi = F.col("k") / F.col("n") * sorted_ - F.col("n")
    # Wilson and Hilferty: the cube root of chi-squared by its freedom is nearly normal
    free = F.col("k") - 1
    c = c.withColumn("z_uniform", (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    order = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=")
    c = c.withColumn("v", F.transform("chars", lambda x: F.instr(order, x).cast("double")))
    # sums of the symbols alone: a mean inside of a lambda would be computed for each symbol
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    beside = F.aggregate(F.zip_with(F.slice("v", 1, F.col("n") - 1), F.slice("v", 2, F.col("n") - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    c = c.withColumns({"total": total, "square": square, "beside": beside, "ends": F.element_at("v", 1) + F.element_at("v", -1)})
    mean = F.col("total") / F.col("n")
    var = F.col("square") - F.col("n") * mean * mean
    lag = F.col("beside") - mean * (2 * F.col("total") - F.col("ends")) + (F.col("n") - 1) * mean * mean
    c = c.withColumn("z_serial", F.when(var > 1e-9, F.abs(lag / F.when(var > 1e-9, var) + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0)))
    one = F.col("body").rlike("^([a-z]+|[A-Z]+)$")
    digits = F.col("body").rlike("^[0-9]+$")
    kind = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", "U" * 26 + "l" * 26 + "9" * 10 + "-" * 5)
    half = F.translate("body", "0123456789", "0000055555")
    sound = F.translate(F.lower("body"), "aeioubcdfghjklmnpqrstvwxyz", "v" * 5 + "c" * 21)
    c = c.withColumn("kinds", F.slice(F.split(F.when(digits, half).otherwise(kind), ""), 1, F.col("n"))).withColumn("sounds", F.slice(F.split(sound, ""), 1, F.col("n")))
    pairs = lambda a, f: F.aggregate(F.zip_with(F.slice(a, 1, F.col("n") - 1), F.slice(a, 2, F.col("n") - 1), lambda x, y: f(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    letter = lambda x: (x == "v") | (x == "c")
    c = c.withColumn("changes", pairs("kinds", lambda x, y: x != y))
    c = c.withColumn("both", pairs("sounds", lambda x, y: letter(x) & letter(y))).withColumn("turns", pairs("sounds", lambda x, y: letter(x) & letter(y) & (x != y)))
    c = c.withColumn("steps", pairs("chars", lambda x, y: F.abs(F.ascii(x) - F.ascii(y)) <= 1))
    letters = F.regexp_count("body", F.lit("[A-Za-z]"))
    rare = F.regexp_count(F.lower("body"), F.lit(f"[{RARE_LETTERS}]"))
    runs = F.when(digits, _tail(F.col("changes"), F.col("n") - 1, HALVES, True)).when(~one, _tail(F.col("changes"), F.col("n") - 1, CHANGE, True))
    alphabet = F.when(letters > 0, _tail(rare, letters, RARE, True))
    serial = F.when(digits, _tail(F.col("steps"), F.col("n") - 1, STEPS, False)).when(F.col("both") > 0, _tail(F.col("turns"), F.col("both"), TURNS, False))
    tests = [runs, alphabet, serial]
    c = c.withColumn("x", -sum((F.coalesce(t, F.lit(0.0)) for t in tests), F.lit(0.0))).withColumn("tests", sum((t.isNotNull().cast("int") for t in tests), F.lit(0)))
    # the chance of so large a sum of that many logarithms
    more = F.log(1 + F.when(F.col("tests") > 1, F.col("x")).otherwise(0.0) + F.when(F.col("tests") > 2, F.col("x") * F.col("x") / 2).otherwise(0.0))
    c = c.withColumn("log10_p", F.least(F.lit(0.0), (more - F.col("x")) / F.log(F.lit(10.0))))
    # joined words with marks between them are no secret: a secret has symbols of two classes and mostly no marks
    return c.withColumn("random", (F.col("z_uniform") < REJECT_Z) & (F.col("z_serial") < REJECT_Z) & (F.length(F.regexp_replace("body", "[^+/_-]", "")) * 5 <= F.col("n"))).drop("chars", "v", "total", "square", "beside", "ends", "kinds", "sounds")


def _level(tested: DataFrame) -> DataFrame:
    """One row: the largest bin whose p Benjamini-Hochberg admits. Bins bound the rows of the window, not those of the documents."""
    bins = tested.groupBy(F.least(F.floor(-F.col("log10_p") * 100), F.lit(100 * POWERS)).alias("bin")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("bin").desc())
    counted = bins.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy()))
    admitted = F.pow(F.lit(10.0), -F.col("bin") / 100) <= FALSE_DISCOVERIES * F.col("rank") / F.col("m")
    return counted.agg(F.min(F.when(admitted, F.col("bin"))).alias("level"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array of kind, start, end, token).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Candidates of the battery (kind random) that meet a
    base span are left out. Null texts are empty, texts are taken whole, however long, and repeated rows each come back. An empty table gives
    an empty result.
    """
    rows = staged(_scanned(docs), "scanned")
    span = "array<struct<start:int,rank:int,kind:string,end:int,token:string>>"
    of_kind = lambda kind, i: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["token"].alias("token")))
    base = F.concat(*(of_kind(kind, i) for i, (kind, *_) in enumerate(PATTERNS)))
    base = F.array_sort(base.cast(span))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    rows = rows.withColumn("base", base)
    cand = rows.where(F.size("candidates") > 0).select("row_id", F.explode(F.filter("candidates", apart)).alias("c")).select("row_id", "c.*")
    tested = staged(_tested(cand).select("row_id", "start", "end", "token", "log10_p", "random"), "tested")
    level = _level(tested).first()[0]
    secret = tested.where("random").where(F.floor(-F.col("log10_p") * 100) >= F.lit(level))
    secret = secret.groupBy("row_id").agg(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("rank"), F.lit("random").alias("kind"), "end", "token")).alias("more"))
    out = rows.join(secret, "row_id", "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(span)))))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select(id_out("doc_id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"), "found")
