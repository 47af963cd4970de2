"""Token-ID output: documents become ids, Simple-8b words and blocks, written in ascending doc_id order and read back.

The format is a folder of Parquet files whose rows are blocks: whole documents, at least BLOCK_IDS ids of them where there are
so many, with the ids and the place of each document in the payload; a document's ids start a new word, so that each can be decoded alone.
"""

from __future__ import annotations

import os
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import id_out, partitions, shared_dir, ship, staged, texts, trimmed
from skyloom.llm.simple8b import decode, encode_many

END_ID = 1
BLOCK_IDS = 65_536
#: Words whose ids a worker remembers: those of late, and as many before them. About 100 bytes each.
CACHE_WORDS = 600_000
#: What str.split takes for white space and the tokenizer does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[ \t\n\v\f\r]+")
_AS_IT_IS = re.compile("[Σİ\u0300-\u036f]")
#: Marks after a word of letters that the tokenizer makes pieces of their own.
_MARKS = ".,;:!?|*$%&#)]}"
#: What a tokenizer is probed with: letters that change their number, marks, joiners, digits, contractions, special tokens, white space of all kinds.
ODD_WORDS = ["the", "Words", "İ", "ı", "Σ", "σς", "ΑΣ", "ß", "ẞ", "é", "e\u0301", "\u0301", "\u0307", "H", "T", "\u0331", "\u033b", "ǆ", "ﬁ", "Å", "가", "각", "\u1100\u1161", "日本", "ไทย", "हिन्दी", "😀", "\u200d", "\u00ad", "\ufeff", "'s", "don't", "'LL", "1", "23", "½", "²", ",", "...", "!?", "|", ")", "<|endoftext|>", "<|", "|>", "</w>", "_", "-", "a-b", "\x00", "\x7f", "\ue000", "\U0001d400", "ⓐ", "ª", "ᾳ", "ŉ"]
ODD_SPACES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", " \u0301"]
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """encode(text, add_special_tokens=False) of a tokenizer that drops white space and never joins pieces across it, word by word.

    White space ends pieces before any merge, so the ids of a text are those of its words in turn. Words repeat, and are
    remembered; new ones are encoded many at a time. A tokenizer that fails a probe of this gets every text whole.
    """

    def __init__(self, path: str, cache_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters: set[str] = set()  # those that stay letters
        self.by_word = self._probed()

    def _letters(self, core: str) -> bool:
        """Whether a word of letters is one to the tokenizer too: what it makes of some letters holds marks, which cut or join what follows."""
        if self.letters.issuperset(core):
            return True
        normalizer = self.tokenizer.normalizer
        for c in set(core).difference(self.letters):
            low = normalizer.normalize_str(c) if normalizer else c
            if not low.isalpha():
                return False
            self.letters.add(c)
        return True

    def _probed(self) -> bool:
        """Whether this tokenizer does work word by word, as far as odd words can show: alone, joined, and in texts."""
        rnd = random.Random(1)
        words = ODD_WORDS + ["".join(rnd.choice(ODD_WORDS) for _ in range(rnd.randrange(2, 5))) for _ in range(400)]
        whole = words + ["".join(rnd.choice(words) + rnd.choice(ODD_SPACES) for _ in range(rnd.randrange(2, 12))) for _ in range(400)]
        try:
            return all(got.tobytes() == self._plain(t) for t, got in zip(whole, self._by_word(whole)))
        finally:
            self.known, self.older = {}, {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _add_letters(self, cores: list[str]) -> None:
        chunks = [cores[i : i + 500] for i in range(0, len(cores), 500)]
        for i in range(0, len(chunks), 20):
            coded = self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks[i : i + 20]], add_special_tokens=False)
            for some, e in zip(chunks[i : i + 20], coded):
                ids = np.array(e.ids, self.kind)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(some) and cut[-1] == len(ids):
                    raw, at = ids.tobytes(), 0
                    for w, z in zip(some, (cut * ids.itemsize).tolist()):
                        self.known[w] = raw[at:z]
                        at = z
                else:
                    self.known.update((w, self._plain(w)) for w in some)

    def _add(self, words: set[str]) -> None:
        """A word of letters and the marks after it are pieces apart; all other words go to the tokenizer whole."""
        known, letters, marked = self.known, set(), []
        for w in words:
            core = w.rstrip(_MARKS)
            if not (core.isalpha() and (core.isascii() or self._letters(core))):
                known[w] = self._plain(w)
                continue
            if core not in known:
                letters.add(core)
            if len(core) < len(w):
                marked.append(w)
        self._add_letters(list(letters))
        for w in marked:
            core = w.rstrip(_MARKS)
            marks = w[len(core) :]
            if marks not in known:
                known[marks] = self._plain(marks)
            known[w] = known[core] + known[marks]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._by_word(texts)

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        # the tokenizer lowers each character by itself, after it has joined marks to letters: str.lower does the same but for sigma at an end and
        # what marks join; special tokens are told by their case
        low = [t.lower() if "<|" not in t and (t.isascii() or not _AS_IT_IS.search(t)) else t for t in texts]
        split = [[w for w in _SPACE.split(t) if w] if any(c in t for c in _NO_SPACE) else t.split() for t in low]
        if len(self.known) > self.cache_words:  # words that come again move over from the older ones; the rest of those go
            self.known, self.older = {}, self.known
        # not the view of the keys: a set less a dict costs what the set holds
        new = set().union(*(set(words).difference(self.known) for words in split))
        if new and self.older:
            again = {w: self.older[w] for w in new if w in self.older}  # not their intersection, which goes through all of the older ones
            self.known.update(again)
            new.difference_update(again)
        if new:
            self._add(new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), self.kind) for words in split]


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, cache_words)
    _encoders[path].cache_words = cache_words
    return _encoders[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])


def _encode(batches, path: str, end_id: int, cache_words: int = CACHE_WORDS):
    get = encoder(path, cache_words)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            parts = get(some["text"].to_pylist())
            n = np.array([len(p) for p in parts]) + 1
            ids = np.full(n.sum(), end_id, np.uint64)
            last = np.cumsum(n) - 1
            inner = np.ones(len(ids), bool)
            inner[last] = False
            ids[inner] = np.concatenate(parts)
            words, sizes = encode_many(ids, n)
            raw, cut = words.tobytes(), (8 * np.concatenate(([0], np.cumsum(sizes)))).tolist()
            payload = [raw[a:z] for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([some["doc_id"], some["bucket"], pa.array(n, pa.int64()), pa.array(payload, pa.binary())], schema=_ENCODED)


_BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
_BLOCK_DDL = "bucket int, block long, n_ids long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def _blocks(batches):
    """Rows sorted by bucket and doc_id: blocks, numbered within their bucket."""
    at, number, total, held = None, 0, 0, []

    def block():
        ids, n, payload = zip(*held)
        size = np.array([len(p) // 8 for p in payload])
        return pa.RecordBatch.from_pylist([{"bucket": at, "block": number, "n_ids": sum(n), "doc_ids": ids, "counts": n, "offsets": (np.cumsum(size) - size).tolist(), "payload": b"".join(payload)}], _BLOCK)

    for batch in batches:
        for bucket, d, n, payload in zip(batch["bucket"].to_pylist(), batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["payload"].to_pylist()):
            if held and (bucket != at or total >= BLOCK_IDS):
                yield block()
                number, held = number + 1, []
            if bucket != at:
                at, number = bucket, 0
            total = (total if held else 0) + n
            held.append((d, n, payload))
    if held:
        yield block()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write the blocks of all documents to path, ascending by doc_id, and return them read back."""
    rows = texts(docs)
    n = partitions(docs.sparkSession)
    cut = F.percentile_approx("doc_id", F.array(*(F.lit(i / n) for i in range(1, n))), 10 * n) if n > 1 else F.array().cast("array<long>")
    cuts = rows.agg(cut.alias("cuts")).first()[0] or []  # one value for each partition
    if cuts:
        rows = rows.withColumn("bucket", F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col("doc_id"))))
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    coded = rows.mapInArrow(lambda b: trimmed(_encode(b, tokenizer, end_id, cache_words)), "doc_id long, bucket int, n long, payload binary")
    dealt = coded.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "n")
    return staged(dealt.mapInArrow(lambda b: trimmed(_blocks(b)), _BLOCK_DDL), "blocks", path)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["payload"], np.uint64)
            ids = decode(words).astype("<u4")
            z = np.cumsum(row["counts"])
            a = z - row["counts"]
            yield _documents(row, a, [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), z.tolist())])


def _documents(row: dict, a: np.ndarray, crc: list[int]) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(a, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())], names=["bucket", "block", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document in the blocks."""
    docs = blocks.mapInArrow(lambda b: trimmed(_read(b)), "bucket int, block long, doc_id long, within long, n_tokens long, ids_crc32 long")
    index = blocks.select("bucket", "block", "n_ids")
    # two steps: sums by bucket, of which there are as many as partitions, then blocks within their bucket
    whole = index.groupBy("bucket").agg(F.sum("n_ids").alias("ids")).select("bucket", (F.sum("ids").over(Window.orderBy("bucket")) - F.col("ids")).alias("before"))
    starts = index.select("bucket", "block", (F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("block")) - F.col("n_ids")).alias("inside"))
    starts = starts.join(whole, "bucket").select("bucket", "block", (F.col("before") + F.col("inside")).alias("first"))
    return docs.join(starts, ["bucket", "block"]).select(id_out("doc_id").alias("doc_id"), (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write docs and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts are the end id alone. A null doc_id comes first. Repeated rows each are written, beside each other.
    Texts are taken whole, however long. An empty table writes no block. cache_words: words that a Python worker remembers, twice over.
    """
    spark = docs.sparkSession
    ship(spark)
    return read_tokens(write_tokens(docs, path or f"{shared_dir(spark)}/skyloom-{uuid.uuid4().hex}/tokens", tokenizer, end_id, cache_words))
