"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

Two words are as alike as the subsequences of three characters that they share, each weighed down by the gaps it spans; so an
insult with a character put in, or a new ending, stays near the insult. A sentence is its words' largest kernel value with each landmark;
the Nyström map whitens these by the landmarks' own kernel, and a linear machine learns on sentences of labelled documents: all of
clean ones, and of toxic ones the sentence that the machine itself holds for the most toxic. A document is its worst two sentences, whose
values a logistic scale turns into a chance: one likeness may be an accident, two are not.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import id_in, id_out, mix, ship, trimmed

#: Labelled documents of each class that the fit may take, and landmarks: from words that tell toxic documents, and common ones.
FIT_TOXIC, FIT_CLEAN = 1200, 2000
TELLING, COMMON = 64, 8
#: Sentences of a document that its score weighs.
WORST = 2
#: Kernel values below this count as none.
ALIKE = 0.4
#: Weight of a subsequence: DECAY to the power of the characters it spans, at most SPAN.
DECAY, SPAN = 0.8, 5
#: Words times landmarks that are multiplied at a time, and rows of sentences in a step of the machine: the task that fits the model has little memory.
PRODUCTS, STEP_ROWS = 20_000, 2048
#: Words that a task remembers, and words whose kernel values are worked out at a time.
CACHE_WORDS, STEP_WORDS = 100_000, 1024
#: Candidates for landmarks that are compared with all others at a time: the table of all of their subsequences would be the largest thing that the fit holds.
STEP_MARKS = 48
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPACED = re.compile(r"(?<!\S)(?:\w[ .*_-]){3,}\w(?!\S)")
_EDGE = ".,;:!?\"'()[]{}|*$%&#<>-_"
#: Marks of a word's ends, which no word holds after splitting at white space and controls.
_BEGIN, _END = "\x02", "\x03"
_BITS = 7
_WIDTH = 3 * _BITS + 1
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the characters of each word with its ends marked, and where words begin."""
    text = "".join(f"{_BEGIN}{w}{_END}" for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.cumsum([0] + [len(w) + 2 for w in words])


def _keys(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A number of 3 * _BITS + 1 bits for three characters: ASCII ones stand in it as they are; where others are among them, it is a hash of all three."""
    plain = x << np.uint64(2 * _BITS) | y << np.uint64(_BITS) | z
    wide = (x | y | z) >= 128
    if wide.any():
        hashed = mix((x[wide] << np.uint64(21) | y[wide]) * np.uint64(0x9E3779B97F4A7C15) + z[wide]) >> np.uint64(64 - 3 * _BITS)
        plain[wide] = hashed | np.uint64(1 << 3 * _BITS)
    return plain.astype(np.int64)


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), summed: sorted by word."""
    c, begin = _codes(words)
    word = np.repeat(np.arange(len(words)), np.diff(begin))
    keys, weights = [], []
    for a, b in _OFFSETS:
        n = len(c) - b
        if n <= 0:
            continue
        same = word[:n] == word[b:]
        key = word[:n][same] << _WIDTH | _keys(c[:n][same], c[a : a + n][same], c[b:][same])
        keys.append(key)
        weights.append(np.full(len(key), DECAY ** (b + 1)))
    if not keys:
        return (np.zeros(0, int),) * 2 + (np.zeros(0),)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(weight, first) if len(first) else weight
    return key[first] >> _WIDTH, key[first] & ((1 << _WIDTH) - 1), total


class Landmarks:
    """Normalised kernel values of words with some fixed words."""

    def __init__(self, words: list[str]):
        self.words = words
        w, u, x = _subsequences(words)
        norm = np.sqrt(np.bincount(w, x * x, len(words)))
        self.own = np.unique(u)
        self.weight = np.zeros((len(self.own), len(words)), np.float32)
        self.weight[np.searchsorted(self.own, u), w] = x / norm[w]
        self.most = self.weight.max(axis=1, initial=0)
        self._row = None

    def __getstate__(self):
        return self.__dict__ | {"_row": None}

    @property
    def row(self) -> np.ndarray:
        """The place of each subsequence among those of the landmarks, -1 for others; made anew where the landmarks arrive."""
        if self._row is None:
            self._row = np.full(1 << _WIDTH, -1, np.int16 if len(self.own) < 1 << 15 else np.int32)
            self._row[self.own] = np.arange(len(self.own))
        return self._row

    def __call__(self, words: list[str], least: float = 0.0) -> np.ndarray:
        """Words by landmarks. Words that can't reach `least` with any, by the sum of each subsequence's largest share, stay zero."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        step = max(1, PRODUCTS // max(1, len(self.words)))
        for i in range(0, len(words), STEP_WORDS):
            some = words[i : i + STEP_WORDS]
            w, u, x = _subsequences(some)
            norm = np.sqrt(np.bincount(w, x * x, len(some)))
            row = self.row[u]
            known = row >= 0
            w, row, x = w[known], row[known], (x[known] / norm[w[known]]).astype(np.float32)
            if least > 0 and len(w):
                may = np.bincount(w, x * self.most[row], len(some))[w] >= least
                w, row, x = w[may], row[may], x[may]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            for j in range(0, len(first), step):  # the products of a few words at a time
                some = first[j : j + step]
                a, z = some[0], first[j + step] if j + step < len(first) else len(w)
                out[i + w[some]] = np.add.reduceat(self.weight[row[a:z]] * x[a:z, None], some - a, axis=0)
        return out


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case; letters set apart by single marks are words too."""
    low = text.lower()
    out = [s.split() for s in _SENTENCE.split(low)]
    if apart := ["".join(c for c in m if c.isalnum()) for m in _SPACED.findall(low)]:
        out.append(apart)
    return [s for s in out if s]


def plain(word: str) -> str:
    return word.strip(_EDGE)


def _numbered(text: str, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's words, those of new words added, and how many words each sentence has."""
    some = sentences(text)
    return np.fromiter((numbers.setdefault(plain(w), len(numbers)) for s in some for w in s), np.int32), np.array([len(s) for s in some], np.int32)


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge machine with a free offset; y in -1, 1; Newton steps on the active rows."""
    reg = np.eye(x.shape[1] + 1) * ridge
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1] + 1)
    for _ in range(30):
        on = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        left, right = reg.copy(), np.zeros(len(w))
        for i in range(0, len(on), STEP_ROWS):
            some = on[i : i + STEP_ROWS]
            rows = np.hstack([x[some], np.ones((len(some), 1))])
            a = rows * cost[some, None]
            left += a.T @ rows
            right += a.T @ y[some]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(f: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Platt's scale: p = 1 / (1 + exp(-(f a + b))), targets pulled in from 0 and 1, a ridge on a; a and then b."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([f, np.ones(len(f))])
    v = np.zeros(x.shape[1])
    ridge = np.append(np.full(f.shape[1], 1e-3), 0)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (cost * (p - t)) + ridge * v
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, g)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return v


class Model:
    """Fitted on texts and labels (1 toxic); weights tell how many documents of the corpus a text of each class stands for."""

    def __init__(self, texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)):
        y = np.array(labels)
        self.rate = float((y * weights[1]).sum() / max(1e-9, ((1 - y) * weights[0] + y * weights[1]).sum())) if len(y) else 0.0
        self.marks = None
        numbers: dict[str, int] = {}  # each word is held once; of documents only their numbers are
        docs = [_numbered(t, numbers) for t in texts]
        held_by = np.zeros((2, len(numbers)), int)
        for (d, _), label in zip(docs, labels):
            held_by[label, np.unique(d)] += 1
        count = [{w: n for w, n in zip(numbers, by.tolist()) if n and 2 < len(w) <= 40} for by in held_by]
        n1, n0 = int(y.sum()), int(len(y) - y.sum())
        if not n1 or not n0:
            return
        gain = {w: c * np.log((c + 0.1) / (n1 + 1) * (n0 + 1) / (count[0].get(w, 0) + 0.1)) for w, c in count[1].items() if c > 1 or n1 < 50}
        best = sorted((w for w in gain if gain[w] > 0), key=lambda w: (-gain[w], w))[: 12 * TELLING]
        telling, held = [], None
        alike = np.hstack([Landmarks(best[i : i + STEP_MARKS])(best) for i in range(0, len(best), STEP_MARKS)]) if best else None
        for i in range(len(best)):  # the most telling that are not near one taken already
            if len(telling) < TELLING and (held is None or held[i] < 0.75):
                telling.append(i)
                held = alike[:, i] if held is None else np.maximum(held, alike[:, i])
        common = sorted(count[0], key=lambda w: (-count[0][w], w))[:COMMON]
        words = [best[i] for i in telling] + [w for w in common if w not in set(best)]
        if not telling:
            return
        self.marks = Landmarks(words)
        value, vector = np.linalg.eigh(self.marks(words).astype(float))
        self.white = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(words)), np.float32)
        self.weight = np.zeros(len(words) + 1)
        pooled = self._pooled_numbers(docs, list(numbers))
        del docs, numbers, count, held_by
        seed = np.array([gain[w] if i < len(telling) else 0.0 for i, w in enumerate(words)])
        clean = [p for p, label in zip(pooled, labels) if not label]
        n = sum(map(len, clean))
        x = np.zeros((n + n1, len(words)))
        np.concatenate(clean, out=x[:n])
        for i in range(0, n, STEP_ROWS):
            x[i : min(n, i + STEP_ROWS)] = x[i : min(n, i + STEP_ROWS)] @ self.white
        side = np.concatenate([-np.ones(n), np.ones(n1)])
        for turn in range(4):
            worst = [p[np.argmax((p * (p >= 0.7)) @ seed if not turn else p @ self.weight[:-1])] for p, label in zip(pooled, labels) if label]
            x[n:] = np.array(worst) @ self.white
            w = _newton(x, side, np.where(side > 0, n / n1, 1.0) / n * 2000)
            self.weight = np.append(self.white @ w[:-1], w[-1])
        f = np.array([self._worst(p) for p in pooled])
        self.scale = _logistic(f, y, np.where(y > 0, weights[1], weights[0]) * len(y) / np.where(y > 0, weights[1], weights[0]).sum())
        self.forget()

    def _learn(self, words: set[str]) -> None:
        """From now on self.known tells the row of self.values that each word has, -1 for those like no landmark."""
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.values = {}, self.values[:0]
            new = list(words)
        rows = [self.values]
        at = len(self.values)
        for i in range(0, len(new), 8 * STEP_WORDS):
            some = new[i : i + 8 * STEP_WORDS]
            place: dict[str, int] = {}
            form = [place.setdefault(plain(w), len(place)) for w in some]
            k = self.marks(list(place), ALIKE)
            near = np.flatnonzero(k.max(axis=1) >= ALIKE)
            index = np.full(len(place), -1)
            index[near] = np.arange(at, at + len(near))
            at += len(near)
            rows.append(np.where(k[near] >= ALIKE, k[near], 0).astype(np.float32))
            self.known.update(zip(some, index[form].tolist()))
        if new:
            self.values = np.concatenate(rows)

    def _indexed(self, docs: list[list[list[str]]]) -> list[list[list[int]]]:
        """Words as rows of self.values, those like no landmark left out."""
        self._learn({w for d in docs for s in d for w in s})
        get = self.known.__getitem__
        return [[[i for i in map(get, s) if i >= 0] for s in d] for d in docs]

    def _pooled(self, doc: list[list[int]]) -> np.ndarray:
        """Sentences by landmarks; one empty sentence stands for those that are like none."""
        some = [s for s in doc if s]
        return self._largest(np.concatenate(some) if some else (), np.cumsum([0] + [len(s) for s in some[:-1]]) if some else ())

    def _pooled_numbers(self, docs: list[tuple[np.ndarray, np.ndarray]], words: list[str]) -> list[np.ndarray]:
        """_pooled() of documents whose words are numbers, places in `words`."""
        self._learn(set(words))
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.known = {}
        out = []
        for numbers, sizes in docs:
            rows = row[numbers]
            near = rows >= 0
            sentence = np.repeat(np.arange(len(sizes)), sizes)[near]
            out.append(self._largest(rows[near], np.flatnonzero(np.diff(sentence, prepend=-1))))
        return out

    def _largest(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of rows of self.values, an empty sentence, and the largest values in each that begins at a place of `first`."""
        out = np.zeros((len(first) + 1, self.values.shape[1]), np.float32)
        if len(first):
            out[1:] = np.maximum.reduceat(self.values[rows], first, axis=0)
        return out

    def _worst(self, pooled: np.ndarray) -> np.ndarray:
        """The values of the most toxic sentences, as many as WORST; sentences that are like no landmark fill up."""
        value = pooled @ self.weight[:-1] + self.weight[-1]
        return np.append(np.sort(value)[::-1], np.full(WORST, self.weight[-1]))[:WORST]

    def forget(self) -> None:
        """Drop remembered words: workers outlive a task, and later stages need the memory."""
        if self.marks is not None:
            self.known, self.values = {}, self.values[:0].copy()

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.marks is None:
            return np.full(len(texts), self.rate)
        *a, b = self.scale
        f = np.array([self._worst(self._pooled(d)) for d in self._indexed([sentences(t) for t in texts])])
        return 1 / (1 + np.exp(-np.clip(f @ np.array(a) + b, -50, 50)))


def _fitted(batches, weights: tuple[float, float]):
    """doc_id, text, toxic of the documents drawn to one row, the pickled model."""
    rows = sorted((r for b in batches for r in zip(b["doc_id"], b["text"], b["toxic"])), key=lambda r: r[0])
    if rows:
        yield pd.DataFrame({"model": [pickle.dumps(Model([r[1] for r in rows], [int(r[2]) for r in rows], weights))]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most FIT_TOXIC and FIT_CLEAN labelled documents that are not held out, drawn by a hash of their ids.

    One task fits it; the driver gets the model alone, and no text.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    picked, weights = [], []
    for y, most in ((0, FIT_CLEAN), (1, FIT_TOXIC)):
        some = ids.where(F.col("toxic") == y)
        rows = some.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most).collect()
        weights.append(some.count() / max(1, len(rows)))
        picked += [(r.doc_id, y) for r in rows]
    if not picked:
        return Model([], [])
    ids, toxic = zip(*picked)
    few = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(toxic, pa.int32())})))  # FIT_TOXIC + FIT_CLEAN rows at most; from Arrow: rows would start Python workers of another kind beside those of the operators
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # of rows that share an id the first text by code point, so that reruns agree
    rows = slim.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    fitted = rows.repartition(1).mapInPandas(lambda b: trimmed(_fitted(b, (weights[0], weights[1]))), "model binary").first()
    return pickle.loads(fitted.model) if fitted else Model([], [])


def _scored(model) -> Column:
    """The score of column text under a broadcast model: the text alone goes to Python, and one number comes back."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        try:
            yield from trimmed(pd.Series(np.concatenate([m.scores(b.iloc[i : i + 250].tolist()) for i in range(0, len(b), 250)] or [np.zeros(0)])) for b in batches)
        finally:
            m.forget()

    return score(F.coalesce(F.col("text").cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Scores come from the text alone, by whole texts, however long.

    An empty table gives an empty result. Null and empty texts score like a text that is like no landmark. Without labels of both classes every score is the rate of toxic
    labels (0 without any). Repeated rows each come back; a null doc_id is never held out.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded by the landmarks
    rows = docs.select(id_in("doc_id").alias("doc_id"), _scored(model).alias("score"))
    out = rows.withColumn("doc_id", id_out("doc_id"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model of toxicity() does not hold for toxic, with all their columns.

    Null and empty texts, and rows of a null doc_id, are scored like any other; repeated rows each stay or go; very long texts are scored whole. An empty table is
    empty, and without labels of both kinds nothing is toxic.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.where(_scored(model) < 0.5)
