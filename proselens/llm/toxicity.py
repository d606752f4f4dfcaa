"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Units are words, with a mark in front and without punctuation (so b.a.d is bad), runs of single letters joined, common digit
look-alikes as letters; letters beyond Latin script stand for themselves by a hash to an alphabet of 26. The kernel of two strings counts their shared subsequences of three letters,
each weighed by DECAY to the power of the length it spans, and is normalised; an inserted character
costs a part of it only. A unit is as like a landmark as its best window of 5 to 7 letters is, so that
inflected stems count. A sentence is represented by its best likeness to each landmark, mapped by the
inverse root of the landmarks' own kernel (Nystroem), and a linear support vector machine with squared
hinge loss separates sentences of toxic documents from those of clean ones: of a toxic document the
sentence nearest to the toxic landmarks, of a clean one the nearest five. Toxic documents without any
sentence on the toxic side are set aside as label noise, and their share is kept as a floor. A
document's margin is its highest sentence's; a logistic curve, fitted on documents and weighed to the
labels' own shares, makes it a probability.

Learning takes at most TRAIN_DOCS labelled documents of either label, the first by hash of doc_id; the
landmarks, sentences and curve come from these alone. Scoring reads every text whole, keeps kernels of
units in a table of fixed size, and needs no shuffle.

Defined results: null, empty and wordless texts score as a sentence without any likeness; null labels
are left out; a doc_id with several labels counts as toxic if one says so; without labels of both kinds
every score is the share of toxic ones (0 if none); rows with a null doc_id are scored, not held out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import text_batches, written
from proselens.llm.textkit import SPACES, Texts, slices

#: What a sentence of a toxic and of a clean document costs on the wrong side.
COSTS = (6.0, 4.0)

#: Letters inserted into toxic landmarks to make examples, and what such a one costs to a real one.
INSERTED, INSERTED_COST = "xou", 0.5

#: Rounds of learning; after each, toxic documents without a sentence on the toxic side are set aside as label noise.
ROUNDS = 5

#: The bound on what is learnt from: labelled documents of each label.
TRAIN_DOCS = 4000

#: Bytes of text taken at once; small, as arrays of windows are many times larger.
SLICE = 1 << 19

DECAY = 0.6
SPAN = 8  # letters that a subsequence spans at most
WINDOWS = (5, 6, 7)  # letters of the windows of a unit; the mark in front of a unit is one; a unit of LEAST is its own window
LEAST = 4
FLOOR = 0.5  # similarities below count as none
THRESHOLD = 0.3

TOXIC_LANDMARKS, CLEAN_LANDMARKS = 48, 16

_CACHE, _ROWS = 1 << 20, 1 << 15

#: Letters 1-26, look-alike digits as letters, 27 for accented Latin letters (below U+0180); a letter beyond is one of 1-26 by a hash of its code point; 0 between units, 255 for what is left out.
_CODE = np.full(256, 255, np.uint8)
_CODE[SPACES] = 0
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:] = 27
for _digit, _letter in zip("0134579", "oieastg", strict=True):
    _CODE[ord(_digit)] = ord(_letter) - 96
_CODE[[ord("2"), ord("6"), ord("8")]] = 27
_MARK = 28  # in front of each unit
_BETWEEN = np.zeros(256, bool)
_BETWEEN[0] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?")]] = True


def _hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A letter code for each character of two bytes or more that begins at these places."""
    point, more = data[at].astype(np.uint32), np.ones(at.size, bool)
    for k in range(1, 4):
        byte = data[np.minimum(at + k, data.size - 1)]
        more &= (at + k < data.size) & (byte >= 0x80) & (byte < 0xC0)
        point = np.where(more, point << np.uint32(6) ^ byte, point)
    return (1 + ((point * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(26)).astype(np.uint8)


class _Coded:
    """Units of several texts: starts and ends in codes, the sentence of each, and the text of each sentence."""

    def __init__(self, column: pa.Array):
        texts = Texts(column, lower=True)
        data, off = texts.data, texts.offsets
        stop = _ENDS[data]
        if data.size:
            stop[:-1] &= SPACES[data[1:]]
        stop |= data == 0x0A
        sentence = np.concatenate(([0], np.cumsum(stop)))[:-1] if data.size else np.zeros(0, np.int64)
        codes = _CODE[data]
        wide = np.flatnonzero(data >= 0xC6)
        if wide.size:
            codes[wide] = _hashed(data, wide)
        keep = codes != 255
        at = np.concatenate(([0], np.cumsum(keep)))
        self.codes, bounds = codes[keep], at[off]
        sentence = sentence[keep]
        coded = Texts.__new__(Texts)
        coded.data, coded.offsets = self.codes, bounds
        starts, ends, first = coded.spans(_BETWEEN)
        single = ends - starts == 1
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        joins = np.flatnonzero(single[1:] & single[:-1] & (text[1:] == text[:-1])) if starts.size > 1 else np.zeros(0, np.int64)
        if joins.size:  # letters one by one are one unit
            drop = np.zeros(self.codes.size + 1, np.int64)
            np.add.at(drop, ends[joins], 1)
            np.add.at(drop, starts[joins + 1], -1)
            keep = np.cumsum(drop[:-1]) == 0
            at = np.concatenate(([0], np.cumsum(keep)))
            self.codes, bounds, sentence = self.codes[keep], at[bounds], sentence[keep]
            coded.data, coded.offsets = self.codes, bounds
            starts, ends, first = coded.spans(_BETWEEN)
            text = np.repeat(np.arange(len(texts)), np.diff(first))
        # units one after another, each with a mark in front
        sizes = ends - starts + 1
        begin = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), _MARK, np.uint8)
        letters = np.ones(flat.size, bool)
        letters[begin] = False
        flat[letters] = self.codes[self.codes != 0]
        some = sizes >= LEAST
        self.sentence = sentence[starts[some]] if starts.size else np.zeros(0, np.int64)
        self.starts, self.ends, self.text, self.codes = begin[some], (begin + sizes)[some], text[some], flat
        coded.data = flat
        self.hashes = coded.hashes(self.starts, self.ends)
        self.n_texts = len(texts)

    def grams(self, n: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All runs of n letters in some units: each as a number of 5 bits a letter, and which unit it is in."""
        count = np.maximum(self.ends[units] - self.starts[units] - n + 1, 0)
        owner = np.repeat(np.arange(units.size), count)
        begin = self.starts[units][owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        number = np.zeros(begin.size, np.int64)
        for k in range(n):
            number = number << 5 | self.codes[begin + k]
        return number, owner


def _letters(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(numbers >> 5 * (n - 1 - k)) & 31 for k in range(n)], axis=1).astype(np.uint8)


def _spelled(number: int) -> str:
    out = ""
    while number:
        out, number = chr(96 + (number & 31)) + out, number >> 5
    return out


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    own = [t for t in itertools.combinations(range(length), 3) if t[2] - t[0] < SPAN]
    return np.array(own, np.int64).reshape(-1, 3), np.array([DECAY ** (t[2] - t[0] + 1) for t in own], np.float32)


_TRIPLES = {n: _triples(n) for n in range(3, 13)}


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units of one length (a row each): the numbers of their three-letter subsequences and these' weights."""
    at, weight = _TRIPLES[codes.shape[1]]
    wide = codes.astype(np.int32)
    return (wide[:, at[:, 0]] << 10) | (wide[:, at[:, 1]] << 5) | wide[:, at[:, 2]], weight


def _norms(seen: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Root of each unit's kernel with itself."""
    order = np.argsort(seen, axis=1)
    own = np.take_along_axis(seen, order, 1)
    new = np.ones(own.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    sums = np.bincount(np.cumsum(new.ravel()) - 1, weight[order].ravel())
    return np.sqrt(np.bincount(np.repeat(np.arange(len(seen)), new.sum(1)), sums**2, len(seen)))


@dataclass
class Landmarks:
    """Strings with which units are compared."""

    strings: list[str]
    n_toxic: int
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.zeros((1 << 15, len(self.strings)), np.float32)
        for j, s in enumerate(self.strings):
            seen, weight = _subsequences(np.array([[ord(c) - 96 for c in s]], np.uint8))
            np.add.at(self.table[:, j], seen[0], weight / _norms(seen, weight)[0])
        self.used = self.table.any(axis=1)
        self.hashes = np.zeros(_CACHE, np.uint64)
        self.slots = np.full(_CACHE, -1, np.int32)
        self.rows, self.n_rows = np.zeros((4096, len(self.strings)), np.float32), 0

    def compare(self, codes: np.ndarray) -> np.ndarray:
        """Kernels of units of one length with all landmarks, 0 below the floor."""
        out = np.zeros((len(codes), len(self.strings)), np.float32)
        seen, weight = _subsequences(codes)
        hit = self.used[seen]
        # the norm is at least the root of the sum of squared weights, so few units can reach the floor
        maybe = np.flatnonzero(hit @ weight > 0)
        for lo in range(0, maybe.size, 4096):
            rows = maybe[lo : lo + 4096]
            raw = np.zeros((rows.size, len(self.strings)), np.float32)
            for c, w in enumerate(weight):
                own = np.flatnonzero(hit[rows, c])
                raw[own] += self.table[seen[rows[own], c]] * w
            near = np.flatnonzero(raw.max(axis=1, initial=0) >= FLOOR * np.sqrt((weight**2).sum()))
            if near.size:
                kernel = raw[near] / _norms(seen[rows[near]], weight)[:, None]
                out[rows[near]] = np.where(kernel >= FLOOR, kernel, 0)
        return out

    def known(self, coded: _Coded) -> np.ndarray:
        """For each unit the row of self.rows with its kernels, or -1 where it is like no toxic landmark."""
        if self.n_rows > _ROWS:
            self.rows, self.n_rows = self.rows[:4096].copy(), 0
            self.hashes[:] = 0
        unique, first, inverse = np.unique(coded.hashes, return_index=True, return_inverse=True)
        at = (unique & np.uint64(_CACHE - 1)).astype(np.int64)
        slot = np.where(self.hashes[at] == unique, self.slots[at], -2)
        new = np.flatnonzero(slot == -2)
        units = first[new]
        likeness: dict[int, np.ndarray] = {}
        exact = coded.ends[units] - coded.starts[units] == LEAST
        for n, which in ((LEAST, np.flatnonzero(exact)), *((n, np.flatnonzero(~exact)) for n in WINDOWS)):
            number, owner = coded.grams(n, units[which])
            kinds, place = np.unique(number, return_inverse=True)
            kernels = np.concatenate([self.compare(_letters(kinds[lo : lo + 8192], n)) for lo in range(0, kinds.size, 8192)] or [np.zeros((0, len(self.strings)), np.float32)])
            like = kernels[:, : self.n_toxic].any(axis=1)
            for i in np.flatnonzero(like[place]).tolist():
                unit = int(which[owner[i]])
                row = kernels[place[i]]
                likeness[unit] = np.maximum(likeness[unit], row) if unit in likeness else row
        slot[new] = -1
        for unit, row in likeness.items():
            if self.n_rows == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            slot[new[unit]] = self.n_rows
            self.rows[self.n_rows] = row
            self.n_rows += 1
        self.hashes[at[new]], self.slots[at[new]] = unique[new], slot[new]
        return slot[inverse]

    def sentences(self, coded: _Coded) -> tuple[np.ndarray, np.ndarray]:
        """Texts and landmark similarities of the sentences that have any."""
        slot = self.known(coded)
        like = np.flatnonzero(slot >= 0)
        if not like.size:
            return np.zeros(0, np.int64), np.zeros((0, len(self.strings)), np.float32)
        text, sentence = coded.text[like], coded.sentence[like]
        begin = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1]))))
        return text[begin], np.maximum.reduceat(self.rows[slot[like]], begin)


@dataclass
class Model:
    strings: list[str]
    n_toxic: int
    weights: np.ndarray  # of landmark similarities, the Nystroem map included
    bias: float
    slope: float
    shift: float
    floor: float = 0.0  # the share of documents whose label says toxic with nothing in the text for it

    def scores(self, landmarks: Landmarks, coded: _Coded) -> np.ndarray:
        margin = np.full(coded.n_texts, self.bias)
        if self.strings:
            text, like = landmarks.sentences(coded)
            np.maximum.at(margin, text, like @ self.weights + self.bias)
        return self.floor + (1 - self.floor) / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of toxic and of clean documents with each window of letters, in parts."""
    for batch in slices(batches, "text", SLICE):
        coded, toxic = _Coded(batch.column(1)), np.asarray(batch.column(0)).astype(bool)
        everything = np.arange(coded.starts.size)
        for n in WINDOWS:
            number, owner = coded.grams(n, everything)
            text = coded.text[owner]
            order = np.lexsort((text, number))
            number, text = number[order], text[order]
            new = np.ones(number.size, bool)
            new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
            number, bad = number[new], toxic[text[new]]
            kinds, place = np.unique(number, return_inverse=True)
            n_bad = np.bincount(place, bad, kinds.size).astype(np.int64)
            n_all = np.bincount(place, minlength=kinds.size)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(n_bad, pa.int64()), pa.array(n_all - n_bad, pa.int64())], names=["gram", "bad", "good"])


def _near(a: str, b: str) -> bool:
    """Whether two strings share all letters but one of the shorter, in a row."""
    a, b = sorted((a, b), key=len)
    n = max(len(a) - 1, 3)
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


def _spread(found: list[str], most: int, taken: list[str]) -> list[str]:
    out: list[str] = []
    for s in found:
        if len(out) < most and not any(_near(s, t) for t in (*taken, *out)):
            out.append(s)
    return out


def _choose(sample: DataFrame, n_bad: int, n_good: int) -> tuple[list[str], int]:
    """Landmarks: runs of letters by log-likelihood ratio for the toxic label, then the commonest of clean documents."""
    counts = written(sample.select("toxic", "text").mapInArrow(_stats, "gram long, bad long, good long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "grams")
    share = n_bad / (n_bad + n_good)
    both = F.col("bad") + F.col("good")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    ratio = 2 * (term(F.col("bad"), both * share) + term(F.col("good"), both * (1 - share)))
    # the longest of equals comes first; 3000 candidates are the driver's bound
    toxic = counts.filter((F.col("bad") > both * share) & (both >= 3)).select("gram", F.round(ratio, 6).alias("ratio")).orderBy(F.desc("ratio"), F.desc("gram")).limit(3000).collect()
    strong = [r.gram for r in toxic if r.ratio >= 24] or [r.gram for r in toxic[:8]]
    bad = _spread([_spelled(g) for g in strong], TOXIC_LANDMARKS, [])
    clean = counts.orderBy(F.desc("good"), F.desc("gram")).limit(1000).collect()
    return bad + _spread([_spelled(r.gram) for r in clean], CLEAN_LANDMARKS, bad), len(bad)


def _instances(strings: list[str], n_toxic: int):
    """Per document the five sentences most like a toxic landmark; one without likeness where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = Landmarks(strings, n_toxic)
        for batch in slices(batches, "text", SLICE):
            label = np.asarray(batch.column(0))
            text, like = landmarks.sentences(_Coded(batch.column(1)))
            order = np.lexsort((-like[:, :n_toxic].max(axis=1, initial=0), text))
            text, like = text[order], like[order]
            rank = np.arange(text.size) - np.searchsorted(text, text)
            text, like = text[rank < 5], like[rank < 5]
            none = np.setdiff1d(np.arange(label.size), text)
            owner = np.concatenate((text, none))
            rows = np.concatenate((like, np.zeros((none.size, len(strings)), np.float32)))
            place = np.concatenate((rank[rank < 5], np.zeros(none.size, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(label[owner], pa.int32()), pa.array(place, pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float32()))], names=["toxic", "place", "likeness"])

    return run


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine, squared hinge loss, by Newton steps. y: -1 or 1."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x1.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(50):
        active = y * (x1 @ w) < 1
        xa, ya, sa = x1[active], y[active], 2 * c * weight[active]
        gradient = ridge * w - xa.T @ (sa * (ya - xa @ w))
        if np.abs(gradient).max() < 1e-6:
            break
        w -= np.linalg.solve(np.diag(ridge) + xa.T @ (sa[:, None] * xa), gradient)
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels (0 or 1) over margins; smoothed as if of a few more documents."""
    bad, good = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (bad + 1) / (bad + 2), 1 / (good + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack((margin, np.ones_like(margin)), 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ ((weight * np.maximum(p * (1 - p), 1e-6))[:, None] * x) + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * theta)
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def learn(like: np.ndarray, y: np.ndarray, place: np.ndarray, prior: np.ndarray, strings: list[str], n_toxic: int) -> Model:
    """The model from sentences: their likeness to landmarks, label, rank within the document, and what a document counts for."""
    landmarks = Landmarks(strings, n_toxic)
    kernel = np.stack([landmarks.compare(np.array([[ord(c) - 96 for c in s]], np.uint8))[0] for s in strings]).astype(float)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.1))) @ vectors.T
    inputs, best = like @ root, place == 0
    # insults with a letter too many are sentences of their own, so that the machine stays open to them where clean text allows
    spelt = [(s[1:k] + x + s[k:]) for s in strings[:n_toxic] if s[0] == "|" for k in range(2, len(s)) for x in INSERTED]
    spelt = [t.replace("|", "").replace("{", "\u00e9") for t in spelt]
    extra = landmarks.sentences(_Coded(pa.array(spelt, pa.string())))[1].astype(float) @ root
    believed = y > 0
    for _ in range(ROUNDS):
        use = (y == 0) | (believed & best)
        cost = np.where(y > 0, COSTS[0], COSTS[1])
        x, sign = np.concatenate((inputs[use], extra)), np.concatenate((np.where(y > 0, 1.0, -1.0)[use], np.ones(len(extra))))
        w, bias = train_svm(x, sign, np.concatenate((cost[use], np.full(len(extra), COSTS[0] * INSERTED_COST))))
        again = (y > 0) & (inputs @ w + bias > 0)
        if (again & best).sum() < 5 or (again == believed).all():
            break
        believed = again
    weights = root @ w
    unseen = (prior * (best & (y > 0) & ~believed)).sum() / (prior * best).sum()
    own = best & ((y == 0) | believed)
    slope, shift = fit_curve(np.maximum(like[own] @ weights + bias, bias), y[own].astype(float), prior[own])
    return Model(strings, n_toxic, weights, bias, slope, shift, float(unseen))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learns from the labelled documents that are not held out."""
    text_batches(docs.sparkSession)
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.filter(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    named = written(named, "labels")
    count = {r[0]: r[1] for r in named.groupBy("toxic").count().collect()}
    n_bad, n_good = count.get(1, 0), count.get(0, 0)
    if not n_bad or not n_good:
        p = min(max(float(bool(n_bad)), 1e-9), 1 - 1e-9)
        return Model([], 0, np.zeros(0), 0.0, 0.0, math.log(p / (1 - p)))
    first = [named.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    ids = F.broadcast(first[0].union(first[1]))  # at most 2 * most rows
    sample = written(docs.select("doc_id", "text").join(ids, "doc_id").select("toxic", "text"), "train")
    bad, good = min(n_bad, most), min(n_good, most)
    strings, n_toxic = _choose(sample, bad, good)
    if not n_toxic:
        p = n_bad / (n_bad + n_good)
        return Model([], 0, np.zeros(0), 0.0, 0.0, math.log(p / (1 - p)))
    rows = sample.mapInArrow(_instances(strings, n_toxic), "toxic int, place int, likeness array<float>").orderBy("toxic", "place", "likeness").toPandas()
    y, place = rows["toxic"].to_numpy(), rows["place"].to_numpy()
    like = np.array(rows["likeness"].tolist(), np.float64).reshape(-1, len(strings))
    prior = np.where(y > 0, n_bad / bad, n_good / good)
    return learn(like, y, place, prior, strings, n_toxic)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column __score (0 to 1)."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")
    names = [*docs.columns, "__score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = Landmarks(model.strings, model.n_toxic)
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(landmarks, _Coded(batch.column(at))), pa.float64())], names=names)

    return docs.mapInArrow(run, docs.selectExpr("*", "0D AS __score").schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at the threshold or above."""
    return score(docs, fit(docs, labels)).filter(F.col("__score") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
