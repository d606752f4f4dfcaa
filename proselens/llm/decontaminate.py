"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Each executor streams a document's words through the automaton, which gives at every word the length
of the longest match that ends there; matches of a whole window (10 words, or a shorter item as a
whole) mark words as hit. A vectorised test drops words that cannot be in a window first: only runs
of words whose pairs all occur in some item reach the automaton, so clean text costs a few array
operations. The automata are broadcast in shards of a bounded number of item words; a benchmark of
more words than one shard holds takes one narrow pass a shard, without a shuffle.

Defined results: a null or empty text has no words and no hits; items without words never match;
repeated items are found under each of their ids; an empty benchmark hits nothing; ids may be null
(a null item_id is left out of lists of ids). Repeated documents give a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import text_batches
from proselens.llm.textkit import NOT_WORD, Texts, slices

#: Words of benchmark items in one automaton: about 1 GB of states in each Python worker at the very most.
SHARD_WORDS = 1_000_000


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers. State 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the words of q that p and word spell; q itself where it has no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was read that some item holds."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def holder(self, state: int, length: int) -> int:
        """The state of the last `length` words of those that `state` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class ItemMatcher:
    """Finds the windows of some items in documents."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window = window
        self.sam, self.items, self.short = SuffixAutomaton(), {}, {}
        texts = Texts(pa.array([t for _, t in items], pa.string()), lower=True)
        starts, ends, bounds = texts.spans(NOT_WORD)
        self.vocabulary, words = np.unique(texts.hashes(starts, ends), return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary & np.uint64(0xFFFFF)] = True
        runs = [words[bounds[i] : bounds[i + 1]].tolist() for i in range(len(items))]
        pairs = [np.asarray(r[:-1], np.int64) * self.vocabulary.size + r[1:] for r in runs if len(r) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        for run in runs:
            last = 0
            for word in run:
                last = self.sam.extend(last, word)
        self.least = min((min(len(r), window) for r in runs if r), default=0)
        for (item, _), run in zip(items, runs, strict=True):
            state = length = 0
            for word in run:
                state, length = self.sam.step(state, length, word)
                if length >= window:
                    self.items.setdefault(self.sam.holder(state, window), set()).add(item)
            if 0 < len(run) < window:
                self.short.setdefault(self.sam.holder(state, len(run)), []).append((len(run), item))
        # the nearest state on the way to the root, itself included, where a short item ends
        self.ends = [-1] * len(self.sam.length)
        for s in sorted(range(1, len(self.ends)), key=self.sam.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.sam.link[s]]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no item."""
        out = np.full(hashes.size, -1, np.int64)
        if self.vocabulary.size:
            some = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFFF)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), self.vocabulary.size - 1)
            out[some] = np.where(self.vocabulary[at] == hashes[some], at, -1)
        return out

    def runs(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words, each in one text, outside which no window can be."""
        if not self.least or not words.size:
            return
        joined = np.zeros(words.size, bool)  # word i goes on from word i - 1
        both = np.flatnonzero((words[1:] >= 0) & (words[:-1] >= 0)) + 1
        if self.pairs.size and both.size:
            code = words[both - 1] * self.vocabulary.size + words[both]
            at = np.minimum(np.searchsorted(self.pairs, code), self.pairs.size - 1)
            joined[both] = self.pairs[at] == code
        joined[bounds[:-1][bounds[:-1] < words.size]] = False
        begins = np.flatnonzero(~joined)
        ends = np.append(begins[1:], words.size)
        keep = (ends - begins >= self.least) & (words[begins] >= 0)
        yield from zip(begins[keep].tolist(), ends[keep].tolist(), strict=True)

    def match(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals (merged, end exclusive) covered by windows, and the items that have them."""
        state = length = 0
        found: list[tuple[int, int]] = []
        items: set = set()

        def hit(begin: int, end: int) -> None:
            while found and begin <= found[-1][1]:
                begin = min(begin, found.pop()[0])
            found.append((begin, end))

        for i, word in enumerate(words):
            state, length = self.sam.step(state, length, word)
            if length >= self.window:
                hit(i + 1 - self.window, i + 1)
                items |= self.items[self.sam.holder(state, self.window)]
            at = self.ends[state] if state else -1
            while at > 0:
                for size, item in self.short[at]:
                    if size <= length:
                        hit(i + 1 - size, i + 1)
                        items.add(item)
                at = self.ends[self.sam.link[at]]
        return found, items

    def batch(self, texts: Texts) -> tuple[np.ndarray, dict[int, list], dict[int, set], tuple]:
        """Per text: number of words; merged hit intervals and items of the texts that have any."""
        starts, ends, bounds = texts.spans(NOT_WORD)
        words = self.known(texts.hashes(starts, ends))
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for a, b in self.runs(words, bounds):
            found, which = self.match(words[a:b].tolist())
            if found:
                text = int(np.searchsorted(bounds, a, "right")) - 1
                base = a - int(bounds[text])
                spans.setdefault(text, []).extend((base + x, base + y) for x, y in found)
                items.setdefault(text, set()).update(which)
        return np.diff(bounds), spans, items, (starts, ends, bounds)


def _shards(benchmark: DataFrame, most: int) -> list[list[tuple[object, str | None]]]:
    """Items in shards of at most so many characters' worth of words. The benchmark's size is checked before it is gathered."""
    rows = benchmark.select("item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > 64 * 8 * most:
        raise ValueError(f"the benchmark holds {chars} characters; at most {64 * 8 * most} are broadcast")
    shards: list[list] = [[]]
    size = 0
    for item, text in rows.orderBy("item_id", "text").collect():
        n = len(text or "") // 2 + 1
        if shards[-1] and size + n > most:
            shards.append([])
            size = 0
        shards[-1].append((item, text))
        size += n
    return shards


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


#: What a pass over one shard adds: numbers of words, hit intervals (begin, end, begin, end, ...) and item ids.
_FOUND = "__n_words long, __hits array<int>, __items array<string>"


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with __n_words, __hits (merged word intervals) and __items (ids of items with a window in the text)."""
    spark = docs.sparkSession
    text_batches(spark)
    out = docs.selectExpr("*", "0L AS __n_words", "cast(array() AS array<int>) AS __hits", "cast(array() AS array<string>) AS __items")
    schema = out.schema
    names = out.columns
    for shard in _shards(benchmark, shard_words):
        sent = spark.sparkContext.broadcast(shard)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(sent.value, window)
            for batch in slices(batches, "text"):
                counts, spans, items, _ = matcher.batch(Texts(batch.column(names.index("text")), lower=True))
                hits, ids = batch.column(names.index("__hits")).to_pylist(), batch.column(names.index("__items")).to_pylist()
                for i, new in spans.items():
                    old = list(zip(hits[i][::2], hits[i][1::2], strict=True))
                    hits[i] = [v for pair in _union(old, new) for v in pair]
                    ids[i] = sorted({*ids[i], *(str(x) for x in items[i] if x is not None)})
                columns = dict(zip(names, batch.columns, strict=True)) | {"__n_words": pa.array(counts, pa.int64()), "__hits": pa.array(hits, pa.list_(pa.int32())), "__items": pa.array(ids, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

        out = out.mapInArrow(search, schema)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = match_items(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.expr("aggregate(sequence(0, size(__hits) div 2 - 1), 0L, (n, i) -> n + __hits[2 * i + 1] - __hits[2 * i])")
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.when(F.size("__hits") > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: hit spans of min_span words or more (or all of a shorter item) are cut from the
    text, and documents are dropped of whose words a larger share than max_coverage was hit. Clean rows stay as they are."""
    plain = docs.columns
    found = match_items(docs, benchmark, window)
    schema = docs.schema
    at = plain.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hits, counts = batch.column(batch.schema.get_field_index("__hits")).to_pylist(), batch.column(batch.schema.get_field_index("__n_words")).to_pylist()
            columns = list(batch.columns[: len(plain)])
            if any(hits):
                texts = Texts(columns[at], lower=True)
                starts, ends, bounds = texts.spans(NOT_WORD)
                values, keep = columns[at].to_pylist(), [True] * len(hits)
                for i, flat in enumerate(hits):
                    if not flat:
                        continue
                    spans = list(zip(flat[::2], flat[1::2], strict=True))
                    keep[i] = sum(b - a for a, b in spans) <= max_coverage * counts[i]
                    raw, base = values[i].encode(), int(texts.offsets[i])
                    for a, b in reversed(spans):
                        if b - a >= min(min_span, window) or b - a < window:
                            raw = raw[: starts[bounds[i] + a] - base] + raw[ends[bounds[i] + b - 1] - base :]
                    values[i] = raw.decode("utf-8")
                columns[at] = pa.array(values, columns[at].type)
                batch = pa.RecordBatch.from_arrays(columns, names=plain).filter(pa.array(keep))
            else:
                batch = pa.RecordBatch.from_arrays(columns, names=plain)
            yield batch

    return found.mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
i AS (
  SELECT item_id, coalesce(regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
sizes AS (SELECT DISTINCT least(10, len(words)) AS m FROM i WHERE len(words) > 0),
grams AS (
  SELECT DISTINCT item_id, m, array_to_string(words[p:p + m - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(10, len(words)) AS m, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM i WHERE len(words) > 0)),
spots AS (
  SELECT doc_id, m, p, array_to_string(words[p:p + m - 1], ' ') AS gram
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS p FROM w JOIN sizes ON len(words) >= m)),
found AS (SELECT doc_id, item_id, m, p FROM spots JOIN grams USING (m, gram)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS x FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
