"""Line dedup by winnowing over line hashes.

A window is the shortest run of whole lines, from some line on or up to some line, of min_words words
or more; where it ends or begins depends on its own text alone. The first line of least hash in a window is
its fingerprint, so two equal windows always select the same one: a repeated run of min_words words or
more shares a fingerprint, guaranteed. Each selected line is one row, whatever number of windows select it,
with the hashes of the lines around it as far as these windows reach.

Rows are joined on the fingerprint with its first position in (doc_id, text, line) order, and the match is
extended both ways, line by line, while the lines are equal; a run of min_words words or more is a later
repeat. Windows that this leaves open, as the first position has other lines around it, stand nowhere at
that position, so each is matched with the first of its like among those left open. Runs of a document
that overlap or adjoin are one run and are deleted. Any repeated run is the union of the windows
in it, from its first line on and up to its last, so it goes whole, whichever earlier place it repeats.
The first occurrence of any line is never in a deleted run, so no line loses its last copy.

Lines are compared without outer whitespace, letter case kept; blank lines do not count.

Only hashes and positions are shuffled, with partial aggregation to the first position, so a line that a
third of all documents share costs one row a partition there, and its join is split as skewed joins are.
Texts are joined once.

Defined results: null and empty texts have no lines; rows that repeat both doc_id and text are one
occurrence and are cut alike; a null doc_id comes last; a text of fewer than min_words words has no
window and stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import text_batches, written
from proselens.llm.textkit import SPACES, Texts, _power, mix, slices

MIN_WORDS = 20

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that are not blank, without outer whitespace: starts, ends, numbers of words, and where each text's lines begin."""
    begin, end, _ = texts.spans(_NEWLINE)
    word, stop, _ = texts.spans(SPACES)
    first, last = np.searchsorted(word, begin), np.searchsorted(word, end)
    some = last > first
    starts, ends = word[first[some]], stop[last[some] - 1]
    return starts, ends, (last - first)[some], np.searchsorted(starts, texts.offsets)


def _windows(texts: Texts, min_words: int) -> tuple[np.ndarray, ...]:
    """The hashes and words of all lines, and of every window the text, first line, last line and fingerprint (numbers of lines), and its hash."""
    starts, ends, words, bounds = _lines(texts)
    n = starts.size
    h = texts.hashes(starts, ends)
    total = np.concatenate(([0], np.cumsum(words)))
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # the line with which the window is full
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(last < bounds[1:][text]) if n else np.zeros(0, np.int64)
    last = last[at]
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # the line from which the window up to a line is full
    to = np.flatnonzero((total[1:] >= min_words) & (start >= bounds[:-1][text])) if n else np.zeros(0, np.int64)
    start = start[to]
    both = np.zeros(n, np.int64) - 1
    both[at] = last
    own = both[start] != to  # the others are windows from their first line on, too
    at, last = np.concatenate((at, start[own])), np.concatenate((last, to[own]))
    fp = at.copy()
    for d in range(1, int((last - at).max(initial=0)) + 1):
        more = np.flatnonzero(at + d <= last)
        less = more[h[at[more] + d] < h[fp[more]]]
        fp[less] = at[less] + d
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power("up", n + 1)[:n]))) if n else np.zeros(1, np.uint64)
    whole = mix((sums[last + 1] - sums[at]) * _power("down", n + 1)[at] + (last + 1 - at).astype(np.uint64))
    return h, words, bounds, text[at], at, last, fp, whole


def _ranges(begin: np.ndarray, size: np.ndarray, step: int = 1) -> tuple[pa.Array, np.ndarray]:
    """Offsets of lists of these sizes, and the numbers in them: begin, begin + step and so on."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    return pa.array(offsets.astype(np.int32)), np.repeat(begin, size) + step * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], size))


_SELECTED = "fp long, doc_id long, text_hash long, line int, words int, before array<struct<h:long,words:int>>, after array<struct<h:long,words:int>>, windows array<struct<up:int,down:int,whole:long>>"


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for every line that a window selects: fp (its hash), doc_id, text_hash, line, words, before and after (hash and words of the
    lines around it that its windows reach, the nearest first) and windows (lines before and after it, and the hash)."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, words, bounds, text, first, last, fp, whole = _windows(Texts(batch.column(2)), min_words)
            order = np.argsort(fp, kind="stable")
            text, first, last, fp, whole = text[order], first[order], last[order], fp[order], whole[order]
            at = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if fp.size else np.zeros(0, np.int64)
            line, rows = fp[at], pa.array(text[at])
            up = line - np.minimum.reduceat(first, at) if at.size else at
            down = np.maximum.reduceat(last, at) - line if at.size else at
            h64, w32 = h.view(np.int64), words.astype(np.int32)
            lines = lambda i: pa.StructArray.from_arrays([pa.array(h64[i]), pa.array(w32[i])], names=["h", "words"])
            before, after = _ranges(line - 1, up, -1), _ranges(line + 1, down)
            windows = pa.StructArray.from_arrays([pa.array((fp - first).astype(np.int32)), pa.array((last - fp).astype(np.int32)), pa.array(whole.view(np.int64))], names=["up", "down", "whole"])
            own = pa.ListArray.from_arrays(pa.array(np.append(at, fp.size).astype(np.int32)), windows)
            columns = [
                pa.array(h64[line]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((line - bounds[:-1][text[at]]).astype(np.int32)), pa.array(w32[line]),
                pa.ListArray.from_arrays(before[0], lines(before[1])), pa.ListArray.from_arrays(after[0], lines(after[1])), own,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["fp", "doc_id", "text_hash", "line", "words", "before", "after", "windows"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, _SELECTED)


def _equal(own: str, other: str) -> Column:
    """How many lines of two lists are equal from the first on."""
    differs = F.array_position(F.zip_with(own, other, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(own)).otherwise(differs - 1).cast("int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with later copies of earlier lines: doc_id, text_hash, lines (sorted numbers of the lines to delete)."""
    selected = written(fingerprints(docs, min_words), "line-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "line")
    first = selected.groupBy("fp").agg(F.min(F.struct(place.alias("place"), "before", "after")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "line-first")  # so that adaptive execution can split the join on a line that very many share
    shared = selected.join(first, "fp").withColumn("up", _equal("before", "first.before")).withColumn("down", _equal("after", "first.after"))
    words = lambda c, n: F.aggregate(F.slice(c, F.lit(1), F.col(n)), F.lit(0), lambda acc, x: acc + x["words"])
    shared = shared.withColumn("is_first", place == F.col("first.place")).withColumn("run", F.col("words") + words("before", "up") + words("after", "down"))
    shared = written(shared.drop("first", "before", "after", "words"), "line-matches")
    # a match with the first position
    spans = shared.filter((F.col("run") >= min_words) & ~F.col("is_first")).select("doc_id", "text_hash", (F.col("line") - F.col("up")).alias("a"), (F.col("line") + F.col("down")).alias("b"))
    # windows that the first position has not
    left = shared.filter("NOT is_first").select("fp", "doc_id", "text_hash", "line", "up", "down", F.explode("windows").alias("w")).filter("w.up > up OR w.down > down")
    left = left.select("fp", F.col("w.whole").alias("whole"), "doc_id", "text_hash", (F.col("line") - F.col("w.up")).alias("a"), (F.col("line") + F.col("w.down")).alias("b"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "a")
    other = left.groupBy("fp", "whole").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    spans = spans.union(left.join(other, ["fp", "whole"]).filter(place != F.col("first")).select("doc_id", "text_hash", "a", "b"))
    lines = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return lines.select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))).alias("lines"))


def _cut(names: list[str]):
    at, lines_at = names.index("text"), names.index("__lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = list(batch.columns)
            bounds = _lines(Texts(columns[at]))[3]
            values, which = columns[at].to_pylist(), columns[lines_at].to_pylist()
            for i, numbers in enumerate(which):
                if numbers:
                    lines, gone = values[i].encode().split(b"\n"), set(numbers)
                    counted = (k for k, line in enumerate(lines) if line.strip(b" \t\n\x0b\x0c\r"))
                    drop = {k for n, k in enumerate(counted) if n in gone}
                    values[i] = b"\n".join(line for k, line in enumerate(lines) if k not in drop).decode("utf-8")
            columns[at] = pa.array(values, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds), pa.int64())], names=[*names, "__n_lines"])

    return run


def _with_cuts(docs: DataFrame, min_words: int) -> DataFrame:
    runs = repeated_runs(docs, min_words).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash", "lines": "__lines"})
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(runs, match, "left").select(*docs.columns, "__lines")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema) + ", __n_lines long"
    return joined.mapInArrow(_cut(joined.columns), schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted; a document all of whose lines were deleted is dropped."""
    cut = _with_cuts(docs, min_words)
    return cut.filter("__lines IS NULL OR size(__lines) < __n_lines").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, lines deleted, and the digest of the text that stays."""
    cut = _with_cuts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MIN_WORDS)
    removed = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    return cut.select("doc_id", F.col("__n_lines").alias("n_lines"), F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM d),
l AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM a WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM l),
e AS (SELECT x.doc_id, x.i, min(y.i) AS j FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + {MIN_WORDS - 1} AND y.total - x.total + x.n >= {MIN_WORDS} GROUP BY x.doc_id, x.i
  UNION SELECT y.doc_id, max(x.i) AS i, y.i AS j FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.i BETWEEN y.i - {MIN_WORDS - 1} AND y.i AND y.total - x.total + x.n >= {MIN_WORDS} GROUP BY y.doc_id, y.i),
w AS (SELECT e.doc_id, e.i, e.j, string_agg(c.line, chr(10) ORDER BY c.i) AS content FROM e JOIN c ON c.doc_id = e.doc_id AND c.i BETWEEN e.i AND e.j GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS place FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r WHERE place > 1),
kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.k) AS text FROM a LEFT JOIN l USING (doc_id, k) LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(x.n, 0)::BIGINT AS n_lines, coalesce(y.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) y USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
