"""Embedding near-dedup with hierarchical navigable small-world graphs per shard.

Vectors of one label and length are dealt by hash into shards of about SHARD distinct vectors; equal vectors are
one member with a multiplicity. A task builds each shard's graph. Then every pair of shards of a label and length is
searched once, a row and a task of its own for each pair, dealt by label, length and both shards: each vector of either shard queries the other's graph with a beam that, where its worst entry is
still above the threshold, widens to all it reaches there, and both directions' finds are joined, so a link is found for both
ends or for none. A sample of each shard's queries is audited against brute force, and the beam is
doubled until the audit's recall passes. Every link is verified by cosine in double precision; a task
passes on counts of links and a spanning forest of them, never the pairs, and components are united
across tasks.

All pairs of shards of a label are searched, as each vector queries every shard; work is so n log n in a
shard and grows with the number of shards of a label.

Defined results: null vectors, zero vectors and vectors with null or non-finite components and rows with a
null label link with nothing; vectors of different length do not link, those of one length do, whatever else their label holds;
repeated vectors link with each other; repeated vec_ids give a row each and count each other as one more
vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.components import Forest, connected
from proselens.llm.shared import shuffle_partitions, text_batches, written
from proselens.llm.textkit import mix

COSINE = 0.93

#: Distinct vectors in a shard on average, neighbours of a node (twice as many on the lowest level), beams, and the audit.
SHARD = 4096
M = 12
BUILD_BEAM, BEAM = 48, 32
AUDIT_ROWS, AUDIT_RECALL = 64, 0.99

#: A widened beam goes on over nodes this much below the threshold.
REACH = 0.06

_BATCH = 128


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, vectors: np.ndarray, m: int = M, beam: int = BUILD_BEAM):
        self.vectors, self.m = vectors.astype(np.float32), m
        n = len(vectors)
        draw = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)), 6).astype(np.int64) if n else np.zeros(0, np.int64)
        order = np.argsort(-self.level, kind="stable")  # the upper levels are complete before the lower ones
        self.vectors, self.level, self.order = self.vectors[order], self.level[order], order
        self.links = [np.full((int((self.level >= h).sum()), 2 * m if h == 0 else m), -1, np.int32) for h in range(int(self.level.max(initial=0)) + 1)]
        for h in range(len(self.links) - 1, -1, -1):
            self._fill(h, beam)

    def _fill(self, h: int, beam: int) -> None:
        """Adds the nodes of level h in batches; each is linked with what a search among the earlier ones, or the batch itself, finds."""
        links, n, at = self.links[h], len(self.links[h]), 0
        width = links.shape[1]
        while at < n:
            end = min(n, at + max(1, min(_BATCH, at)))
            own = self.vectors[at:end]
            within = own @ own.T
            np.fill_diagonal(within, -2)
            ids = np.tile(np.arange(at, end), (end - at, 1))
            near = np.concatenate((within, np.zeros((end - at, 0), np.float32)), axis=1)
            if at:
                found, score = self.search(own, beam, h, at)
                ids, near = np.concatenate((found, ids), axis=1), np.concatenate((score, near), axis=1)
            pick = np.argsort(-near, axis=1)[:, : self.m]
            ids, near = np.take_along_axis(ids, pick, 1), np.take_along_axis(near, pick, 1)
            ids[near <= -1.5] = -1
            links[at:end, : ids.shape[1]] = ids
            for node, row in enumerate(ids.tolist(), at):
                for other in row:
                    if other >= 0:
                        self._back(links, other, node, width)
            at = end

    def _back(self, links: np.ndarray, node: int, new: int, width: int) -> None:
        row = links[node]
        if new in row:
            return
        free = np.flatnonzero(row < 0)
        if free.size:
            row[free[0]] = new
            return
        every = np.append(row, new)
        score = self.vectors[every] @ self.vectors[node]
        # spread: a neighbour nearer to a kept one than to the node is taken only if room is left
        kept: list[int] = []
        rest: list[int] = []
        between = self.vectors[every] @ self.vectors[every].T
        for i in np.argsort(-score, kind="stable").tolist():
            (kept if all(between[i, j] < score[i] for j in kept) else rest).append(i)
        links[node] = every[(kept + rest)[:width]]

    def search(self, queries: np.ndarray, beam: int, level: int = 0, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes (-1: none) and similarities for each query, best first, on one level among the first nodes."""
        queries = queries.astype(np.float32)
        top = len(self.links) - 1
        entry = np.zeros(len(queries), np.int64)
        for h in range(top, level, -1):
            entry = self._beam(queries, entry[:, None], 1, h, len(self.links[h]))[0][:, 0].astype(np.int64)
        return self._beam(queries, entry[:, None], beam, level, among or len(self.links[level]))

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, h: int, among: int) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[h], np.arange(len(queries))
        entry = np.where(entry < among, entry, 0)
        ids = np.full((rows.size, beam), -1, np.int32)
        score = np.full((rows.size, beam), -2, np.float32)
        done = np.ones((rows.size, beam), bool)
        ids[:, 0] = entry[:, 0]
        score[:, 0] = np.einsum("ij,ij->i", queries, self.vectors[entry[:, 0]])
        done[:, 0] = False
        seen = np.zeros((rows.size, among), bool)
        seen[rows, entry[:, 0]] = True
        active = rows
        while active.size:
            open_score = np.where(done[active], -3, score[active])
            at = open_score.argmax(axis=1)
            more = open_score[np.arange(active.size), at] > -2.5
            active, at = active[more], at[more]
            if not active.size:
                break
            done[active, at] = True
            near = links[ids[active, at]]
            valid = (near >= 0) & (near < among)
            near = np.where(valid, near, 0)
            valid &= ~seen[active[:, None], near]
            seen[active[:, None], near] |= valid
            new = np.where(valid, np.einsum("ij,ikj->ik", queries[active], self.vectors[near]), np.float32(-2))
            every = np.concatenate((score[active], new), axis=1)
            pick = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            score[active] = np.take_along_axis(every, pick, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(valid, near, -1)), axis=1), pick, 1)
            done[active] = np.take_along_axis(np.concatenate((done[active], ~valid), axis=1), pick, 1)
        return ids, score

    def near(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) numbers of all finds of at least such similarity, less rounding. A beam that ends with an entry
        that near is widened to all it reaches over nodes near the threshold, however many these are."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        width, slack = min(beam, max(1, len(self.vectors))), least - 1e-3
        step = max(1, min(_BATCH, (1 << 22) // max(1, len(self.vectors) + 64 * width)))
        for lo in range(0, len(queries), step):
            part = queries[lo : lo + step].astype(np.float32)
            ids, score = self.search(part, width)
            full = (score[:, -1] >= slack) & (width < len(self.vectors))
            hit = (score >= slack) & (ids >= 0)
            q, _ = np.nonzero(hit & ~full[:, None])
            pairs.append((lo + q, self.order[ids[hit & ~full[:, None]]]))
            wide = np.flatnonzero(full)
            if wide.size:
                q, v = self._flood(part[wide], ids[wide], slack)
                pairs.append((lo + wide[q], self.order[v]))
        return np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])

    def _flood(self, queries: np.ndarray, starts: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        links = self.links[0]
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        q = np.repeat(np.arange(len(queries)), starts.shape[1])
        v = starts.ravel().astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while q.size:
            new = v >= 0
            flat = np.unique(q[new] * len(self.vectors) + v[new])
            q, v = flat // len(self.vectors), flat % len(self.vectors)
            fresh = ~seen[q, v]
            q, v = q[fresh], v[fresh]
            seen[q, v] = True
            score = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], self.vectors[v[i : i + 65536]]) for i in range(0, q.size, 65536)] or [np.zeros(0, np.float32)])
            found.append((q[score >= slack], v[score >= slack]))
            on = score >= slack - REACH
            q, v = np.repeat(q[on], links.shape[1]), links[v[on]].ravel().astype(np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _audited(graph: Graph, vectors: np.ndarray, queries: np.ndarray, least: float) -> int:
    """The beam at which a sample of queries finds what brute force does."""
    own = np.argsort(mix(np.arange(len(queries), dtype=np.uint64)))[:AUDIT_ROWS]
    truth = (queries[own].astype(np.float32) @ vectors.astype(np.float32).T) >= least
    beam = BEAM
    while beam < len(vectors):
        found = np.zeros_like(truth)
        q, v = graph.near(queries[own], least, beam)
        found[q, v] = True
        if (found & truth).sum() >= AUDIT_RECALL * truth.sum():
            break
        beam *= 2
    return min(beam, max(1, len(vectors)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (label, length, shard) after another to one row with the shard's ids, multiplicities, vectors and graph."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        ids, copies, vectors = (np.array(c) for c in zip(*held, strict=True))
        unit = np.array(vectors.tolist())
        graph = Graph(unit / np.linalg.norm(unit, axis=1, keepdims=True))
        blobs = [ids.astype(np.int64), copies.astype(np.int64), unit, graph.order.astype(np.int64), graph.level]
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int32()), pa.array([now[3]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([[b.tobytes() for b in blobs]], pa.list_(pa.binary())), pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary()))],
            names=["label", "d", "n_shards", "shard", "n", "data", "links"],
        )

    for batch in batches:
        for *own, head, copies, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(own) != now:
                if held:
                    yield row()
                now, held = tuple(own), []
            held.append((head, copies, np.array(v)))
    if held:
        yield row()


class _Shard:
    def __init__(self, n: int, data: list[bytes], links: list[bytes]):
        self.ids, self.copies = np.frombuffer(data[0], np.int64), np.frombuffer(data[1], np.int64)
        raw = np.frombuffer(data[2], np.float64).reshape(n, -1)
        self.norms = np.sqrt((raw**2).sum(axis=1))
        self.raw, self.unit = raw, raw / self.norms[:, None]
        graph = Graph.__new__(Graph)
        graph.m, graph.order, graph.level = M, np.frombuffer(data[3], np.int64), np.frombuffer(data[4], np.int64)
        graph.vectors = self.unit[graph.order].astype(np.float32)
        graph.links = [np.frombuffer(x, np.int32).reshape(-1, 2 * M if h == 0 else M) for h, x in enumerate(links)]
        self.graph = graph


def _search(least: float):
    """Pairs of shards to rows (member, links found, a neighbour in the forest or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one_shard, n, data, links, other_shard, m, data2, links2 in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                a = _Shard(n, data, links)
                b = a if one_shard == other_shard else _Shard(m, data2, links2)
                q, v = b.graph.near(a.unit, least, _audited(b.graph, b.unit, a.unit, least))
                if a is not b:
                    v2, q2 = a.graph.near(b.unit, least, _audited(a.graph, a.unit, b.unit, least))
                    q, v = np.concatenate((q, q2)), np.concatenate((v, v2))
                else:
                    q, v = np.concatenate((q, v)), np.concatenate((v, q))
                pairs = np.unique(q * len(b.ids) + v)
                q, v = pairs // len(b.ids), pairs % len(b.ids)
                if a is b:
                    q, v = q[q != v], v[q != v]
                keep = np.concatenate([np.einsum("ij,ij->i", a.raw[q[i : i + 65536]], b.raw[v[i : i + 65536]]) / (a.norms[q[i : i + 65536]] * b.norms[v[i : i + 65536]]) >= least for i in range(0, q.size, 65536)] or [np.zeros(0, bool)])
                q, v = q[keep], v[keep]
                count = {int(x): int(c) for x, c in zip(a.ids, np.bincount(q, b.copies[v], len(a.ids)), strict=True) if c}
                if a is not b:
                    count |= {int(x): int(c) for x, c in zip(b.ids, np.bincount(v, a.copies[q], len(b.ids)), strict=True) if c}
                forest = Forest()
                for x, y in zip(a.ids[q].tolist(), b.ids[v].tolist(), strict=True):
                    forest.union(x, y)
                rows = [(x, c, forest.find(x)) for x, c in count.items()]
                x, c, root = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(c, pa.int64()), pa.array(root, pa.int64())], names=["head", "links", "root"])

    return run


def near_duplicates(embeddings: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    spark = embeddings.sparkSession
    text_batches(spark)
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("good", good).withColumn("key", F.when(good, F.xxhash64("label", "v"))), "vectors")
    # equal vectors are one member, named by the smallest vec_id
    members = rows.filter("good").groupBy("label", "key", "v").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
    members = written(members, "members")
    members = members.withColumn("d", F.size("v"))
    shards = members.groupBy("label", "d").agg(F.ceil(F.count("*") / shard).cast("int").alias("n_shards"))
    dealt = members.join(shards, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("n_shards")).cast("int")).select("label", "d", "n_shards", "shard", "head", "copies", "v")
    packed = dealt.repartition(shuffle_partitions(spark), "label", "d", "shard").sortWithinPartitions("label", "d", "shard", "head")
    packed = written(packed.mapInArrow(_pack, "label long, d int, n_shards int, shard int, n int, data array<binary>, links array<binary>"), "graphs")
    # each shard names its partners itself, so that no task meets all shards of a label
    other = packed.select("label", "d", *[F.col(c).alias(f"{c}2") for c in ("shard", "n", "data", "links")])
    todo = packed.withColumn("shard2", F.explode(F.sequence("shard", F.col("n_shards") - 1))).join(other, ["label", "d", "shard2"])
    todo = todo.repartition(shuffle_partitions(spark), "label", "d", "shard", "shard2").select("shard", "n", "data", "links", "shard2", "n2", "data2", "links2")
    found = written(todo.mapInArrow(_search(least), "head long, links long, root long"), "finds")
    links = found.groupBy("head").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("head").alias("a"), F.col("root").alias("b")))
    told = members.select("label", "key", "d", "head", "copies").join(links, "head", "left").join(roots, F.col("head") == F.col("node"), "left")
    told = told.select("label", "key", "d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "head").alias("component_id"))
    usual = rows.select("vec_id", "label", "key", F.size("v").alias("d")).join(told, ["label", "key", "d"], "left")
    out = usual.select("vec_id", F.when(F.col("key").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
