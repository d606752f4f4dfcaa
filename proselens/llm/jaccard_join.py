"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct 5-word shingles, as 64-bit hashes; equal sets are one class from the
start. Two classes link when 100 * intersection >= 80 * union, in whole numbers.

1. Counts. Hashes go through a packed exchange by range; a reducer finds the classes of each hash, so
   counts cover the corpus. A hash of one class can match nothing and is not passed on. A class is
   passed on only if the share of its hashes that others have reaches the threshold, as no partner can
   be found without that: most of a corpus ends here, exactly.
2. Prefixes. Hashes are ordered from rare to frequent. For any l, two linked classes share at least l
   hashes of their l-prefixes, the first n - ceil(0.8 n) + l hashes. Each class takes the l of least
   estimated cost: posting entries read, and candidates (entries divided by l) times the cost of one
   verification. Classes with l and l' need min(l, l') shared prefix hashes.
3. Stars. For each prefix hash the class with the largest share of common hashes is a pivot; a class is
   verified against its pivots and linked; further turns take other pivots for what is not connected yet.
   A group of g near copies so costs about g verifications a turn.
4. The rest. What stars leave are pairs that share enough prefix hashes and are not connected yet. In lists of up
   to SHORT classes they are tried one by one. The classes of longer lists are compared with the list's pivot, and joined on what
   they differ in from it: near copies of one text share nearly all their hashes, but few differences, and two that link
   must have most differences of the smaller in common, so a prefix of very few differences finds them. Lists of
   differences that are still long are taken apart in the same way by pivots of their own, DEPTH times at most; then their
   pairs are tried. No pair is dropped. Pairs already connected need no link of their own, as the result is
   connected components.

Defined results: null, empty and wordless texts have the empty set and link with nothing; a text of 1 to
4 words is one shingle of all its words; repeated rows are equal sets; a null doc_id is kept and names
a component only if the component has no other doc_id (then null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.components import connected
from proselens.llm.exchange import BLOCK, block_batch, blocks, by_key, dealt, key_count, opened, range_of
from proselens.llm.shared import shuffle_partitions, text_batches, written
from proselens.llm.textkit import SPACES, Texts, mix, shingles, slices

WORDS = 5
PERCENT = 80

#: The most prefix hashes beyond the plain prefix, and what a verification costs in posting entries per hash of the set.
LONGEST = 6
VERIFY_COST = 0.05

#: Rounds of stars at most before the rest is enumerated; they end earlier once a round links nothing new.
STAR_ROUNDS = 4

#: Pivots of a prefix hash: one at first, this many in later rounds.
PIVOTS = 12

#: Members up to which the pairs of a list are tried one by one, and how often longer lists are taken apart by differences from a pivot.
SHORT = 32
DEPTH = 4

_PAIR, _SIZE = 0, 1


def _sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, where each text's begin, and each text's class hash and set size."""
    starts, ends, bounds = texts.spans(SPACES)
    h, at = shingles(texts.hashes(starts, ends), bounds, words, short=True)
    new = np.ones(h.size, bool)
    for i in range(len(texts)):
        h[at[i] : at[i + 1]].sort()
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < h.size]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    at, h = total[at], h[new]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))))
    sizes = np.diff(at)
    return h, at, mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64)), sizes


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, text_hash, class (hash of the set, null for the empty set) and n_shingles."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, which, sizes = _sets(Texts(batch.column(2), lower=True), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(which.view(np.int64), mask=sizes == 0), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "class", "n_shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, class long, n_shingles long")


def _emit(words: int, keys: int):
    """Texts to blocks of (hash, class), keyed by range of the hash, and of (class, size), keyed by range of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, at, which, sizes = _sets(Texts(batch.column(0), lower=True), words)
            once = np.zeros(which.size, bool)  # equal texts of a slice count once
            once[np.unique(which, return_index=True)[1]] = True
            once &= sizes > 0
            pick = np.repeat(once, sizes)
            h, owner = h[pick], np.repeat(which[once], sizes[once])
            rows = list(blocks(_PAIR, range_of(h, keys), [h, owner]))
            rows += blocks(_SIZE, range_of(which[once], keys), [which[once], sizes[once].astype(np.int64)])
            yield block_batch(rows)

    return run


def _common(keys: int):
    """Blocks of one range of hashes to blocks of (class, hash, count) of the hashes that two classes or more have."""

    def work(key: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        rows = [(key, _SIZE, p) for p in held.get(_SIZE, [])]
        h, owner = opened(held.get(_PAIR, []), ["<u8", "<u8"])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        same = np.zeros(h.size + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        some = same[1:] | same[:-1]
        h, owner = h[some], owner[some]
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        if h.size:
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            counts = np.diff(np.append(first, h.size))
            counts = np.repeat(counts, counts)
            some = counts > 1
            rows += blocks(_PAIR, range_of(owner[some], keys), [owner[some], h[some], counts[some].astype(np.int32)])
        yield block_batch(rows)

    return lambda batches: by_key(batches, work)


_FAMILY = "class long, n int, hashes array<long>, prefix array<long>, l int, shared double"


def choose_prefix(n: int, counts: np.ndarray, percent: int) -> tuple[int, int]:
    """counts: of the common hashes of a class of n hashes, rising. The l of least cost, and how many common hashes its prefix holds."""
    plain = n - -(-percent * n // 100)
    alone = n - counts.size
    entries = np.concatenate(([0], np.cumsum(counts - 1)))
    best = (float("inf"), 1, 0)
    for k in range(1, LONGEST + 1):
        held = min(max(plain + k - alone, 0), counts.size)
        cost = entries[held] * (1 + VERIFY_COST * n / k)
        if cost < best[0]:
            best = (cost, k, held)
        if plain + k >= n:
            break
    return best[1], best[2]


def _families(percent: int):
    """Blocks of one range of classes to a row for each class that can have a partner."""

    def work(key: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        names, sizes = opened(held.get(_SIZE, []), ["<u8", "<i8"])
        names, at = np.unique(names, return_index=True)
        sizes = sizes[at]
        owner, h, counts = opened(held.get(_PAIR, []), ["<u8", "<u8", "<i4"])
        order = np.lexsort((h, counts, owner))
        owner, h, counts = owner[order], h[order], counts[order]
        out: list[tuple] = []
        cuts = np.flatnonzero(np.diff(owner)) + 1 if owner.size else np.zeros(0, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), owner.size], strict=True):
            if a == b:
                continue
            n = int(sizes[np.searchsorted(names, owner[a])])
            if 100 * (b - a) < percent * n:
                continue
            k, many = choose_prefix(n, counts[a:b].astype(np.int64), percent)
            own = h[a:b].view(np.int64)
            out.append((int(owner[a].astype(np.int64)), n, own, own[:many], k, (b - a) / n))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["class", "n", "hashes", "prefix", "l", "shared"])

    return lambda batches: by_key(batches, work)


def families(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The classes that can have a partner: size, common hashes, chosen l and prefix."""
    partitions = shuffle_partitions(docs.sparkSession)
    keys = key_count(docs, partitions)
    pairs = docs.select("text").mapInArrow(_emit(words, keys), BLOCK)
    common = dealt(pairs, partitions).mapInArrow(_common(keys), BLOCK)
    return written(dealt(common, partitions).mapInArrow(_families(percent), _FAMILY), "families")


def _verified(pairs: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that link, by exact intersection of their common hashes."""
    one = family.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    two = family.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(two, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def class_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes that link with another: the components of classes."""
    family = families(docs, words, percent)
    postings = written(family.select("class", "n", "l", "shared", F.explode("prefix").alias("h")), "postings")
    # what can link: sizes, and the hashes that each shares with any other class
    fit = f"100 * least(n, m) >= {percent} * greatest(n, m) AND {100 + percent} * least(round(n * shared), round(m * common)) >= {percent} * (n + m)"
    roots = None
    links = tried = None
    for turn in range(STAR_ROUNDS):
        now = postings if roots is None else postings.join(roots, F.col("class") == F.col("node"), "left").select(*postings.columns, F.coalesce("root", "class").alias("root"))
        now = now if roots is not None else now.withColumn("root", F.col("class"))
        # first the class that shares most; then the one that does in each of some parts of the list, cut anew each turn
        part = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(PIVOTS if turn else 1))
        lists = now.groupBy("h", part.alias("part")).agg(F.max(F.struct("shared", "class", "n", "l", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high"))
        lists = lists.groupBy("h").agg(F.collect_list("p").alias("pivots"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("h", F.explode("pivots").alias("p"))
        stars = now.join(lists, "h").filter("root <> p.root").select("class", "n", "l", F.col("p.class").alias("pivot"), F.col("p.n").alias("m"), F.col("p.l").alias("k"), "shared", F.col("p.shared").alias("common")).filter(fit)
        stars = stars.groupBy("class", "pivot").agg(F.count("*").alias("c"), F.first("l").alias("l"), F.first("k").alias("k")).filter("c >= least(l, k)")
        stars = stars.select(F.greatest("class", "pivot").alias("a"), F.least("class", "pivot").alias("b")).distinct()
        if tried is not None:
            stars = stars.join(tried.hint("merge"), ["a", "b"], "left_anti")
        stars = written(stars, "stars")
        if stars.isEmpty():
            break
        tried = stars if tried is None else tried.union(stars)
        found = written(_verified(stars, family, percent), "found")
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        roots = written(connected(links), "roots")
    left = _rest(family, postings, links, roots, tried, percent, fit)
    if links is None:
        return connected(left)
    return roots if left.isEmpty() else connected(links.union(left))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of their class, the class itself where it has no link yet."""
    if roots is None:
        return rows.withColumn("root", F.col("class"))
    return rows.join(roots, F.col("class") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "class").alias("root"))


def _rest(family: DataFrame, postings: DataFrame, links: DataFrame | None, roots: DataFrame | None, tried: DataFrame | None, percent: int, fit: str) -> DataFrame:
    """The links that stars have not connected. A pair that shares a long list is found by the differences of both from the
    list's pivot; any other shares enough hashes in short lists."""
    lists = _rooted(postings, roots)
    mixed = lists.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"), F.max(F.struct("shared", "class")).getField("class").alias("pivot"))
    lists = written(lists.join(mixed.filter("low < high").select("h", "many", "pivot"), "h"), "rest")
    short = lists.filter(F.col("many") <= SHORT)
    other = short.select("h", F.col("class").alias("b"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("root").alias("other"), F.col("shared").alias("common"))
    pairs = short.join(other, "h").filter("root <> other AND class > b").filter(fit)
    pairs = pairs.groupBy(F.col("class").alias("a"), "b").agg(F.count("*").alias("c"), F.first("l").alias("l"), F.first("k").alias("k")).filter("c >= least(l, k)").select("a", "b")
    todo = pairs if tried is None else pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
    found = written(_verified(todo, family, percent), "found")
    members = lists.filter(F.col("many") > SHORT).select("pivot", "class").distinct()
    for depth in range(DEPTH + 1):
        members = written(members, "members")
        if members.isEmpty():
            break
        near, keys = _differences(members, family, percent)
        found = found.union(near)
        every = found if links is None else links.union(found)
        keys = written(_rooted(keys, written(connected(every), "roots")), "differences")
        heavy = keys.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_if("small").alias("smalls"), F.count_if("large").alias("larges"), F.max(F.struct("n", "class")).getField("class").alias("next"))
        work = F.col("smalls") * F.col("larges") > SHORT * (F.col("smalls") + F.col("larges"))
        keys = written(keys.join(heavy.filter("low < high").select("h", "next", (work if depth < DEPTH else F.lit(False)).alias("heavy")), "h"), "lists")
        one = keys.filter("small AND NOT heavy").select("h", "class", "n", "d", "c", "root")
        two = keys.filter("large AND NOT heavy").select("h", F.col("class").alias("b"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("c").alias("f"), F.col("root").alias("other"))
        # dist = d + e - 2 * (differences in common), of which the smaller has c
        reach = f"{100 + percent} * (d + e - 2 * c) <= {100 - percent} * (n + m) AND {100 + percent} * abs(d - e) <= {100 - percent} * (n + m)"
        pairs = one.join(two, "h").filter(f"root <> other AND (c < f OR (c = f AND class < b)) AND {reach}")
        pairs = pairs.select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")).distinct()
        found = written(found.union(_verified(pairs, family, percent)), "found")
        members = keys.filter("heavy").select(F.col("next").alias("pivot"), "class").distinct()
    return found


def _differences(members: DataFrame, family: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """members(pivot, class) to their links with pivots, and to rows (h, class, n, d, c, small, large): the prefixes of their
    differences from the pivot. A class differs from its pivot in d hashes, c of which others of the pivot's members
    differ in, too; h names the pivot and one of these, and small or large tells whether it is in the prefix for pairs in which the
    class has fewer such differences than the other, or more.

    Two classes differ in d + e - 2s hashes, where s of their differences are the same, and link when that is
    at most (100 - percent) / (100 + percent) of n + m. If s may be 0 then both link with the pivot. Else the rarest
    c - s + 1 differences of either hold a common one. s is at least d less that share, and for the smaller
    half of d + c less that share; where the class links with the pivot, the other does not and has more differences."""
    share = (100 - percent) / (100 + percent)
    one = family.select("class", "n", "hashes")
    two = family.select(F.col("class").alias("pivot"), F.col("n").alias("p"), F.col("hashes").alias("center"))
    apart = F.array_union(F.array_except("hashes", "center"), F.array_except("center", "hashes"))
    rows = members.join(one, "class").join(two, "pivot").select("pivot", "class", "n", "p", (F.col("n") + F.col("p") - 2 * F.size(F.array_intersect("hashes", "center"))).alias("d"), apart.alias("apart"))
    rows = written(rows, "apart")
    linked = F.col("d") * (100 + percent) <= (F.col("n") + F.col("p")) * (100 - percent)
    near = rows.filter(linked).filter("class <> pivot").select(F.greatest("class", "pivot").alias("a"), F.least("class", "pivot").alias("b"))
    parts = rows.select("pivot", "class", F.explode("apart").alias("x"))
    often = parts.groupBy("pivot", "x").agg(F.count("*").alias("often")).filter("often > 1")
    widest = rows.groupBy("pivot").agg(F.max("n").alias("widest"))
    kept = parts.join(often.hint("merge"), ["pivot", "x"]).groupBy("pivot", "class").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("xs"))
    rows = rows.drop("apart").join(kept.hint("merge"), ["pivot", "class"]).join(widest, "pivot").withColumn("c", F.size("xs"))
    most = share * (F.col("n") + F.least(F.col("n") * (100.0 / percent), F.col("widest").cast("double")))
    least = F.greatest(F.lit(1.0), F.col("d") - most, F.when(linked, (F.col("d") + share * (F.col("p") - F.col("n"))) / 2).otherwise(F.lit(1.0)))
    whole = lambda x: F.ceil(x - 1e-9).cast("int")
    rows = rows.withColumn("ifsmall", F.col("c") - whole(F.greatest(least, (F.col("d") + F.col("c") - most) / 2)) + 1).withColumn("iflarge", F.col("c") - whole(least) + 1)
    keys = rows.filter("greatest(ifsmall, iflarge) > 0").select("pivot", "class", "n", "d", "c", "ifsmall", "iflarge", F.posexplode(F.slice("xs", F.lit(1), F.greatest("ifsmall", "iflarge"))).alias("at", "x"))
    return near, keys.select(F.xxhash64("pivot", "x.x").alias("h"), "class", "n", "d", "c", (F.col("at") < F.col("ifsmall")).alias("small"), (F.col("at") < F.col("iflarge")).alias("large"))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """classes() with first: the first doc_id and text_hash of the component, nulls last (null for the empty set)."""
    own = written(classes(docs, words), "classes")
    roots = class_links(docs, words, percent)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    least = own.filter("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first"))
    least = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    top = least.groupBy("root").agg(F.min("first").alias("first"))
    return own.join(least.select("class", "root").join(top, "root").select("class", "first"), "class", "left")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    found = _grouped(docs, words, percent)
    return found.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the first by doc_id and text hash. Documents with the empty set all stay."""
    found = written(_grouped(docs, words, percent), "grouped")
    mine = F.col("class").isNull() | ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash")))
    kept = found.filter(mine).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg((F.count("class") > 1).alias("__often"))
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    if kept.filter("__often").isEmpty():
        return rows.select(*docs.columns)
    once = rows.filter("__often").dropDuplicates(["__id", "__hash"])
    return rows.filter("NOT __often").unionByName(once).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + {WORDS - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
