"""Text functions, spans, thresholds, cache and the catalogue on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from proselens.functions import codepoints, normalize, predicates, sentences, silver
from proselens.operators import cache, calibrate, model, ranking, spans
from proselens.plans import catalog


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "kind", "text"),
    [("// a\n//  b", "line", "a\nb"), ("/** a\n * b\n */", "doc", "a\nb"), ("/**/", "block", ""), ("# a\r\n# b", "python", "a\nb"), ("/* a\n * @param x y\n */", "block", "a")],
)
def test_normalize(spark, raw, kind, text):
    assert one(spark, raw, lambda c: normalize.normalize(c, F.lit(kind))) == text


def test_sentences(spark):
    text = 'Mr. A. Smith came.  He left at 3.5! "Why?" (No one knows.) so it goes'
    assert one(spark, text, sentences.split_sentences) == ["Mr. A. Smith came.", "He left at 3.5!", '"Why?', "(No one knows.) so it goes"]
    assert one(spark, "", sentences.split_sentences) == []


def test_codepoints(spark):
    assert one(spark, "a—b😀—é", codepoints.disallowed) == [0x2014, 0x1F600]
    assert codepoints.parse_entry("U+2010-U+2015") == (0x2010, 0x2015)
    for bad in ("2010", "U+2015-U+2010", True, -1, "U+110000"):
        with pytest.raises(codepoints.WhitelistError):
            codepoints.parse_entry(bad)


@pytest.mark.parametrize(
    ("text", "verdict"),
    [("short", "skip"), ("eslint-disable-next-line no-console because of the tests here", "skip"), ("Copyright of the authors, who reserve what they may of it all", "skip"),
     ("const a = find(b);\nif (a) {\n  return [a, b, c];\n}", "code"), ("This sentence says what the next block is there for, in words.", "prose")],
)
def test_verdict(spark, text, verdict):
    assert one(spark, text, lambda c: predicates.verdict(c, c)) == verdict


def test_units_equal_brute_force(spark):
    import random

    random.seed(3)
    ranges = [(k, lo, lo + random.randint(0, 3)) for k in range(20) for lo in random.sample(range(20), 5)]
    merged = spans.merge_intervals(spark.createDataFrame(ranges, "k int, lo int, hi int"), "k").groupBy("k", "unit").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    want = set()
    for k in range(20):
        own: list[list[int]] = []
        for lo, hi in sorted((lo, hi) for key, lo, hi in ranges if key == k):
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
        want |= {(k, lo, hi) for lo, hi in own}
    assert {(r.k, r.lo, r.hi) for r in merged} == want


def test_cuts_break_ties_each_their_way(spark):
    rows = spark.createDataFrame([(0.9, 1, "R"), (0.8, 1, "R"), (0.3, 0, "R"), (0.1, 0, "R"), (0.5, 0, "S")], "p double, y int, rule string")
    assert calibrate.gate_cut(rows.filter("rule = 'R'")).first().gate_cut == 0.3
    assert {r.rule: r.rule_cut for r in calibrate.rule_cuts(rows).collect()} == {"R": 0.79, "S": 1.01}
    assert calibrate.gate_cut(rows.filter("y = 0")).first().gate_cut == 0.95


def test_top_rules(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.9],)], "probs array<double>")
    best = df.select(ranking.top_rules(["A", "B", "C"], F.col("probs"), 2).alias("x"), ranking.top_rules(["A", "B", "C"], F.col("probs"), None, ("B",)).alias("y")).first()
    assert [r.rule for r in best.x] == ["B", "C"]
    assert [r.rule for r in best.y] == ["C", "A"]


def test_second_scan_reads_nothing(spark, tmp_path):
    files = cache.stamped(spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary"), cache.run_key("v", {"x": 1}))
    store = cache.Store(spark, str(tmp_path))
    assert store.load() is None
    store.save(files.select(*cache.KEY, F.lit(0).alias("n")), "s1")
    assert cache.misses(files, store.load()).count() == 0
    assert cache.misses(files.withColumn("stamp", F.lit("new")), store.load()).count() == 2
    assert cache.pruned(store.load(), files.filter("path = 'a'")).count() == 1


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.oracle_sql()) >= 60


def _tables(spark, tmp_path, texts):
    rows = [(k, text, "en", f"s{k % 3}", len(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_letter_counts_cover_all_texts(spark, tmp_path):
    found = catalog.queries()["char_wb_counts"](spark, _tables(spark, tmp_path, ["ab", "ab", "abc", "ab"])).collect()
    assert {(r.gram, r.n) for r in found} == {(" ab", 4), ("ab ", 3), ("abc", 1), ("bc ", 1)}


def test_report_fields_cover_all_findings(spark, tmp_path):
    texts = ["x" * n for n in range(1, 1001)]
    found = {r.doc_id: r.tag for r in catalog.queries()["report_fields"](spark, _tables(spark, tmp_path, texts)).collect()}
    want = lambda k, n: "code" if k % 9 == 0 else "flag" if k % 7 == 0 else f"{n * 37 % 1000 / 1000:.2f}"
    assert found == {k: want(k, n) for k, n in enumerate(map(len, texts))}


def test_labels_and_abbreviations_come_from_whole_texts(spark, tmp_path):
    far = "word " * 100
    d = _tables(spark, tmp_path, ["one.", f"{far}It cannot be that this is not so. {far}e.g. Mr. Smith."])
    found = {r.doc_id: r.labels for r in catalog.queries()["silver_labels"](spark, d).collect()}
    assert "P5" in found[1]
    view = {r.doc_id: r.view for r in catalog.queries()["abbrev_protect"](spark, d).collect()}
    assert view[1].endswith("e|g| Mr| Smith.")
    assert catalog.queries()["revision_histogram"](spark, d).agg(F.sum("n")).first()[0] == 2


def test_no_term_is_dropped(spark):
    words = [f"w{i}" for i in range(270_000)]
    df = spark.createDataFrame([(words,), (words[::-1],), (["w1", "rare"],)], "words array<string>")
    branch = model.fit_branch(df, "words", 2)
    assert len(branch.counter.vocabulary) == len(branch.idf) == 270_000


def test_empty_documents_have_no_spans(spark, tmp_path):
    d = _tables(spark, tmp_path, ["", "x" * 250])
    run = lambda name: catalog.queries()[name](spark, d)
    assert {r.doc_id for name in ("span_sentence_overlap", "interval_merge", "unit_naming") for r in run(name).collect()} == {1}
    left = {r.doc_id: r.n for r in run("unclaimed_sentences").collect()}
    assert left[0] == 1


@pytest.mark.parametrize(
    ("before", "after", "labels"),
    [("It is the end.", "La casa ídoes poco.", ["P3", "P6"]), ("is the end", "It paſſes.", ["P3"]), ("No: elſe", "No", ["P7"]), ("\xa0It ends.", "One ends.", []),
     ("\x0bIt ends.", "One ends.", ["P6"]), ("ends,\x0bas one", "ends", []), ("`a.md`\x0b§", "", ["P12"])],
)
def test_silver_labels_read_words_and_blanks_as_sql(spark, before, after, labels):
    row = spark.createDataFrame([(before, after)], "b string, a string")
    assert row.select(silver.silver_labels(F.col("b"), F.col("a"))).first()[0] == labels


def test_a_head_with_the_labels_of_the_gate_is_the_gate(spark):
    rows = [("good words here", []), ("bad words there", ["A"]), ("good words again", []), ("bad words again", ["A"])] * 2
    fitted = model.fit(spark.createDataFrame(rows, "text string, labels array<string>"), ["A", "B"])
    assert fitted.heads["A"] is fitted.gate
    assert fitted.heads["B"] is None
