"""Cuts, training rows, reports, configuration, ledger and the cache's pointer."""

import json

import pytest
from pyspark.sql import functions as F

from proselens.operators import evaluation, model, training
from proselens.operators.cache import Store
from proselens.sources import ledger
from proselens.sources.files import looks_like_path

TEXTS = [("The cache is the heart of the system.", ["P3"]), ("The parser returns one node.", [])] * 6


def test_model_findings(spark):
    rows = spark.createDataFrame([(i, t, labels) for i, (t, labels) in enumerate(TEXTS)], "id int, text string, labels array<string>")
    fitted = model.fit(rows, ["P3", "P9"])
    found = model.findings(fitted, rows, thresholds={"__scan__": 0.5}).collect()
    assert {r.id % 2 for r in found} == {0} and len(found) == 6 and all(r.rule == "P3" and r.source == "model" and r.score >= 0.5 for r in found)
    scored = {r.id: r.gate for r in fitted.score(rows).collect()}
    # the same by the features and the fitted machine
    featured = fitted.gate.transform(model._featured(fitted.features, rows).cache()).select("id", "probability").collect()
    assert all(abs(scored[r.id] - r.probability[1]) < 1e-9 for r in featured)
    with pytest.raises(model.GatelessError):
        model.findings(None, rows)


def test_cuts():
    assert model.resolve_cut(0.0, {"__scan__": 0.9}, True) == 0.0
    assert model.resolve_cut(None, {"__scan__": 0.9, "__gate__": 0.6}, False) == 0.6
    assert (model.resolve_cut(None, {}, True), model.resolve_cut(None, {}, False)) == (0.70, 0.50)


def test_examples(spark):
    schema = "id int, before string, after string, labels array<string>, labels_agreed array<string>, agreement string"
    pairs = spark.createDataFrame([(1, "b", "a", ["P2", "P1"], ["P1"], "partial"), (2, "b", "a", ["P1"], [], "conflict"), (3, "b", "a", ["P9"], None, None), (4, "b", "a", None, None, None)], schema)
    rows = training.examples(pairs, spark.createDataFrame([(7, "c"), (8, "d")], "id int, text string"), ["P1", "P2"], "id", most_clean=1).collect()
    assert sorted((r.id, r.kind, tuple(r.labels), tuple(r.labels_eval), r.eval_ok) for r in rows if r.kind != "clean") == [
        (1, "after", (), (), True), (1, "before", ("P1", "P2"), ("P1",), True), (2, "after", (), (), True), (2, "before", ("P1",), (), False),
    ]
    assert sum(r.kind == "clean" for r in rows) == 1


def test_coverage():
    found = training.coverage(["P1", "P2", "P3"], {"P1": 0.4, "P2": 1.01}, ["P1", "P2"], 0.5, 0.7, 0.74)
    assert found["untrained"] == ["P3"] and found["silent"] == ["P2"] and json.loads(json.dumps(found)) == found
    assert [x.strip() for x in training.coverage_report(found)[1:]] == ["P1: cut 0.40", "P2: never fires", "P3: not trained"]


def test_shapes_of_revisions(spark):
    rows = spark.createDataFrame([("a — b — c", "a (b) c", 1), ("x", "y", 0), (None, "y", 0)], "b string, a string, n int")
    got = [r[0] for r in rows.select(evaluation.edit_shape(F.col("b"), F.col("a"), F.col("n"))).collect()]
    assert got == ["dash -> parentheses", "something else", "something else"]


def test_paths(tmp_path):
    (tmp_path / "my file").write_text("")
    assert all(looks_like_path(x, frozenset({".ts"})) for x in (str(tmp_path / "my file"), "src/*.py and more", "a b.ts", "word"))
    assert not looks_like_path("a text of words")


def test_configuration(tmp_path):
    (tmp_path / ".proselensrc").write_text('{"threshold": 1, "limit": 3}')
    (tmp_path / ".proselensrc.local").write_text('{"limit": 4 /* mine */}')
    (tmp_path / "deep").mkdir()
    assert ledger.resolve_config(str(tmp_path / "deep")) == {"threshold": 1, "limit": 4}
    for bad in ('{"limit": true}', '{"disableRules": ["X9"]}', '{"languageExtensions": {"ts": "c"}}', '{"threshold": "a"}'):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(ledger.ConfigError):
            ledger.load_config(str(tmp_path / "bad"), rules=frozenset({"P1"}))
    with pytest.raises(ledger.ConfigError):
        ledger.resolve_config(str(tmp_path), given=str(tmp_path / "none"))


def test_ledger_fills_time_and_version(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append_entries(spark.createDataFrame([("x", "text")], "kind string, text string"), path)
    (row,) = ledger.read_entries(spark, path).collect()
    assert row.recorded is not None and row.version == ledger.VERSION and row.rule is None


def test_cache_pointer_is_replaced_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load() is None
    for name, n in (("one", 1), ("two", 2)):
        store.save(spark.range(n), name)
        assert store.load().count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if "CURRENT" in p.name and not p.name.startswith(".")) == ["CURRENT"]
