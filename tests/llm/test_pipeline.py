"""The pipeline and the registry."""

import pytest

import corpus_pipeline
from proselens.llm import registry


def test_registry():
    assert [min(n for n in registry.QUERIES if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages_keep_the_columns(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(k, f"{text} d{k}" if k < 3 else " ".join(f"x{k}y{i}" for i in range(60)), "en", f"s{k % 2}", 0) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    kept = {r.doc_id for r in now.collect()}
    assert kept == {0, *range(3, 12)} - {5}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= kept


def test_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, words int, h long, root string, n int, label int, fp long, size int, found string"
    own = lambda k, text, source: (k, text, "en", source, 0, "mine", 1, 2, "r", 3, 4, 5, 6, "f")
    prose = lambda k: " ".join(f"x{k}y{i}" for i in range(60))
    rows = [own(1, prose(1), "a"), own(1, prose(1), "a"), own(None, prose(2), None), own(None, None, None), own(None, None, None), own(3, "", "b"), own(4, prose(4) + "\n" + prose(1), "b"), own(5, prose(5) * 400, "a")]
    for name, own_rows in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own_rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, None), (None, 1, 1)] if own_rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, prose(9))] if own_rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        found = out.collect()
        assert out.columns == [*[c for c in schema.replace(",", "").split()[::2] if c != "copy"], "copy"]
        assert all(r.copy in (1, 2) and r.text for r in found) and {r.doc_id for r in found} <= {1, 4, 5, None}
        assert bool(found) == bool(own_rows)


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"])
def test_names(name):
    assert name in dict(corpus_pipeline.STAGES)
