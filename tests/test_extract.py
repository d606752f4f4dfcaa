"""Lexers, run merge and markdown blocks on small sources."""

import pyarrow as pa

from proselens.operators import extract


def kinds(text):
    return [(c["kind"], c["raw"]) for c in extract.cstyle_comments(text)]


def test_slashes():
    assert kinds("let r = /[/]x/g; // a\n") == [("trailing", "// a")]
    assert kinds("let q = a / b / c; // a\n") == [("trailing", "// a")]
    assert kinds("return /\\/\\/ no/.test(x)\n") == []


def test_strings_and_templates():
    assert kinds("s = '// no'; t = \"/* no */\";\n") == []
    assert kinds("t = `a ${f({b: `// no`}) /* yes */} // no`;\n") == [("block", "/* yes */")]
    assert kinds("s = 'broken\n// yes\n") == [("line", "// yes")]


def test_kinds_and_places():
    found = extract.cstyle_comments("/** d */\n/**/\n  // x\n")
    assert [(c["kind"], c["line"], c["col"], c["end_line"], c["end_col"]) for c in found] == [("doc", 1, 1, 1, 9), ("block", 2, 1, 2, 5), ("line", 3, 3, 3, 7)]


def test_python():
    found = extract.python_comments('"""m"""\nx = 1  # t\n# a\n\n\ndef f():\n    "d"\n')
    assert [(c["kind"], c["line"], c["raw"]) for c in found] == [("doc", 1, "m"), ("trailing", 2, "# t"), ("line", 3, "# a"), ("doc", 7, "d")]


def test_markdown():
    text = "---\na: 1\n---\n# Head\n\nOne\ntwo.\n\n- item\n\n<!-- tool-off -->\nno\n<!-- tool-on -->\n\n```\ncode\n```\n> quote\n"
    assert [(c["line"], c["raw"]) for c in extract.markdown_blocks(text)] == [(4, "Head"), (6, "One two."), (9, "item"), (18, "quote")]


def test_extract_merges_runs_and_reports_bad_files(spark):
    files = [("a.ts", "// one\n// two\n\n// three\nx = 1; // t\n// after\n"), ("b.py", "# one\n# two\nx = 1\n"), ("c.py", "def ("), ("d.txt", "// no"), ("e.ts", None)]
    comments, skipped = extract.extract(spark.createDataFrame(files, "path string, text string"))
    found = sorted((r.path, r.line, r.kind, r.text, r.end_line) for r in comments.collect())
    assert found == [
        ("a.ts", 1, "line", "one\ntwo", 2), ("a.ts", 4, "line", "three", 4), ("a.ts", 5, "trailing", "t", 5), ("a.ts", 6, "line", "after", 6), ("b.py", 1, "line", "one\ntwo", 2),
    ]
    assert [r.path for r in skipped.collect()] == ["c.py"]


def test_definitions_in_any_block_have_docstrings():
    text = 'try:\n    def f():\n        "a"\nexcept E:\n    class A:\n        "b"\nelse:\n    with x:\n        async def g():\n            "c"\nmatch x:\n    case 1:\n        def h():\n            "d"\n'
    assert [c["raw"] for c in extract.python_comments(text)] == ["a", "b", "c", "d"]


def test_a_worker_holds_a_slice_of_files(spark, monkeypatch):
    monkeypatch.setattr(extract, "SLICE_BYTES", 30)
    batch = pa.RecordBatch.from_pydict({"path": list("abcde"), "text": ["x" * 20, "x" * 5, None, "x" * 99, ""]})
    assert [b.num_rows for b in extract._slices(batch, extract.SLICE_BYTES)] == [3, 1, 1]


def test_extract_neither_shuffles_nor_joins_files_of_one_path(spark):
    files = spark.createDataFrame([("a.ts", "// one\n// two\n"), ("a.ts", "\n\n// three\n")], "path string, text string")
    comments = extract.extract(files)[0]
    assert sorted((r.line, r.text, r.end_line) for r in comments.collect()) == [(1, "one\ntwo", 2), (3, "three", 3)]
    assert "Exchange" not in comments._jdf.queryExecution().executedPlan().toString()
