"""A scan end to end."""

from proselens.plans import scan


def test_scan(spark, tmp_path, capsys):
    (tmp_path / "a.ts").write_text(
        "// The socket is a shared handle, and it stays open for the run, so callers reuse it.\nlet a = 1;\n/* const a = find(b);\nif (a) {\n  return [a, b, c];\n} */\n// A plain remark about what the next line is there to do.\n"
    )
    (tmp_path / "b.py").write_text("# The parser — or rather its older twin — keeps every token that it reads.\n")
    (tmp_path / "c.py").write_text("def (\n")
    found, comments, skipped = scan.scan(spark, [str(tmp_path)], enable=("P15",))
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.rule) for r in found.collect())
    assert got == [("a.ts", 1, "P14"), ("a.ts", 3, "C2"), ("b.py", 1, "P15")]
    told = scan.report(found, comments, skipped)
    assert told["summary"]["findings"] == 3 and told["summary"]["skipped"] == 1 and len(told["files"]) == 2
    assert scan.enabled_rules(("C13",), ("C13", "P14")) == {"C2", "P13"}
    assert scan.main([str(tmp_path), "--limit", "1"]) == 1
    assert "1 of 2 findings" in capsys.readouterr().out
    assert scan.main([str(tmp_path / "none")]) == 2


def test_nothing_to_scan(spark, tmp_path):
    found, comments, _ = scan.scan(spark, [f"{tmp_path}/*.ts"])
    assert found.count() == 0 and comments.count() == 0


def test_entry_finds_the_planted_comments(spark):
    import __spark_entry__

    rules = {r.rule for r in __spark_entry__.entry(spark).select("rule").distinct().collect()}
    assert rules == {"C2", "C13", "P13", "P14"}


def test_code_claims_a_comment_though_its_rule_is_off(spark):
    rows = spark.createDataFrame([("code", "The queue — a bounded list of jobs — drains first."), ("prose", "The queue — a bounded list of jobs — drains first.")], "verdict string, text string")
    found = scan.claimed(rows, frozenset({"P15"})).collect()
    assert [(r.verdict, r.rule, r.clauses) for r in found] == [("prose", "P15", ["— a bounded list of jobs —"])]
    assert scan.claimed(rows, frozenset({"C2"})).select("rule").collect() == [("C2",)]
    assert {r.rule for r in scan.claimed(rows).collect()} == {"C2", "C13"}
