"""Discovery against git's own rules, globs, configuration and the ledger."""

import json
import os
import subprocess

import pytest

from proselens.sources import files, ledger

TREE = {".gitignore": "*.log\nbuild/\n!keep.log\n/top.ts\n", "a.ts": "", "top.ts": "", "sub/top.ts": "", "build/x.ts": "", "sub/.gitignore": "!b.log\nc.ts\n", "sub/c.ts": "", "sub/d/e.ts": "", "node_modules/m.ts": ""}


@pytest.fixture
def tree(tmp_path):
    for name, body in TREE.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return tmp_path


def test_walk_equals_git(tree):
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    found = {os.path.relpath(p, tree) for p in files.discover([str(tree)])}
    for name in (n for n in TREE if n.endswith(".ts") and "node_modules" not in n):
        ignored = subprocess.run(["git", "-C", str(tree), "check-ignore", "-q", name], check=False).returncode == 0
        assert (name in found) == (not ignored), name
    assert "node_modules/m.ts" not in found


def test_arguments(tree):
    assert [os.path.relpath(p, tree) for p in files.discover([f"{tree}/sub/c.ts", f"{tree}/**/e.ts", f"{tree}/sub/c.ts"])] == ["sub/c.ts", "sub/d/e.ts"]
    assert files.discover([f"{tree}/none/*.ts"]) == []
    with pytest.raises(FileNotFoundError):
        files.discover([f"{tree}/none"])


def test_read(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"\xef\xbb\xbf// a\r\n")
    row = files.read_files(spark, [str(tmp_path / "a.ts")]).first()
    assert row.text == "// a\r\n"


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"limit": 3, /* n */ "exclude": ["a//b"]}')
    (tmp_path / ".proselensrc").write_text('{"extends": "base.json", "limit": 5} // end')
    assert ledger.load_config(ledger.find_config(str(tmp_path))) == {"limit": 5, "exclude": ["a//b"]}
    (tmp_path / "bad.json").write_text(json.dumps({"nope": 1}))
    with pytest.raises(ledger.ConfigError):
        ledger.load_config(str(tmp_path / "bad.json"))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_entries(spark, path).count() == 0
    ledger.append_entries(spark.createDataFrame([("miss", "text")], "kind string, text string"), path)
    ledger.append_entries(spark.createDataFrame([("hit", "other", "P3")], "kind string, text string, rule string"), path)
    assert {(r.kind, r.rule) for r in ledger.read_entries(spark, path).collect()} == {("miss", None), ("hit", "P3")}
