"""A scan of source trees: files to comments to ranked findings, and its report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions import codepoints, predicates
from proselens.operators import checkers, extract, ranking
from proselens.sources.files import discover, read_files

#: Rules that are off unless enabled.
DISABLED = frozenset({"C10", "C11", "C13", "P4", "P10", "P15"})

_FINDING = ["path", "line", "col", "end_line", "end_col", "kind", "rule", "score", "text", "source", "clauses"]


def enabled_rules(enable: tuple[str, ...] = (), disable: tuple[str, ...] = ()) -> frozenset[str]:
    """of the rules that need no model; disabling wins."""
    return (frozenset({"C2", "C13", *checkers.ORDER}) - (DISABLED - set(enable))) - set(disable)


def claimed(rows: DataFrame, rules: frozenset[str] = frozenset({"C2", "C13", *checkers.ORDER}), whitelist: list[tuple[int, int]] | None = None) -> DataFrame:
    """F8: rows (text, verdict) on which a rule fires, with rule, score, source and clauses. Code claims a row even if its rule is
    off, then code points, then the first checker that fires. One pass without a shuffle: a checker sees only
    texts that nothing has claimed and that its pre-filter passes."""
    text, none = F.col("text"), F.array().cast("array<string>")
    own = tuple(r for r in checkers.ORDER if r in rules)
    prose = F.col("verdict") == "prose"
    points = F.when(prose, F.transform(codepoints.disallowed(text, whitelist), codepoints.hexadecimal)) if "C13" in rules else F.lit(None).cast("array<string>")
    rows = rows.withColumn("__points", points)
    marked = F.coalesce(F.size("__points") > 0, F.lit(False))
    if own:
        rows = rows.withColumn("__left", F.when(prose & ~marked & checkers.prefilter(text, own), text))
        # not deterministic to Catalyst, which would push the filter below, and the function with it, to run twice
        rows = rows.withColumn("__fired", checkers.first_firing(own).asNondeterministic()("__left"))
    else:
        rows = rows.withColumn("__fired", F.lit(None).cast(f"struct<rule:string,spans:{checkers.SPAN}>"))
    code = F.col("verdict") == "code"
    rule = F.when(code, F.lit("C2") if "C2" in rules else F.lit(None)).when(marked, "C13").otherwise(F.col("__fired.rule"))
    clauses = F.when(code, none).when(marked, F.col("__points")).otherwise(checkers.clauses_of(F.col("__fired.spans")))
    out = rows.withColumns({"rule": rule, "score": F.lit(1.0), "source": F.lit("heuristic"), "clauses": clauses})
    return out.filter("rule IS NOT NULL").drop("__points", "__left", "__fired")


def findings(comments: DataFrame, rules: frozenset[str], whitelist: list[tuple[int, int]] | None = None, min_length: int = 0) -> DataFrame:
    """The findings of comments, in the report's columns."""
    text = F.col("text")
    verdict = F.when(F.col("kind") == "prose", predicates.markdown_verdict(text)).otherwise(predicates.verdict(text, F.col("raw")))
    rows = comments.filter(F.length("text") >= min_length).withColumn("verdict", verdict)
    return claimed(rows, rules, whitelist).select(*_FINDING).withColumn("seq", F.lit(0))


def report(found: DataFrame, comments: DataFrame, skipped: DataFrame) -> dict:
    """Files with their findings in order, and counts. The report is for a reader, so it is gathered here."""
    files = [{"path": r.path, "findings": [json.loads(x) for x in r.found]} for r in found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "col", F.to_json(F.struct(*_FINDING[1:])).alias("j")))).alias("f")).select("path", F.transform("f", lambda x: x["j"]).alias("found")).orderBy("path").collect()]
    counts = ranking.summary(found, comments).first().asDict()
    bad = [{"path": r.path, "reason": r.reason} for r in skipped.orderBy("path").collect()]
    return {"version": 1, "files": files, "summary": counts | {"skipped": len(bad)}, "skipped": bad}


def scan(spark: SparkSession, paths: list[str], enable: tuple[str, ...] = (), disable: tuple[str, ...] = (), exclude: tuple[str, ...] = (), markdown: bool = False, min_length: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, comments and skipped files of some paths."""
    listed = discover(paths, list(exclude), markdown=markdown)
    files = read_files(spark, listed).select("path", "text") if listed else spark.createDataFrame([], "path string, text string")
    comments, skipped = extract.extract(files)
    return findings(comments, enabled_rules(enable, disable), min_length=min_length), comments, skipped


def main(argv: list[str] | None = None) -> int:
    """Prints findings, worst first; the exit code is 1 if there are any, 2 for wrong arguments."""
    parser = argparse.ArgumentParser(prog="proselens", allow_abbrev=False)
    parser.add_argument("paths", nargs="+")
    for flag in ("enable", "disable", "exclude"):
        parser.add_argument(f"--{flag}", action="append", default=[])
    parser.add_argument("--markdown", action="store_true")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--show-code", action="store_true")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--min-length", type=int, default=0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("proselens").getOrCreate()
    try:
        found, comments, skipped = scan(spark, args.paths, tuple(args.enable), tuple(args.disable), tuple(args.exclude), args.markdown, args.min_length)
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 2
    found = found.cache()
    total = found.count()
    if args.json:
        print(json.dumps(report(found, comments, skipped), indent=2))
    else:
        shown = ranking.limited(ranking.report_order(found, args.show_code), args.limit).collect()
        for r in shown:
            print(f"{r.path}:{r.line}:{r.col} {r.rule} {' | '.join(r.clauses)}")
        print(f"{len(shown)} of {total} findings shown")
    return int(total > 0)


if __name__ == "__main__":
    sys.exit(main())
