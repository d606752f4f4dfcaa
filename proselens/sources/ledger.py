"""Feedback ledger, configuration and rule taxonomy."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2"
ENTRY = "kind string, recorded timestamp, version string, text string, rule string, note string, revision string"


def append_entries(entries: DataFrame, path: str) -> None:
    """Adds to the ledger, with the time and this version where they are not given; other missing fields are null."""
    own = {"recorded": F.current_timestamp(), "version": F.lit(VERSION)}
    columns = [(n, own.get(n, F.lit(None)).cast(kind)) for n, kind in (x.split() for x in ENTRY.split(", "))]
    have = set(entries.columns)
    entries.select(*[(F.coalesce(F.col(n), c) if n in own else F.col(n)).alias(n) if n in have else c.alias(n) for n, c in columns]).write.mode("append").json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)


class ConfigError(ValueError):
    pass


#: Configuration keys and their types.
KEYS = {
    "extends": str, "threshold": float, "limit": int, "minLength": int, "disableRules": list, "enableRules": list, "exclude": list, "ignorePath": list,
    "unicodeWhitelist": list, "markdown": bool, "markdownFiles": list, "languageExtensions": dict, "splitSentences": bool, "withNodeModules": bool,
    "showCode": bool, "cache": bool, "cacheLocation": str, "cacheStrategy": str, "backend": str,
}


def strip_comments(text: str) -> str:
    """// and /* */ outside strings as blanks, so offsets stay."""
    pattern = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    return pattern.sub(lambda m: m.group() if m.group()[0] == '"' else re.sub(r"[^\n]", " ", m.group()), text)


def _is(value: object, kind: type) -> bool:
    """Whole numbers are numbers, and true and false are not."""
    return isinstance(value, (int, float) if kind is float else kind) and (kind is bool or not isinstance(value, bool))


def load_config(path: str, seen: tuple[str, ...] = (), rules: frozenset[str] | None = None) -> dict:
    """A file over what it extends; unknown keys, wrong types, cycles and, where rules are given, unknown rules are errors."""
    path = os.path.abspath(path)
    if path in seen:
        raise ConfigError(f"{path} extends itself")
    try:
        with open(path, encoding="utf-8-sig") as f:
            own = json.loads(strip_comments(f.read()))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(own, dict) or (unknown := sorted(set(own) - set(KEYS) - {"$schema"})):
        raise ConfigError(f"{path}: {'not an object' if not isinstance(own, dict) else f'unknown keys {unknown}'}")
    for key, value in own.items():
        if key in KEYS and not _is(value, KEYS[key]):
            raise ConfigError(f"{path}: {key} must be {KEYS[key].__name__}")
        if key in ("disableRules", "enableRules") and rules is not None and (unknown := sorted(set(value) - rules)):
            raise ConfigError(f"{path}: {key} names unknown rules {unknown}")
        if key == "languageExtensions" and not all(k.startswith(".") and isinstance(v, str) for k, v in value.items()):
            raise ConfigError(f"{path}: {key} maps extensions with their dot to languages")
    parent = own.pop("extends", None)
    return (load_config(os.path.join(os.path.dirname(path), parent), (*seen, path), rules) if parent else {}) | own


def resolve_config(start: str, given: str | None = None, name: str = ".proselensrc", local: str = ".proselensrc.local", rules: frozenset[str] | None = None) -> dict:
    """The named file, or the nearest at or above a folder, under a local file beside it."""
    if given and not os.path.isfile(given):
        raise ConfigError(f"{given}: no such file")
    path = given or find_config(start, name)
    if path is None:
        return {}
    beside = os.path.join(os.path.dirname(os.path.abspath(path)), local)
    return load_config(path, rules=rules) | (load_config(beside, rules=rules) if os.path.isfile(beside) else {})


def find_config(start: str, name: str = ".proselensrc") -> str | None:
    folder = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(folder, name)):
            return os.path.join(folder, name)
        if (above := os.path.dirname(folder)) == folder:
            return None
        folder = above


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a taxonomy file: id, name, desc."""
    schema = "version int, source string, rules array<struct<id:string,name:string,desc:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Before and after texts with their labels, a JSON line each."""
    return spark.read.schema("repo string, commit string, file string, before string, after string, labels array<string>, labels_agreed array<string>, agreement string, source string").option("mode", "FAILFAST").json(path)
