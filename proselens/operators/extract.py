"""Comments out of source files (E1-E16): lexers as Arrow functions that merge each file's runs; merges over tables as windows."""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions.normalize import normalize

COMMENT = {"line": pa.int32(), "col": pa.int32(), "kind": pa.string(), "raw": pa.string(), "end_line": pa.int32(), "end_col": pa.int32()}

#: Bytes of source that a lexer's rows are gathered over, unless one file alone is longer.
SLICE_BYTES = 1 << 20

#: Extensions by language family.
FAMILIES = {
    "c-style": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"),
    "python-style": (".py", ".pyi"),
    "markdown": (".md", ".markdown"),
}

#: Keywords after which a slash opens a regular expression, not a division.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())

#: What a pass over C-style text skips at once: in code, and in code of an interpolation, where braces count.
_CODE, _INNER = re.compile(r"[^/'\"`]+"), re.compile(r"[^/'\"`{}]+")
_QUOTED = {q: re.compile(rf"(?s)(?:[^{q}\\\n]++|\\.)*+{q}?") for q in "'\""}
_TEMPLATE = re.compile(r"(?s)(?:[^`\\$]++|\\.|\$(?!\{))*+")
_LINE_END = re.compile(r"[\r\n]")

Piece = tuple[int, int, str]


class CStyle:
    """One pass over a source text with a stack of template literals."""

    def __init__(self, text: str):
        self.text, self.at, self.found = text, 0, []
        #: What stood before: "" nothing, "v" a value, "k" a keyword before an expression, else one character.
        self.before = ""
        self.depths: list[int] = []  # open braces in each ${ } that we are in

    def run(self) -> list[Piece]:
        text = self.text
        while self.at < len(text):
            if m := (_INNER if self.depths else _CODE).match(text, self.at):
                self.at = m.end()
                self._passed(m.group().rstrip())
                continue
            c, two = text[self.at], text[self.at : self.at + 2]
            if two == "//":
                m = _LINE_END.search(text, self.at)
                self._take(m.start() if m else len(text), "line")
            elif two == "/*":
                stop = text.find("*/", self.at + 2)
                stop = len(text) if stop < 0 else stop + 2
                doc = text.startswith("/**", self.at) and not text.startswith("/**/", self.at)
                self._take(stop, "doc" if doc else "block")
                self.before = ""
            elif c in "'\"":
                self.at = _QUOTED[c].match(text, self.at + 1).end()
                self.before = "v"
            elif c == "`":
                self.at += 1
                self._template()
            elif c == "/" and self._regex_may_start() and (stop := self._regex_end()):
                self.at, self.before = stop, "v"
            else:
                self.at += 1
                if c == "{":
                    self.depths[-1] += 1
                elif c == "}":
                    if not self.depths[-1]:
                        self.depths.pop()
                        self._template()
                        continue
                    self.depths[-1] -= 1
                self.before = c
        return self.found

    def _take(self, stop: int, kind: str) -> None:
        self.found.append((self.at, stop, kind))
        self.at = stop

    def _passed(self, code: str) -> None:
        """Notes what code ends with, if it is not blank."""
        start = len(code)
        while start and (code[start - 1].isalnum() or code[start - 1] in "_$"):
            start -= 1
        if start < len(code):
            self.before = "k" if code[start:] in _BEFORE_REGEX else "v"
        elif code:
            self.before = code[-1]

    def _template(self) -> None:
        """From inside a template to its end, or to its next interpolation."""
        self.at = _TEMPLATE.match(self.text, self.at).end()
        if self.text.startswith("`", self.at):
            self.at += 1
            self.before = "v"
        elif self.text.startswith("${", self.at):
            self.at += 2
            self.depths.append(0)
            self.before = ""
        else:
            self.at = len(self.text)  # no end, or a backslash at the end

    def _regex_may_start(self) -> bool:
        return self.before in ("", "k") or self.before in "(,=:[!&|?{};+-*%<>~^"

    def _regex_end(self) -> int | None:
        """Behind a regular-expression literal and its flags; None where a line ends first."""
        i, in_class = self.at + 1, False
        while i < len(self.text) and self.text[i] != "\n":
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c in "[]":
                in_class = c == "["
            elif c == "/" and not in_class:
                i += 1
                while i < len(self.text) and self.text[i].isalpha():
                    i += 1
                return i
            i += 1
        return None


def cstyle_comments(text: str) -> list[dict]:
    """Pieces with lines and columns; a line comment behind code is trailing."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def where(offset: int) -> tuple[int, int]:
        row = bisect.bisect_right(starts, offset) - 1
        return row + 1, offset - starts[row] + 1

    out = []
    for a, b, kind in CStyle(text).run():
        (line, col), (end_line, end_col) = where(a), where(b)
        if kind == "line" and text[starts[line - 1] : a].strip():
            kind = "trailing"
        out.append({"line": line, "col": col, "kind": kind, "raw": text[a:b], "end_line": end_line, "end_col": end_col})
    return out


def python_comments(text: str) -> list[dict]:
    """Hash comments by tokens, docstrings by syntax tree (columns of the latter count bytes)."""
    out = []
    lines = text.splitlines()
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            (row, col), (_, end) = token.start, token.end
            kind = "trailing" if lines[row - 1][:col].strip() else "line"
            out.append({"line": row, "col": col + 1, "kind": kind, "raw": token.string, "end_line": row, "end_col": end + 1})
    nodes = [ast.parse(text)]
    while nodes:
        node = nodes.pop()
        for block in ("body", "orelse", "finalbody", "handlers", "cases"):  # definitions stand in blocks of statements only
            nodes += getattr(node, block, ())
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, clean=False) is not None:
            value = node.body[0].value
            out.append({"line": value.lineno, "col": value.col_offset + 1, "kind": "doc", "raw": value.value, "end_line": value.end_lineno, "end_col": value.end_col_offset + 1})
    return sorted(out, key=lambda c: (c["line"], c["col"]))


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}#{1,6}(?:\s+(.*?))?(?:\s+#+)?\s*$")
_RULE = re.compile(r"^ {0,3}(?:([-*_])[ \t]*)(?:\1[ \t]*){2,}$")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)\s*$")
_ITEM = re.compile(r"^( *)(?:[-*+]|\d{1,9}[.)])(?:\s+|$)")
_HTML = re.compile(r"^ {0,3}<(?:/?[A-Za-z][^>]*>?|!--)")
_OFF, _ON = re.compile(r"<!--\s*\w+-off\s*-->"), re.compile(r"<!--\s*\w+-on\s*-->")  # of any tool's name


def markdown_blocks(text: str) -> list[dict]:
    """Paragraphs, headings, list items and quotes as single-spaced prose. Fences, indented code and HTML are left out."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[0] == "---" and (close := next((i for i, x in enumerate(lines[1:], 1) if x in ("---", "...")), None)):
        lines[: close + 1] = [""] * (close + 1)  # E13
    dead, off = [], False
    for x in lines:  # E14
        off = off or "-off" in x and bool(_OFF.search(x))
        dead.append(off)
        off = off and not _ON.search(x)
    out: list[dict] = []
    held: list[str] = []
    begin, fence, html = 0, "", False

    def close_block(end: int) -> None:
        if held and not any(dead[begin:end]):  # E15
            out.append({"line": begin + 1, "col": 1, "kind": "prose", "raw": " ".join(" ".join(held).split()), "end_line": end, "end_col": len(lines[end - 1]) + 1})
        held.clear()

    for i, line in enumerate(lines):
        inner = re.sub(r"^( {0,3}>\s?)+", "", line) if ">" in line else line
        if fence:
            if (m := _FENCE.match(inner)) and m[1].startswith(fence):
                fence = ""
            continue
        if html:
            html = bool(inner.strip())
            continue
        if m := _FENCE.match(inner):
            close_block(i)
            fence = m[1]
        elif not inner.strip():
            close_block(i)
        elif _HTML.match(inner) and not held:
            html = True
        elif held and _UNDERLINE.match(inner):
            close_block(i + 1)
        elif _RULE.match(inner):
            close_block(i)
        elif m := _HEADING.match(inner):
            close_block(i)
            if m[1]:
                begin = i
                held.append(m[1])
                close_block(i + 1)
        elif m := _ITEM.match(inner):
            close_block(i)
            begin = i
            held.append(inner[m.end() :])
        elif not held and re.match(r"^(?: {4}|\t)", inner):
            continue
        else:
            if not held:
                begin = i
            held.append(inner)
    close_block(len(lines))
    return out


LEXERS = {"c-style": cstyle_comments, "python-style": python_comments, "markdown": markdown_blocks}


def merged(comments: list[dict]) -> list[dict]:
    """E7 over the comments of one file, in order of place: line comments on lines one after another at one column become one comment."""
    out: list[dict] = []
    for c in comments:
        last = out[-1] if out else None
        if last and c["kind"] == last["kind"] == "line" and c["col"] == last["col"] and c["line"] == last["end_line"] + 1:
            last["raws"].append(c["raw"])
            last |= {"end_line": c["end_line"], "end_col": c["end_col"]}
        else:
            out.append(c | {"raws": [c["raw"]]})
    for c in out:
        c["raw"] = "\n".join(c.pop("raws"))
    return out


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    begin = total = 0
    for i, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if i > begin and total + (size or 0) > most:
            yield batch.slice(begin, i - begin)
            begin = i
            total = 0
        total += size or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def lexed(files: DataFrame, family: str) -> DataFrame:
    """files(path, text) of one family to a row a comment, runs merged, or for a file that does not parse one with its error (E11). A file's
    comments are gathered with those of a slice of files, so a worker's memory does not grow with its input."""
    lex = LEXERS[family] if family == "markdown" else lambda text, own=LEXERS[family]: merged(own(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _slices(batch)):
            at, rows, errors = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                try:
                    found, error = lex(text or ""), None
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError) as e:
                    found, error = [{}], f"{type(e).__name__}: {e}"
                rows += found
                at += [i] * len(found)
                errors += [error] * len(found)
            columns = [pa.array([c.get(k) for c in rows], kind) for k, kind in COMMENT.items()]
            yield pa.RecordBatch.from_arrays([part.column("path").take(pa.array(at, pa.int64())), *columns, pa.array(errors, pa.string())], names=["path", *COMMENT, "error"])

    return files.select("path", "text").mapInArrow(run, "path string, line int, col int, kind string, raw string, end_line int, end_col int, error string")


def family_of(path, extra: dict[str, str] | None = None):
    """Built-in extensions come before extra ones."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = None
    for name, own in [*FAMILIES.items(), *((f, (e.lower(),)) for e, f in (extra or {}).items())]:
        out = F.when(extension.isin(*own), name) if out is None else out.when(extension.isin(*own), name)
    return out


def merge_runs(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Line comments on lines one after another at one column become one comment; gaps and islands by window."""
    order = Window.partitionBy(*keys).orderBy("line", "col")
    follows = (F.col("kind") == "line") & (F.lag("kind").over(order) == "line") & (F.lag("col").over(order) == F.col("col")) & (F.lag("end_line").over(order) + 1 == F.col("line"))
    runs = comments.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "raw")))
    return runs.groupBy(*keys, "run").agg(
        F.min("line").alias("line"),
        F.first("col").alias("col"),
        F.first("kind").alias("kind"),
        F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("raw"),
        F.max(F.struct("end_line", "end_col")).alias("end"),
    ).select(*keys, "line", "col", "kind", "raw", F.col("end.end_line").alias("end_line"), F.col("end.end_col").alias("end_col"))


def extract(files: DataFrame, extra: dict[str, str] | None = None, markdown: bool = True) -> tuple[DataFrame, DataFrame]:
    """files(path, text) to comments (path, line, col, kind, raw, text, end_line, end_col) and skipped files (path, reason)."""
    known = files.withColumn("family", family_of(F.col("path"), extra))
    comments = skipped = None
    for family in LEXERS:
        if family == "markdown" and not markdown:
            continue
        found = lexed(known.filter(F.col("family") == family), family)
        bad = found.filter("error IS NOT NULL").select("path", F.col("error").alias("reason"))
        rows = found.filter("error IS NULL").drop("error")
        shape = F.when(F.lit(family == "python-style") & (F.col("kind") != "doc"), "python").when(F.lit(family == "python-style"), "docstring").otherwise(F.col("kind"))
        rows = rows.withColumn("text", F.col("raw") if family == "markdown" else normalize(F.col("raw"), shape))
        comments = rows if comments is None else comments.unionByName(rows)
        skipped = bad if skipped is None else skipped.unionByName(bad)
    return comments.select("path", "line", "col", "kind", "raw", "text", "end_line", "end_col"), skipped
