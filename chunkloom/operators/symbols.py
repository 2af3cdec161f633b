"""Symbols of source files by line patterns and scopes, and the indexes over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import py_lines
from chunkloom.operators.segment import size

Symbol = tuple[str, str, int, str | None]  # name, type, line from 0, parent

_RUST_FN = re.compile(r"(?:pub )?(?:(?:async|const|unsafe) )?fn ([^(<\s]+)")
_RUST_TYPE = re.compile(r"(?:pub )?(struct|enum|trait|type) ([^<{(\s]+)")
_RUST_IMPL = re.compile(r"impl [\s<]*(?:.*? for )?([^<{\s]+)")
_PY_CLASS, _PY_DEF = re.compile(r"class ([^(:\s]+)"), re.compile(r"(?:async )?def ([^(\s]+)")
_JS_CLASS = re.compile(r"(?:export )?class ([^{ <]+)")
_JS_ARROW = re.compile(r"(?:const|let|var) ([^ =:]+)(?=.*=>)")
_JS_FN = re.compile(r"(?:export )?(?:async )?function ([^(<\s]+)")
_TS_TYPE = re.compile(r"(?:export )?(?:interface|type) ([^<{=\s]+)")


def _callable(scope: str | None) -> str:
    return "method" if scope else "function"


def rust(text: str) -> Iterator[Symbol]:
    """Functions are methods while an impl is open; any line that is just ``}`` closes it."""
    scope: str | None = None
    for n, row in enumerate(map(str.strip, py_lines(text))):
        if row.startswith("impl "):
            scope = m[1] if (m := _RUST_IMPL.match(row)) else scope
        elif row == "}":
            scope = None
        if m := _RUST_FN.match(row):
            yield m[1], _callable(scope), n, scope
        if m := _RUST_TYPE.match(row):
            yield m[2], m[1], n, None


def python(text: str) -> Iterator[Symbol]:
    """A class stays open while lines are indented deeper than it."""
    scope, depth = None, 0
    for n, line in enumerate(py_lines(text)):
        row, indent = line.strip(), size(line) - size(line.lstrip())
        if row.startswith("class "):
            if m := _PY_CLASS.match(row):
                scope, depth = m[1], indent
                yield scope, "class", n, None
        elif scope and row and indent <= depth:
            scope = None
        if m := _PY_DEF.match(row):
            yield m[1], _callable(scope), n, scope


def javascript(text: str) -> Iterator[Symbol]:
    """A class stays open up to a line that is just ``}``."""
    scope: str | None = None
    for n, row in enumerate(map(str.strip, py_lines(text))):
        if m := _JS_CLASS.match(row):
            scope = m[1]
            yield scope, "class", n, None
        if m := _JS_ARROW.match(row) or _JS_FN.match(row):
            yield m[1], _callable(scope), n, scope
        if m := _TS_TYPE.match(row):
            yield m[1], "interface", n, None
        if row == "}":
            scope = None


_BY_LANGUAGE: dict[str, Callable[[str], Iterator[Symbol]]] = {"rust": rust, "python": python} | dict.fromkeys(("javascript", "typescript", "jsx", "tsx"), javascript)


def extract(text: str, language: str | None) -> list[Symbol]:
    """By the language, or by what the text holds where that is another or none."""
    found = _BY_LANGUAGE.get(language or "")
    if not found:
        for reader, hints in ((rust, ("fn ", "->")), (python, ("def ", "self"))):
            if all(h in text for h in hints):
                found = reader
                break
        else:
            found = javascript if "function" in text or "=>" in text else None
    return list(found(text)) if found else []


_IMPORTS = {
    "rust": re.compile(r"(?:pub )?use ([\w:]+?)(?:::(\{[^}]*\}|\*))?;"),
    "python": re.compile(r"from ([\w.]+) import (.+)|import ([\w.]+)"),
    "javascript": re.compile(r"import (?:(\*|[\w{},\s]+?)(?: as \w+)? from )?['\"]([^'\"]+)['\"]"),
}


def imports(text: str, language: str | None) -> list[tuple[str, list[str], bool]]:
    """(module path, imported names, whether all are) of import lines."""
    out = []
    for row in map(str.strip, py_lines(text)):
        if language == "rust" and (m := _IMPORTS["rust"].match(row)):
            what = m[2] or ""
            out.append((m[1], [x.strip() for x in what.strip("{}").split(",") if x.strip() and x.strip() != "*"], what == "*"))
        elif language == "python" and (m := _IMPORTS["python"].match(row)):
            names = [x.strip() for x in (m[2] or "").strip("()").split(",") if x.strip()]
            out.append((m[1] or m[3], [x for x in names if x != "*"], "*" in names))
        elif _BY_LANGUAGE.get(language or "") is javascript and (m := _IMPORTS["javascript"].match(row)):
            what = m[1] or ""
            out.append((m[2], [x.strip() for x in what.strip("{} ").split(",") if x.strip() and x.strip() != "*"], what == "*"))
    return out


def _narrow(files: DataFrame) -> DataFrame:
    return files.filter(F.length("content") > 0).select("path", "content", "language")


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, symbol_type, line, parent) of files (path, content, language); lines count from 0. Null contents give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *s) for path, text, lang in zip(*(c.to_pylist() for c in batch.columns)) for s in extract(text, lang)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))],
                                             ["path", "name", "symbol_type", "line", "parent"])

    return _narrow(files).mapInArrow(run, "path string, name string, symbol_type string, line int, parent string")


def file_imports(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *s) for path, text, lang in zip(*(c.to_pylist() for c in batch.columns)) for s in imports(text, lang)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()))],
                                             ["path", "module_path", "symbols", "is_wildcard"])

    return _narrow(files).mapInArrow(run, "path string, module_path string, symbols array<string>, is_wildcard boolean")


def locations(found: DataFrame) -> DataFrame:
    """(name, path, n_definitions): the paths that define a name, as rows, so that a name of any number of paths is spread."""
    return found.groupBy("name", "path").agg(F.count(F.lit(1)).alias("n_definitions"))


def find(found: DataFrame, name: str) -> DataFrame:
    """The distinct paths that define ``name``."""
    return found.filter(F.col("name") == name).select("path").distinct()


def of_file(found: DataFrame, path: str) -> DataFrame:
    return found.filter(F.col("path") == path)


def by_path(found: DataFrame) -> DataFrame:
    """(path, symbols in line order): a file's symbols are bounded by the file."""
    return found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "symbol_type", "parent"))).alias("symbols"))
