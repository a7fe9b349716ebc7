"""Source files that do not parse in their declared language.

Grammars of the languages are bundled as text (``syntax.grammars``) and compiled to charts. A file
is turned into a full token stream, bracketed groups are read from the inside out, and statements
between them are recognised with an Earley chart; equal token sequences are looked up. The first
token that nothing can follow is the first unrecoverable error. Where the runtime brings an exact
parser of the language (Python, JSON, XML), it confirms what the charts reject.

Defined results: null contents give no row; empty files are valid, except JSON and XML; a null or
unknown language goes by the path's extension, and where neither is known the file counts as valid
(``checked`` is false); of repeated rows of a file one is kept.
"""

from __future__ import annotations

import json as _json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.syntax import grammars, lexers, markup
from lodegraph.llm.syntax.brackets import SyntaxFault

#: Spellings of the languages.
NAMES = {"java": "java", "jsp": "jsp", "xml": "xml", "sql": "sql", "js": "javascript", "javascript": "javascript", "mjs": "javascript", "css": "css", "py": "python", "python": "python", "json": "json", "properties": "properties", "props": "properties", "yml": "yaml", "yaml": "yaml"}


def language_of(language: str | None, path: str | None) -> str | None:
    if language and language.strip():
        name = NAMES.get(language.strip().lower())
        if name:
            return name
    return NAMES.get((path or "").rpartition("/")[2].rpartition(".")[2].lower())


def _by_grammar(name: str, lexer, types=None, rule=None):
    def run(text: str) -> None:
        language = grammars.language(name)
        if types is not None:
            got = types(text)
            if got is not None and language.accepts(got):
                return
            language.check(lexer(text))
            return
        tokens = lexer(text)
        kinds = [t for t, _ in tokens]
        if not language.accepts(kinds):
            language.check(tokens)
        if rule is not None and (at := rule(kinds)) is not None:
            raise SyntaxFault(tokens[at][1], kinds[at])

    return run


_CHECKS = {
    "java": _by_grammar("java", lexers.java, lexers.java_types),
    "javascript": _by_grammar("javascript", lexers.javascript, rule=lexers.returns_outside),
    "css": _by_grammar("css", lexers.css),
    "json": _by_grammar("json", lexers.json),
    "sql": _by_grammar("sql", lambda text: lexers.sql(text, grammars.SQL_WORDS), lambda text: lexers.sql_types(text, grammars.SQL_WORDS)),
    "python": _by_grammar("python", lexers.python),
    "xml": markup.xml,
    "jsp": markup.jsp,
    "yaml": markup.yaml,
    "properties": markup.properties,
}


def _exact_python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "file", "exec", dont_inherit=True)
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            return False
    return True


def _exact_json(text: str) -> bool:
    try:
        _json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


_EXACT = {"python": _exact_python, "json": _exact_json, "xml": markup.xml_exactly}


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """(offset, what stands there) of the first unrecoverable error, or None."""
    try:
        _CHECKS[language](text)
    except SyntaxFault as f:
        exact = _EXACT.get(language)
        if exact is not None and exact(text):
            return None
        return f.offset, f.what
    return None


_ROW = "file_id long, project_id long, language string, checked boolean, valid boolean, error_line int, error_at string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for fid, pid, lang, path, text in zip(pdf["file_id"], pdf["project_id"], pdf["language"], pdf["path"], pdf["content"]):
            name = language_of(lang, path)
            fault = first_error(text, name) if name else None
            rows.append((fid, pid, name, name is not None, fault is None, None if fault is None else text.count("\n", 0, fault[0]) + 1, None if fault is None else str(fault[1])))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])
        out["error_line"] = out["error_line"].astype("Int64")
        out["project_id"] = out["project_id"].astype("Int64")
        yield out


def parse_files(contents: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file with content: whether it parses, and the line of its first error."""
    text = contents.where("file_id is not null and content is not null").groupBy("file_id").agg(F.max("content").alias("content"))
    info = files.groupBy("file_id").agg(F.max("path").alias("path"), F.max("language").alias("language"), F.max("project_id").alias("project_id"))
    rows = text.join(info, "file_id", "left").select(F.col("file_id").cast("long").alias("file_id"), F.col("project_id").cast("long").alias("project_id"), "language", "path", "content")
    return rows.mapInPandas(_parse, _ROW)


def error_rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per project and language."""
    return (
        parsed.where("checked")
        .groupBy("project_id", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
