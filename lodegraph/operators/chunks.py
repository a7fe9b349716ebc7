"""Texts cut by size and by structure, and mapper statements with their fragments put in.

Sizes are cut by built-in expressions. Structure needs the depth of braces, so it runs in Arrow batches.

Defined results: null texts give no chunks, an empty text one empty chunk by size and none by structure;
a class or method that never closes ends with its file; an include without fragment stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_chunks(df: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """(key, chunk, hash, chars): pieces of so many characters; nothing is shuffled."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / chars)).cast("int")
    x = df.where(F.col(text).isNotNull()).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    piece = F.substring(F.col(text), F.col("chunk") * chars + 1, F.lit(chars))
    return x.select(key, "chunk", F.md5(piece).alias("hash"), F.length(piece).alias("chars"))


_HEAD = re.compile(r"(?:package |import |\s*$)")
_TYPE = re.compile(r"\b(class|interface|enum)\s+([A-Za-z_]\w*)")
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:[\w<>\[\],.?]+\s+)*([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w,.\s]+)?\{\s*$")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "synchronized", "try", "else", "return", "new"}
_SCRIPTLET = re.compile(r"<%(?![@=!-])(.*?)%>", re.S)
_SQL_WORD = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE)\b", re.I)
_STATEMENT = re.compile(r"<(select|insert|update|delete)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)
_ID = re.compile(r"\bid\s*=\s*[\"']([^\"']+)[\"']")
_NOISE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/", re.S)
#: A page without statements of its own is a chunk from so many characters on.
PAGE_CHARS = 1000


def _blanked(text: str) -> str:
    """The text with literals and comments as blanks, line ends kept: braces in them don't count."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def java_chunks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line): the head, types and methods, by the depth of braces."""
    lines = text.split("\n")
    out = []
    head = next((i for i, line in enumerate(lines) if not _HEAD.match(line)), len(lines))
    if any(line.startswith(("package ", "import ")) for line in lines[:head]):
        out.append(("import", "imports", 1, head))
    depth, opened = 0, []  # (kind, name, first line, depth outside of it)
    for i, line in enumerate(_blanked(text).split("\n"), 1):
        found = None
        t = _TYPE.search(line)
        if t:
            found = ("class", t.group(2))
        else:
            m = _METHOD.match(line)
            if m and m.group(1) not in _NO_METHOD and any(k == "class" for k, *_ in opened):
                found = ("method", m.group(1))
        if found:
            opened.append((*found, i, depth))
        depth += line.count("{") - line.count("}")
        while opened and "}" in line and depth <= opened[-1][3]:
            kind, name, first, _ = opened.pop()
            out.append((kind, name, first, i))
    while opened:
        kind, name, first, _ = opened.pop()
        out.append((kind, name, first, len(lines)))
    return out


def page_chunks(text: str) -> list[tuple[str, str, int, int]]:
    """Scriptlets that hold SQL; a long page without any is one chunk."""
    out = []
    for i, m in enumerate(_SCRIPTLET.finditer(text)):
        if _SQL_WORD.search(m.group(1)):
            first = text.count("\n", 0, m.start()) + 1
            out.append(("scriptlet", f"scriptlet_{i}", first, first + m.group().count("\n")))
    return out or ([("page", "page", 1, text.count("\n") + 1)] if len(text) > PAGE_CHARS else [])


def mapper_chunks(text: str) -> list[tuple[str, str, int, int]]:
    out = []
    for m in _STATEMENT.finditer(text):
        name = _ID.search(m.group(2))
        if name:
            first = text.count("\n", 0, m.start()) + 1
            out.append((f"mapper_{m.group(1).lower()}", name.group(1), first, first + m.group().count("\n")))
    return out


_BY_SUFFIX = {"java": java_chunks, "jsp": page_chunks, "xml": mapper_chunks}


def structural(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, kind, name, first_line, last_line, hash, words) of the chunks of Java, JSP and mapper files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for k, p, t in zip(pdf["k"], pdf["p"], pdf["t"]):
                cut = _BY_SUFFIX.get((p or "").rpartition(".")[2].lower())
                lines = t.split("\n")
                for kind, name, a, b in cut(t) if cut else ():
                    body = "\n".join(lines[a - 1 : b])
                    rows.append((k, kind, name, a, b, hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest(), len(body.split())))
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "first_line", "last_line", "hash", "words"])

    x = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t"))
    return x.mapInPandas(run, f"{key} long, kind string, name string, first_line int, last_line int, hash string, words int")


_FRAGMENT = re.compile(r"<sql\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</sql\s*>", re.S)
_INCLUDE = re.compile(r"<include\b[^>]*\brefid\s*=\s*[\"']([^\"']+)[\"'][^>]*?(?:/>|>.*?</include\s*>)", re.S)


def inline(body: str, fragments: dict[str, str], inside: tuple[str, ...] = ()) -> str:
    """``body`` with its includes replaced, fragments in fragments too; one that includes itself stays."""

    def put(m: re.Match) -> str:
        name = m.group(1).rpartition(".")[2] if m.group(1) not in fragments else m.group(1)
        if name not in fragments or name in inside:
            return m.group()
        return inline(fragments[name], fragments, (*inside, name))

    return _INCLUDE.sub(put, body)


def inlined_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, stmt_id, includes, sql): mapper statements with the fragments of their file, tags dropped, blanks collapsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                fragments = dict(_FRAGMENT.findall(t))
                for m in _STATEMENT.finditer(t):
                    name = _ID.search(m.group(2))
                    if name:
                        whole = inline(m.group(3), fragments)
                        rows.append((k, m.group(1).lower(), name.group(1), len(_INCLUDE.findall(m.group(3))), " ".join(re.sub(r"<!\[CDATA\[|\]\]>|<[^<>]*>", " ", whole).split())))
            yield pd.DataFrame(rows, columns=[key, "kind", "stmt_id", "includes", "sql"])

    x = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return x.mapInPandas(run, f"{key} long, kind string, stmt_id string, includes int, sql string")
