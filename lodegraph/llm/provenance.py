"""Generated, minified and third-party source files, and data saved as code.

Token sequences are compressed by pair replacement (Re-Pair), many files at a time: in every round
the pairs that are more frequent in their file than their neighbours are replaced together, so a
file is done in a few rounds of array operations. Symbols are hashes of what they expand to, hence
a rule has the same name in every file and on every machine. Two grammars are inferred per file.

* Over token classes (identifiers, numbers and strings abstracted): rules say how a file is built.
  A rule's voice is the share of files with it that call themselves generated; a file that mostly
  expands from rules of generated files is generated, whether or not it says so itself, and so is
  one that says so and is mostly made of reused rules. Comments alone decide nothing. The whole text
  is searched for such comments; those before the first code token, however long, head the file.
* Over literal tokens, where pairs are chosen by hash instead of by count, so that equal stretches
  give equal rules in any context: each rule names the first file that has it (copies of catalogued
  files first). A file that mostly expands from rules of one such file is a copy of it; copies in
  several repositories, or of a catalogued file, are third-party code.
* Literals that make up most of a file and compress no further than their alphabet allows, or one
  rule of literals repeated to the end, are data; script and style files without blanks are minified.

Defined results: null and empty contents are no cases; configuration formats (JSON, YAML,
properties) are never data or generated code; repeated rows count once; a file without path is
read as plain text of no known language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

#: Tokens a class rule must expand to, and a literal one; tokens from which files are handled apart. A file is never divided.
CLASS_RULE, LITERAL_RULE = 8, 24
BATCH_TOKENS = 400_000
#: Decisions: voice of a generated rule, files with it, coverage by such, and for files whose head
#: says so, or that are too short for rules; coverage of a copy, as a share and in tokens, of a
#: catalogued file, and repositories.
VOICE, VOICE_FILES, GENERATED_COVER, MARKED_COVER, MARKED_TOKENS = 0.5, 3, 0.2, 0.1, 60
COPY_COVER, COPY_TOKENS, KNOWN_TOKENS, COPY_PROJECTS = 0.4, 80, 40, 3
#: Data: share of literals among tokens, and their number, or their characters and share of characters.
DATA_LITERALS, DATA_COUNT, DATA_CHARS, DATA_SHARE = 0.27, 60, 1000, 0.5
#: A literal no shorter than DATA_CHARS of this share of a file that compresses to this ratio at best.
OPAQUE_SHARE, OPAQUE_RATIO = 0.7, 0.6
#: Minified: blanks per token at most, characters per line at least, tokens at least.
DENSE_BLANKS, DENSE_LINE, DENSE_TOKENS = 0.15, 120, 30

CODE = {"java", "js", "py", "sql", "xml", "jsp", "css", "ts", "kt", "c", "h", "cpp", "go", "rb", "php", "html"}
DENSE = {"js", "css"}
_KEYWORDS = set(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static super switch synchronized this throw throws transient try volatile while var let function of in typeof async await yield export from def pass lambda with as not and or is none true false elif except raise del global nonlocal null undefined select insert update delete into values where set join left inner on group by order create table alter add primary key constraint comment column grant commit begin end declare require module exports".split()
)
#: How files call themselves generated: at the start of a comment line or in an annotation, not in passing.
MARKER = re.compile(
    r"(?im)^[ \t]*(?:/\*+!?|\*|//+|--+|#+|<!--|<%--)?[ \t]*(?:@?(?:auto-?)?generated\b|<auto-generated|(?:code|file|source) generated by|this (?:file|code|source) (?:was|is|has been) (?:auto|generated|machine|produced)|do not (?:edit|modify)\b|machine[- ](?:made|generated)\b|@[\w.]*Generated\()|자동 생성"
)
ANNOTATION = re.compile(r"(?m)^[ \t]*@[\w.]*Generated\(")

_STRINGS = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'


def _pattern(comments: str) -> re.Pattern:
    return re.compile(comments + "|" + _STRINGS + r"|[^\W\d][\w$]*|\d[\w.]*|[^\s\w]", re.S)


_BLOCK = r"/\*.*?\*/|<!--.*?-->|<%--.*?--%>"
_TOKENS = {
    "sql": _pattern(_BLOCK + r"|--[^\n]*"),
    "py": _pattern(r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''"),
    "yml": _pattern(r"#[^\n]*"),
    "properties": _pattern(r"(?m:^)[#!][^\n]*"),
    "css": _pattern(_BLOCK),
}
_DEFAULT = _pattern(_BLOCK + r"|//[^\n]*")
_COMMENT, _STRING, _NUMBER, _NAME = 0, 1, 2, 3


def _class_of(token: str) -> int:
    c = token[0]
    if token[:2] in ("/*", "//", "--") or token[:4] in ("<!--", "<%--") or c == "#" and len(token) > 1 or token[:3] in ('"""', "'''") or c == "!" and len(token) > 1:
        return _COMMENT
    if c in "\"'`":
        return _STRING
    if c.isdigit():
        return _NUMBER
    if c.isalpha() or c == "_":
        low = token.lower()
        return 4 + xxhash.xxh64_intdigest(low) % (1 << 60) if low in _KEYWORDS else _NAME
    return 4 + xxhash.xxh64_intdigest(token, seed=1) % (1 << 60)


class Lexicon:
    """Numbers of token texts and, by number: class, hash, length, line breaks, blanks."""

    def __init__(self, bound: int = 400_000):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.kind = np.zeros(1 << 12, dtype=np.uint64)
        self.hash = np.zeros(1 << 12, dtype=np.uint64)
        self.length, self.breaks, self.blanks = (np.zeros(1 << 12, dtype=np.int64) for _ in range(3))

    def add(self, token: str) -> int:
        i = self.size
        if i == len(self.kind):
            for name in ("kind", "hash", "length", "breaks", "blanks"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.kind[i], self.hash[i] = _class_of(token), xxhash.xxh64_intdigest(token) >> 1
        self.length[i], self.breaks[i], self.blanks[i] = len(token), token.count("\n"), token.count(" ") + token.count("\t") + token.count("\n")
        self.size += 1
        if len(token) < 80:  # long ones seldom come again
            self.known[token] = i
        return i

    def numbers(self, tokens: list[str]) -> np.ndarray:
        get, add = self.known.get, self.add
        return np.array([add(t) if (i := get(t)) is None else i for t in tokens], dtype=np.int64)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX) ^ ((b + _MIX2) * np.uint64(0xD6E8FEB86659FD93))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def re_pair(symbols: np.ndarray, owner: np.ndarray, rule_tokens: int, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compress the concatenated sequences of several files.

    ``by_count`` replaces pairs that occur at least twice in their file, the locally most frequent
    first; otherwise local maxima of the pairs' hashes are replaced. Returns the owner, name and
    weight of each occurrence of a rule that is the first on its stretch to reach ``rule_tokens``
    tokens, and the final symbols' owners and weights.
    """
    s, f = symbols.astype(np.uint64), owner.astype(np.int64)
    w = np.ones(len(s), dtype=np.int64)
    blocks = ([], [], [])
    while len(s) > 1:  # every round shortens the sequence, or is the last
        same = f[1:] == f[:-1]
        name = _mix(s[:-1], s[1:])
        if by_count:
            key = np.where(same, name ^ (f[:-1].astype(np.uint64) * _MIX2), np.arange(len(name), dtype=np.uint64))
            _, where, count = np.unique(key, return_inverse=True, return_counts=True)
            times = np.where(same, count[where], 0)
            rank = np.where(times > 1, (np.minimum(times, 1 << 20).astype(np.uint64) << np.uint64(40)) | (name >> np.uint64(25)) + np.uint64(1), np.uint64(0))
        else:
            # stretches long enough take no further part: their neighbours must not depend on them
            small = (w[:-1] < rule_tokens) & (w[1:] < rule_tokens)
            rank = np.where(same & small, name | np.uint64(1), np.uint64(0))
        left = np.concatenate([np.zeros(1, dtype=np.uint64), rank[:-1]])
        right = np.concatenate([rank[1:], np.zeros(1, dtype=np.uint64)])
        at = np.flatnonzero((rank > 0) & (rank >= right) & (rank > left))
        if not len(at):
            break
        if by_count:
            _, where2, again = np.unique(where[at], return_inverse=True, return_counts=True)
            at = at[again[where2] > 1]
            if not len(at):
                break
        before = np.maximum(w[at], w[at + 1])
        w[at] += w[at + 1]
        s[at] = name[at]
        new = (w[at] >= rule_tokens) & (before < rule_tokens)
        if new.any():
            for out, values in zip(blocks, (f[at][new], s[at][new], w[at][new])):
                out.append(values.copy())
        keep = np.ones(len(s), dtype=bool)
        keep[at + 1] = False
        s, f, w = s[keep], f[keep], w[keep]
    empty = np.zeros(0, dtype=np.int64)
    got = [np.concatenate(b) if b else empty for b in blocks]
    return got[0].astype(np.int64), got[1].astype(np.uint64), got[2].astype(np.int64), f, w


def _summed(owner: np.ndarray, name: np.ndarray, weight: np.ndarray, files: int) -> list[list[tuple[int, int, int]]]:
    """Per file: (rule, tokens covered, times used)."""
    out: list = [[] for _ in range(files)]
    if not len(owner):
        return out
    order = np.lexsort((name, owner))
    o, n, w = owner[order], name[order], weight[order]
    start = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (n[1:] != n[:-1])]))
    total, times = np.add.reduceat(w, start), np.diff(np.concatenate([start, [len(o)]]))
    for a, b, c, t in zip(o[start].tolist(), n[start].astype(np.int64).tolist(), total.tolist(), times.tolist()):
        out[a].append((b, c, t))
    return out


def extension(path: str | None) -> str:
    return (path or "").rpartition("/")[2].rpartition(".")[2].lower() if "." in (path or "").rpartition("/")[2] else ""


def _marked(text: str, pattern: re.Pattern) -> bool:
    """A comment that begins its line, anywhere in the text, or an annotation calls the file generated."""
    if ANNOTATION.search(text):
        return True
    return bool(MARKER.search(text)) and any(
        MARKER.search(t) and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() for m in pattern.finditer(text) for t in (m.group(),) if _class_of(t) == _COMMENT
    )


def describe(text: str, ext: str, lexicon: Lexicon) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Plain measures of a file, and its token classes and token hashes without comments."""
    pattern = _TOKENS.get({"yaml": "yml"}.get(ext, ext), _DEFAULT)
    tokens = pattern.findall(text)
    ids = lexicon.numbers(tokens)
    kind, length = lexicon.kind[ids], lexicon.length[ids]
    comment = kind == _COMMENT
    marked = headed = False
    low = text.lower()
    if any(h in low for h in ("generated", "do not ", "machine", "produced", "자동")):
        first = int(np.argmin(comment)) if len(comment) and not comment.all() else len(tokens)
        if tokens[first : first + 3] == ["<", "?", "xml"]:  # the comment after a prolog still heads the file
            head = text[text.find("?>") + 2 :].lstrip()
            headed = head.startswith("<!--") and bool(MARKER.search(head[: head.find("-->")]))
        else:
            headed = any(MARKER.search(t) for t in tokens[:first])
        marked = headed or _marked(text, pattern)
    code = ~comment
    string = kind == _STRING
    literal = string | (kind == _NUMBER)
    code_chars = int(length[code].sum())
    chars = int(length[literal].sum() - 2 * string.sum())
    opaque = False  # one literal makes up the file and doesn't compress like text
    longest = int(length[literal].max()) if literal.any() else 0
    if longest >= DATA_CHARS and longest >= OPAQUE_SHARE * code_chars:
        token = tokens[int(np.argmax(np.where(literal, length, 0)))]
        opaque = len(zlib.compress(token.encode("utf-8", "replace"), 6)) >= OPAQUE_RATIO * len(token)
    lines = max(1, text.count("\n") + 1 - text.count("\n\n") - int((lexicon.breaks[ids[comment]] + 1).sum()))
    blanks = text.count(" ") + text.count("\n") + text.count("\t") - int(lexicon.blanks[ids[comment | literal]].sum())
    measures = (int(code.sum()), int(literal.sum()), chars, code_chars, lines, max(0, blanks), marked, headed, opaque)
    return measures, kind[code], lexicon.hash[ids[code]]


_MEASURES = "n int, literals int, literal_chars long, code_chars long, lines int, blanks int, marked boolean, headed boolean, opaque boolean"
_FILES = f"file_id long, project_id long, known boolean, ext string, {_MEASURES}, reused long, rules array<struct<rule:bigint,cover:bigint,times:bigint>>, copies array<struct<rule:bigint,cover:bigint,times:bigint>>"


def _segments(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Concatenated sequences and their owners, about BATCH_TOKENS at a time; a file stays whole, however long."""
    seqs, owners, size = [], [], 0
    for i, p in enumerate(parts):
        if size and size + len(p) > BATCH_TOKENS:
            yield np.concatenate(seqs), np.concatenate(owners)
            seqs, owners, size = [], [], 0
        if len(p):
            seqs.append(p)
            owners.append(np.full(len(p), i, dtype=np.int64))
            size += len(p)
    if size:
        yield np.concatenate(seqs), np.concatenate(owners)


def _grammars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon()
    for pdf in batches:
        for low in range(0, len(pdf), 1000):
            part = pdf.iloc[low : low + 1000]
            exts = [extension(p) for p in part["path"]]
            if lexicon.size > lexicon.bound:
                lexicon.clear()
            got = [describe(t, e, lexicon) for t, e in zip(part["content"], exts)]
            n = len(part)
            reused = np.zeros(n, dtype=np.int64)
            rules: list = [[] for _ in range(n)]
            copies: list = [[] for _ in range(n)]
            for seq, own in _segments([g[1] for g in got]):
                o, names, w, _, _ = re_pair(seq, own, CLASS_RULE, True)
                reused += np.bincount(o, weights=w, minlength=n).astype(np.int64)
                for i, r in enumerate(_summed(o, names, w, n)):
                    rules[i] += r
            for seq, own in _segments([g[2] for g in got]):
                o, names, w, _, _ = re_pair(seq, own, LITERAL_RULE, False)
                for i, r in enumerate(_summed(o, names, w, n)):
                    copies[i] += r
            out = pd.DataFrame([g[0] for g in got], columns=[m.split()[0] for m in _MEASURES.split(", ")])
            out.insert(0, "file_id", part["file_id"].to_numpy())
            out.insert(1, "project_id", part["project_id"].to_numpy())
            out.insert(2, "known", part["known"].to_numpy())
            out.insert(3, "ext", exts)
            out["reused"] = reused
            names3 = ("rule", "cover", "times")
            out["rules"] = [[dict(zip(names3, r)) for r in x] for x in rules]
            out["copies"] = [[dict(zip(names3, r)) for r in x] for x in copies]
            yield out


def grammars(contents: DataFrame, files: DataFrame, library: DataFrame) -> DataFrame:
    """One row per file: measures and the rules of both grammars."""
    text = contents.where("file_id is not null and content is not null").groupBy("file_id").agg(F.max("content").alias("content"))
    where = files.groupBy("file_id").agg(F.max("path").alias("path"), F.max("project_id").alias("project_id"))
    known = library.select(F.lower("sha256").alias("sha")).where("sha is not null").distinct().withColumn("known", F.lit(True))
    rows = text.join(where, "file_id", "left").withColumn("sha", F.sha2("content", 256)).join(known, "sha", "left")
    rows = rows.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce(F.col("project_id").cast("long"), F.lit(-1)).alias("project_id"), F.coalesce("known", F.lit(False)).alias("known"), "path", "content")
    return rows.mapInPandas(_grammars, _FILES)


def classify(table: DataFrame) -> DataFrame:
    """(file_id, generated, third_party, minified, data, voice: coverage by generated rules) from the rows of :func:`grammars`."""
    code = F.col("ext").isin(*CODE)
    # generated: what the rules of a file say about their origin
    rules = table.where(code).select("file_id", "marked", F.explode("rules").alias("r")).select("file_id", "marked", "r.rule", "r.cover")
    voices = rules.groupBy("rule").agg(F.sum(F.col("marked").cast("long")).alias("marked"), F.count(F.lit(1)).alias("files"))
    speaking = voices.where((F.col("files") >= VOICE_FILES) & (F.col("marked") >= VOICE * F.col("files"))).select("rule")
    spoken = rules.join(speaking, "rule").groupBy("file_id").agg(F.sum("cover").alias("spoken"))
    # third-party: the first file of each stretch, catalogued files first
    stretch = table.where(code).select("file_id", "project_id", "known", "n", F.explode("copies").alias("c")).select("file_id", "project_id", "known", "n", "c.rule", "c.cover")
    first = stretch.groupBy("rule").agg(F.min(F.struct((~F.col("known")).alias("late"), "file_id")).alias("first"), F.count(F.lit(1)).alias("files")).where("files > 1")
    origin = (
        stretch.join(first.select("rule", F.col("first.file_id").alias("origin"), (~F.col("first.late")).alias("from_known")), "rule")
        .groupBy("file_id", "project_id", "n", "origin", "from_known")
        .agg(F.sum("cover").alias("cover"))
        .where((F.col("cover") >= COPY_COVER * F.col("n")) & (F.col("cover") >= F.when(F.col("from_known"), KNOWN_TOKENS).otherwise(COPY_TOKENS)))
    )
    family = origin.groupBy("origin").agg(F.countDistinct("project_id").alias("projects"))
    copied = origin.join(family, "origin").where((F.col("projects") >= COPY_PROJECTS) | F.col("from_known")).select("file_id").distinct().withColumn("copied", F.lit(True))
    out = table.join(spoken, "file_id", "left").join(copied, "file_id", "left")
    n = F.greatest(F.col("n"), F.lit(1))
    data = F.col("opaque") & code | code & (F.col("literals") >= DATA_LITERALS * n) & ((F.col("literals") >= DATA_COUNT) | ((F.col("literal_chars") >= DATA_CHARS) & (F.col("literal_chars") >= DATA_SHARE * F.col("code_chars"))))
    minified = F.col("ext").isin(*DENSE) & (F.col("n") >= DENSE_TOKENS) & (F.col("blanks") <= DENSE_BLANKS * n) & (F.col("code_chars") >= DENSE_LINE * F.col("lines"))
    generated = code & ((F.coalesce("spoken", F.lit(0)) >= GENERATED_COVER * n) | (F.col("headed") & ((F.greatest(F.coalesce("spoken", F.lit(0)), F.col("reused")) >= MARKED_COVER * n) | (n <= MARKED_TOKENS))))
    return out.select("file_id", generated.alias("generated"), (F.coalesce("copied", F.lit(False)) | F.col("known")).alias("third_party"), minified.alias("minified"), data.alias("data"), (F.coalesce("spoken", F.lit(0)) / n).alias("voice"))


def provenance(contents: DataFrame, files: DataFrame, library: DataFrame) -> DataFrame:
    return classify(cut(grammars(contents, files, library)))


def found(contents: DataFrame, files: DataFrame, library: DataFrame) -> DataFrame:
    return provenance(contents, files, library).where("generated or third_party or minified or data").select("file_id")
