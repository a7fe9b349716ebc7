"""Credentials embedded in source code and configuration: found, and redacted in place.

1. Every text is scanned for lines that speak of credentials at all; their literals, assigned
   values, URL parts and comment values become candidates, each with what stands to its left.
2. Weak labels come from patterns: known token formats, user parts of URLs and values of telling
   names are positive; placeholders, references and values of harmless names are negative.
3. Two character-bigram (Markov) models, of plain and of secret values, are counted over all
   weakly labelled candidates. A logistic regression over their likelihoods, the surrounding
   identifiers, the site and the path is fitted on a bounded sample of the labelled rows and
   calibrated (Platt) on held-out ones.
4. Candidates with a calibrated score from ``THRESHOLD`` up are secrets. Redaction replaces the
   value alone, so that quotes, separators and line structure stay.

Defined results: null and empty texts have no secrets; line numbers count LF from 1; a private
key stands on the line of its BEGIN mark; a literal continued on further lines is one secret, on
its first line; repeated records give one row. Authorization values have line 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

#: Rows of labelled candidates that the regression may be fitted on, and the decision.
TRAIN_ROWS = 40_000
THRESHOLD = 0.5
MASK = "REDACTED"
#: What makes a line worth a look (lower case).
HINTS = ["pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "bearer", "login", "private key", "://", "identified by", "connect ", "signer", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "_live_", "_pat_", "_sk_", "eyj", "dsn", "jdbc:", "getconnection(", "connect(", "phrase", "signing", "identified", "암호", "비밀", "인증", "접속", "키:"]
#: A line that ends so goes on: what it assigns to, or calls, names a literal that begins the next.
_GOES_ON = re.compile(r"[\w\"')\]]\s*(?:[=:]|:=|=>|\()\s*$")
_BEGINS = re.compile(r"\s*[frbu]?[\"'`]")

_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_BARE = re.compile(r"^\s*(?:[#!;]|//|--)?\s*(?:- )?([A-Za-z_][\w.\-]*)\s*[=:]\s*([^\s\"'`(){}<>,;][^\s\"'`(){}<>]*)\s*$")
_TAG = re.compile(r"<value>([^<>\s]+)</value>")
_LEAF = re.compile(r"<(?!value>)([\w.:\-]+)(?:\s[^<>]*)?>([^<>\s]+)</\1>")
_IDENTIFIED = re.compile(r"\bidentified\s+by\s+(?!values\b)([^\s\"'`;,()]+)", re.I)
_COMMENT = re.compile(r"(?://|--|#|/\*|<!--|<%--|^\s*\*)\s*(.*?)\s*(?:\*/|-->|--%>)?\s*$")
_IN_COMMENT = re.compile(r"^((?:[^\s:=/]+\s+){0,6}?[^\s:=/]+)\s*(?:[:=]\s*|\s/\s*)(\S+)$")
_CONNECT = re.compile(r"\bconnect\s+[\w$]+/([^\s@/]+)@", re.I)
# the third of three literals that open a connection: address, user, password
_OPENED = re.compile(r"(?:\b(?:getConnection|connect)\s*\(\s*|(?=[\"']jdbc:))([\"'])[^\"'\n]*\1\s*,\s*([\"'])[^\"'\n]*\2\s*,\s*([\"'])([^\"'\n]+)\3", re.I)
_USERINFO = re.compile(r"[A-Za-z][\w+.\-]*://[^\s:/@\"'`]+:([^\s\"'`@]+)@")
_PARAM = re.compile(r"(?:^|[?&;])\s*([A-Za-z_ ]*(?:pass(?:word|wd)?|pwd|secret|token|key|sig))\s*=\s*([^&;\s\"']+)", re.I)
_DEFAULT = re.compile(r"^\$\{([^:{}]+):(.*)\}$")
_SCHEME = re.compile(r"^(?:bearer|token|basic|apikey)\s+(?=\S)", re.I)
_SCHEMES = {"bearer", "token", "basic", "apikey", "digest", "negotiate"}
_AUTH_PARAM = re.compile(r'(?:key|token|secret|password|response)\s*=\s*"([^"]+)"', re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{30,}")
_BREAKS = re.compile(r"[\r\n]*")
_JOINED = re.compile(r"\s*(?:\+|\.\.|\|\|)")
_MORE = re.compile(r"\s*(?:\+|\.\.|\|\|)?\s*([\"'])((?:[^\"'\\\n]|\\.)+)\1")

_FORMATS = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|eyJ[\w\-]{8,}\.[\w\-]+\.[\w\-]+|\w{2,5}_(?:live|pat|sk)_\w{16,}|xox[abp]-[\w\-]{10,})$")
_PLACEHOLDER = re.compile(r"x{4,}|\*{3,}|\.{4,}|#{3,}|^-+$|\byour\b|\bYOUR_|change.?me\b|\breplace|\binsert\b|\bexample\b|\bdummy\b|\bsample\b|\btodo\b|\btbd\b|\bfixme\b|goes.?here|<[^>]*>|\{\{|base64\(|^(?:none|null|nil|true|false|undefined|empty|n/?a|test|string)$|^\W*$", re.I)
_REFERENCE = re.compile(r"\$\{|\$\(|#\{|\{\{|\{[\w.]*\}|%[A-Za-z_]\w*%|^%s|^\$\w|^:\w|^@\w|vault|getenv|process\.env|environ|^env[:.]|^file:|^secretsmanager", re.I)
_NAME = re.compile(r"[A-Za-z가-힣_$][\w가-힣$.\-]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[가-힣]+")

#: Words of a name that speak for, and against, a credential.
TELLING = {"password", "passwd", "pass", "pwd", "pw", "passphrase", "phrase", "secret", "token", "key", "apikey", "cred", "creds", "credential", "credentials", "auth", "authorization", "bearer", "login", "signing", "signer", "connect", "identified", "dsn", "접속", "암호", "비밀번호", "비밀", "인증"}
HARMLESS = {"sha", "md", "digest", "hash", "checksum", "integrity", "commit", "etag", "trace", "request", "resolved", "label", "message", "msg", "header", "field", "name", "policy", "public", "csrf", "hint", "placeholder", "icon", "size", "image", "expired", "type", "title", "format", "pattern", "column", "param", "id", "url", "path", "length", "count", "rules", "error", "version", "href", "src", "class", "license", "licence", "identifier", "namespace", "table", "index", "primary", "foreign", "sort"}
_EXTENSIONS = ["java", "jsp", "js", "py", "xml", "sql", "json", "properties", "yml", "css"]
_SITES = ["quoted", "bare", "tag", "comment", "user", "param", "default", "header", "pem"]

CANDIDATES = "record_table string, record_id long, line_no int, first int, last int, site string, name string, value string"


def _words(name: str) -> list[str]:
    out = []
    for part in _PARTS.findall(name):
        part = part.lower()
        out.append(part)
    return out


#: Identifiers that belong to a statement's form and name nothing.
_FORM = {"property", "name", "value", "values", "input", "type", "hidden", "constructor-arg", "private", "public", "protected", "static", "final", "string", "const", "let", "var", "val", "def", "import", "os", "os.environ.setdefault", "setdefault", "insert", "into", "to", "using", "user", "request.addheader", "request.setheader", "setheader", "addheader", "header", "headers", "http.defaults.headers", "put", "set", "add", "param", "entry", "key", "id", "new", "return", "this", "self", "export", "default", "bean", "arg"}


_NAMED_RIGHT = re.compile(r"\s*(?:name|key|id)\s*=\s*[\"']([^\"']+)")
# Read from right to left: what a value is assigned to, and calls that fetch what they are given.
_ASSIGNED = re.compile(r"\s*(?:>=|=:|=|:)\s*[\"']?([\w.\-]*[A-Za-z_])")
_FETCHES = ["get", "getenv", "getParameter", "getItem", "get_secret", "getsecret", "decode", "decrypt", "lookup", "resolve", "env", "fetch", "find", "input", "prompt", "querySelector", "getElementById", "param", "bundle"]
_FETCHED = re.compile(r"\s*[(\[]\s*(?:" + "|".join(n[::-1] for n in _FETCHES) + r"|\w*(?:daer|daol))", re.I)


class Line:
    """A line's names, found once from left to right, and what stands before and behind each of its values."""

    def __init__(self, text: str, before: str = ""):
        self.text, self.before = text, before  # ``before``: the line that this one goes on from
        self.back = text[::-1]
        self.names = [(m.end(), m.group()) for m in _NAME.finditer(text) if m.group().lower() not in _FORM]
        self.ends = [e for e, _ in self.names]

    def fetched(self, at: int) -> bool:
        return bool(_FETCHED.match(self.back, len(self.text) - at))

    def context(self, at: int, end: int | None = None) -> str:
        """What names the value at ``at``: the last identifiers to its left that aren't mere form, however far, or the name attribute to its right."""
        if end is not None:
            m = _NAMED_RIGHT.match(self.text, end)
            if m:
                return m.group(1)
        m = _ASSIGNED.match(self.back, len(self.text) - at)
        if m and m.group(1)[::-1].lower() not in _FORM:
            return m.group(1)[::-1]  # assigned to
        k = bisect_right(self.ends, at)
        names = [n for _, n in self.names[max(0, k - 3) : k]]
        if not names and self.before:
            above = Line(self.before.rstrip())
            return above.context(len(above.text))
        return " ".join(names)


def _split_value(value: str, name: str, at: int) -> list[tuple[int, int, str, str, str]]:
    """(start, end, site, name, value) of what a literal holds."""
    out = [(at + m.start(1), at + m.end(1), "user", name, m.group(1)) for m in _USERINFO.finditer(value)]
    out += [(at + m.start(2), at + m.end(2), "param", m.group(1), m.group(2)) for m in _PARAM.finditer(value) if ("://" in value or ";" in value or "=" in value[: m.start(2)]) and not value.startswith(m.group(2))]
    if out:
        return out
    m = _DEFAULT.match(value)
    if m:
        return [(at + m.start(2), at + m.end(2), "default", m.group(1), m.group(2))] if m.group(2) else []
    m = _SCHEME.match(value)
    if m:
        return [(at + m.end(), at + len(value), "header", f"{name} authorization", value[m.end() :])]
    return [(at, at + len(value), "quoted", name, value)] if value else []


def scan_line(line: str, before: str = "") -> list[tuple[int, int, str, str, str]]:
    """Candidates of one line: (start, end, site, name, value); ``before`` is the line that it goes on from."""
    at = Line(line, before)
    m = _PEM.search(line)
    if m:
        return [(m.start(), m.end(), "pem", at.context(m.start()), m.group())]
    out = []
    opened = {m.start(4) for m in _OPENED.finditer(line)}
    for m in _QUOTED.finditer(line):
        k = m.lastindex
        if k and not at.fetched(m.start()):
            out += _split_value(m.group(k), "password" if m.start(k) in opened else at.context(m.start(), m.end()), m.start(k))
    for m in _TAG.finditer(line):
        out.append((m.start(1), m.end(1), "tag", at.context(m.start()), m.group(1)))
    for m in _CONNECT.finditer(line):
        out.append((m.start(1), m.end(1), "comment", "connect", m.group(1)))
    more = [(m.start(2), m.end(2), "tag", m.group(1), m.group(2)) for m in _LEAF.finditer(line)]
    more += [(m.start(1), m.end(1), "comment", "identified by", m.group(1)) for m in _IDENTIFIED.finditer(line)]
    if not out:
        m = _BARE.match(line)
        if m:
            found = _split_value(m.group(2), m.group(1), m.start(2))
            return [(a, b, "bare" if s == "quoted" else s, n, v) for a, b, s, n, v in found]
        out += [(m.start(1), m.end(1), "user", "", m.group(1)) for m in _USERINFO.finditer(line)]
        c = _COMMENT.search(line)
        if c and not out:
            m = _IN_COMMENT.match(c.group(1))
            if m:
                out.append((c.start(1) + m.start(2), c.start(1) + m.end(2), "comment", m.group(1), m.group(2)))
    taken = {(a, b) for a, b, *_ in out}
    return out + [c for c in more if c[:2] not in taken]


def hint_lines(text: str) -> list[tuple[int, int, int]]:
    """Bounds of the lines that hold a hint, and of those that such a line goes on to, in order; and where the line before begins, if it goes on."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change length when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    marks = {}
    for h in HINTS:
        at = low.find(h)
        while at >= 0:
            start = low.rfind("\n", 0, at) + 1
            end = low.find("\n", at)
            marks[start] = len(text) if end < 0 else end
            if end < 0:
                break
            at = low.find(h, end)
    todo = sorted(marks.items())
    out: dict[int, tuple[int, int, int]] = {a: (a, b, -1) for a, b in todo}
    for a, b in todo:
        while b < len(text) and _GOES_ON.search(text, a, b):
            nxt = b + 1
            end = text.find("\n", nxt)
            end = len(text) if end < 0 else end
            if not _BEGINS.match(text, nxt, end):
                break
            seen = nxt in out
            out[nxt] = (nxt, end, a)
            if seen:
                break  # it goes on from there by itself
            a, b = nxt, end
    return [out[k] for k in sorted(out)]


def _key_body(text: str, at: int) -> str | None:
    """The first line of a private key's body behind its BEGIN mark at ``at``, before its END or the next BEGIN."""
    end = text.find("-----", at)
    m = _BODY.search(text, at, len(text) if end < 0 else end)
    return m.group() if m else None


def scan_text(text: str | None) -> list[tuple[int, int, int, str, str, str]]:
    """(line, start, end, site, name, value) of all candidates of a text; offsets within the text."""
    if not text:
        return []
    out, line_no, counted = [], 1, 0
    for a, b, before in hint_lines(text):
        line_no += text.count("\n", counted, a)
        counted = a
        for s, e, site, name, value in scan_line(text[a:b].rstrip("\r"), text[before : a - 1] if before >= 0 else ""):
            if site == "pem":
                value = _key_body(text, a + e)  # the value is what follows; it stands where its mark begins
                if value is None:
                    continue  # speaks of keys, holds none
            out.append((line_no, a + s, a + e, site, name, value))
    return out


class Features:
    """Numbers that the regression sees; ``plain`` and ``secret`` are bigram log probabilities."""

    def __init__(self, plain: np.ndarray, secret: np.ndarray):
        self.plain, self.secret = plain, secret

    def of(self, site: str, name: str, value: str, path: str | None) -> np.ndarray:
        words = _words(name)
        telling = sum(w in TELLING for w in words)
        harmless = sum(w in HARMLESS for w in words)
        n = max(1, len(value))
        digits, upper = sum(c.isdigit() for c in value), sum(c.isupper() for c in value)
        symbols = sum(not c.isalnum() and not c.isspace() for c in value)
        a, b = self.likelihood(value)
        hold, ref, known = bool(_PLACEHOLDER.search(value)), bool(_REFERENCE.search(value)), bool(_FORMATS.match(value))
        spaced = site != "pem" and any(c.isspace() for c in value.strip())
        own = _speaks(value)
        simple = not digits and (value.islower() or value.isupper() or bool(re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+|[\w.]+", value)) and a / n > -2.9)
        ext = (path or "").rpartition(".")[2].lower()
        short = n < 5
        simple = simple and not known
        bad = hold or ref or spaced or short or own
        core = [
            1.0, (b - a) / n, a / n, np.log(n), digits / n, upper / n, symbols / n,
            float(telling > 0), float(telling > 1), float(harmless > 0), float(hold), float(ref), float(known), float(spaced), float(own), float(simple), float(short),
            float(telling > 0 and not bad and not simple), float(telling > 0 and not harmless and not bad and not simple), float(harmless > 0 and telling == 0),
            float(bool(words) and words[-1] in TELLING), float(known and not bad), float(site in ("user", "param", "pem") and not bad),
        ]
        return np.array(core + [float(site == s) for s in _SITES] + [float(ext == e) for e in _EXTENSIONS] + [float("resources" in (path or "")), float("config" in (path or "")), float("test" in (path or ""))])

    def likelihood(self, value: str) -> tuple[float, float]:
        codes = _codes(value)
        return float(self.plain[codes[:-1], codes[1:]].sum()), float(self.secret[codes[:-1], codes[1:]].sum())


_ALPHABET = 98


def _codes(value: str) -> np.ndarray:
    """Printable ASCII by itself, everything else as one class, with an end mark on both sides."""
    return np.array([0, *[ord(c) - 31 if 32 <= ord(c) < 127 else 96 for c in value], 97])


def _speaks(value: str) -> bool:
    """The value is itself a name of credentials, such as ``userPw`` or ``X-Auth-Token``."""
    return not any(c.isdigit() for c in value) and any(w in TELLING for w in _words(value)) and bool(re.fullmatch(r"[A-Za-z]+(?:[-_. ][A-Za-z]+)*:?\s*", value)) and len(value) < 32


def harmless_form(value: str) -> bool:
    """Placeholders, references, names, sentences and values too short to be secrets."""
    return len(value) < 5 or bool(_PLACEHOLDER.search(value)) or bool(_REFERENCE.search(value)) or _speaks(value) or any(c.isspace() for c in value.strip())


def weak_label(site: str, name: str, value: str) -> int:
    """1, 0, or -1 where the patterns don't say."""
    words = _words(name)
    telling, harmless = any(w in TELLING for w in words), any(w in HARMLESS for w in words)
    if site == "pem":
        return 1
    if harmless_form(value):
        return 0
    if _FORMATS.match(value) or site == "user":
        return 1
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if telling and not harmless and mixed and len(value) >= 8:
        return 1
    if not telling or harmless or not any(c.isdigit() or c in "!_*~+" for c in value) and (value.islower() or value.isupper()):
        return 0
    return -1


class Detector:
    def __init__(self, features: Features, weights: np.ndarray, scale: np.ndarray, platt: tuple[float, float]):
        self.features, self.weights, self.scale, self.platt = features, weights, scale, platt

    def scores(self, rows: list[tuple[str, str, str, str | None]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        x = np.stack([self.features.of(*r) for r in rows]) / self.scale
        a, b = self.platt
        out = 1 / (1 + np.exp(-np.clip(a * (x @ self.weights) + b, -40, 40)))
        # The exact check: what can't be a secret by its form isn't one, whatever its score.
        out[[r[0] != "pem" and harmless_form(r[2]) for r in rows]] = 0.0
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scan_rows(record_table: str, whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["record_id"], pdf["text"]):
                if whole:
                    rows += [(record_table, rid, 0, a, b, s, n, v) for a, b, s, n, v in scan_header(text)]
                else:
                    rows += [(record_table, rid, line, a, b, s, n, v) for line, a, b, s, n, v in scan_text(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return run


def scan_header(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """The credential of an authorization header."""
    if not text or not text.strip():
        return []
    params = [(m.start(1), m.end(1), "header", "authorization key", m.group(1)) for m in _AUTH_PARAM.finditer(text)]
    if params:
        return params
    m = _SCHEME.match(text)
    a = m.end() if m else len(text) - len(text.lstrip())
    value = text[a:].strip()
    a = text.find(value, a) if value else a
    return [(a, a + len(value), "header", "authorization", value)] if value and value.lower() not in _SCHEMES else []


def candidates(texts: DataFrame, id_col: str, text_col: str, record_table: str, whole: bool = False) -> DataFrame:
    """Candidate values; with ``whole`` each text is one header value instead of a file."""
    rows = texts.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(_scan_rows(record_table, whole), CANDIDATES)


def train(cands: DataFrame) -> Detector:
    """Fit on candidates with a ``path`` column; see the module's docstring."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.zeros((2, _ALPHABET, _ALPHABET))
        for pdf in batches:
            for site, name, value in zip(pdf["site"], pdf["name"], pdf["value"]):
                label = weak_label(site, name, value)
                if label >= 0 and site != "pem":
                    codes = _codes(value)
                    np.add.at(tables[label], (codes[:-1], codes[1:]), 1)
        k, a, b = np.nonzero(tables)
        yield pd.DataFrame({"k": k, "a": a, "b": b, "n": tables[k, a, b]})

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["label"] = [weak_label(*r) for r in zip(pdf["site"], pdf["name"], pdf["value"])]
            yield pdf[pdf["label"] >= 0]

    tables = np.full((2, _ALPHABET, _ALPHABET), 0.1)
    sums = cands.select("site", "name", "value").mapInPandas(count, "k int, a int, b int, n double").groupBy("k", "a", "b").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * 98^2 rows
    tables[sums["k"], sums["a"], sums["b"]] += sums["n"]
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    features = Features(logs[0], logs[1])
    # A bounded sample of different values, by hash and as many of either label; the hash thins
    # the rows out before any are sent, so what reaches the driver doesn't depend on the input.
    labelled = cut(cands.select("site", "name", "value", "path").mapInPandas(label, "site string, name string, value string, path string, label int").groupBy("site", "name", "value", "label").agg(F.max("path").alias("path")))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    each = TRAIN_ROWS // 2
    mixed = F.xxhash64("site", "name", "value")
    parts = [labelled.where((F.col("label") == k) & (F.pmod(mixed, F.lit(-(-n // each))) == 0)).withColumn("h", mixed).toPandas().sort_values(["h", "site", "name", "value"]).head(each) for k, n in sizes.items()]
    parts.append(pd.DataFrame({"site": [], "name": [], "value": [], "label": [], "path": [], "h": []}))
    rows = pd.concat(parts)  # the sample and its parts depend on the values alone, not on partitions
    if rows["label"].nunique() < 2:
        dim = len(features.of("quoted", "", "", None))
        return Detector(features, np.zeros(dim), np.ones(dim), (1.0, -20.0))
    x = np.stack([features.of(*r) for r in zip(rows["site"], rows["name"], rows["value"], rows["path"])])
    y = rows["label"].to_numpy(dtype=float)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    held = (rows["h"].to_numpy(dtype=np.int64) >> 7) % 5 == 0
    weights = fit_logistic(x[~held], y[~held])
    z = (x[held] @ weights)[:, None]
    yh = y[held]
    if 0 < yh.sum() < len(yh):
        ab = fit_logistic(np.hstack([z, np.ones_like(z)]), yh, l2=1e-4)
        platt = (float(max(ab[0], 0.1)), float(ab[1]))
    else:
        platt = (1.0, 0.0)
    return Detector(features, weights, scale, platt)


def scored(cands: DataFrame, detector: Detector) -> DataFrame:
    shared = cands.sparkSession.sparkContext.broadcast(detector)  # two bigram tables and some sixty weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"] = shared.value.scores(list(zip(pdf["site"], pdf["name"], pdf["value"], pdf["path"])))
            yield pdf

    return cands.mapInPandas(run, CANDIDATES + ", path string, score double")


def find(contents: DataFrame, files: DataFrame, headers: DataFrame) -> DataFrame:
    """Scored candidates from file texts (file_id, content), paths (file_id, path) and headers (config_id, authorization)."""
    text = candidates(contents, "file_id", "content", "file_contents")
    head = candidates(headers, "config_id", "authorization", "cursor_api_config", whole=True)
    paths = files.select(F.col("file_id").alias("record_id"), "path").groupBy("record_id").agg(F.max("path").alias("path"))
    cands = cut(text.join(paths, "record_id", "left").unionByName(head.withColumn("path", F.lit(None).cast("string"))).select(*[c.split()[0] for c in CANDIDATES.split(", ")], "path"))
    return scored(cands, train(cands))


def secrets(contents: DataFrame, files: DataFrame, headers: DataFrame) -> DataFrame:
    return find(contents, files, headers).where(F.col("score") >= THRESHOLD)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace the values at ``spans``; key blocks keep their lines, continued literals go with their first part."""
    out, last = [], 0
    for a, b, site in sorted(set(spans)):
        if a < last:
            continue
        if site == "pem":
            end = _PEM_END.search(text, b)
            stop = end.start() if end else len(text)
            out += [text[last:b], re.sub(r"[A-Za-z0-9+/=]{16,}", MASK, text[b:stop])]
            last = stop
            continue
        out += [text[last:a], MASK]
        last = b
        if site == "quoted" and b < len(text) and text[b] in "\"'":
            at = b + 1
            while at < len(text) and text[at] in " \t\r":
                at += 1
            while at < len(text) and (text[at] == "\n" or text[at] == "+"):
                skip = at + 1 if text[at] == "+" else _BREAKS.match(text, at).end()
                m = _MORE.match(text, skip)
                if not m or (text[at] == "\n" and not _JOINED.match(text, skip)):
                    break
                out += [text[last : m.start(2)], MASK]
                last = m.end(2)
                at = last + 1
                while at < len(text) and text[at] in " \t\r":
                    at += 1
    return "".join([*out, text[last:]])


def redacted(texts: DataFrame, id_col: str, text_col: str, hits: DataFrame, record_table: str) -> DataFrame:
    """(record_table, record_id, text, n_secrets) of the texts that hold secrets, without these."""
    spans = hits.where(F.col("record_table") == record_table).groupBy("record_id").agg(F.collect_set(F.struct("first", "last", "site")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [redact_text(t, [(s["first"], s["last"], s["site"]) for s in sp]) for t, sp in zip(pdf["text"], pdf["spans"])]
            yield pd.DataFrame({"record_table": record_table, "record_id": pdf["record_id"], "text": done, "n_secrets": [len(s) for s in pdf["spans"]]})

    rows = texts.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(spans, "record_id")
    return rows.mapInPandas(run, "record_table string, record_id long, text string, n_secrets int").distinct()
