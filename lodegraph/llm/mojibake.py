"""Text garbled by a wrong character encoding: found, and restored where possible.

A wrong code page is a substitution cipher: bytes written in one page were read in another, so
each letter became one garbled symbol or a short group. The cipher of a source is unknown.
Expectation-maximization over all words with non-ASCII characters learns, together, a
character-bigram model of the corpus's languages and, per source, the ciphers at work:

* E: each word is clean or enciphered by one of the pairs of pages in the book that can decode it; the
  posterior weighs the bigram likelihood of the reading against the source's share of that cipher.
* M: bigram counts are re-estimated from the readings, cipher shares per source from posteriors.
  Rounds end when the share of garbled words settles.
* Words that stay odd (bigrams that next to no other source has) may come from a page outside the
  book. Their symbol bigrams are counted per source, and the mapping from symbols to letters is
  learned by EM against the letter bigrams of each script of the corpus (:mod:`decipher`).

The tables of a source (garbled symbol -> letter) are applied with ``str.translate`` for single-byte
pages, and over byte groups for multi-byte ones. Words with U+FFFD lost bytes for good: they are
found, and restored only outside the losses.

Counts cover every document. Bigrams live in hash tables of fixed size, the only thing that is
collected and broadcast beside the overall share of each cipher; words, shares and tables of
sources stay distributed and are joined by source.

Defined results: null, empty and pure ASCII texts are no cases; a null source is a source of its
own; repeated rows give one row per row in ``repair`` and one per id in ``found``.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.decipher import END, Language, learn_table
from lodegraph.session import cut, width

#: Code pages considered; those with "+" read their undefined bytes as C1 controls, as browsers do.
READ_AS = ["cp1252+", "latin_1", "cp1250+", "cp1251+", "cp1253+", "cp1254+", "iso8859_2", "iso8859_15", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp866", "koi8_r"]
READ_WIDE = ["cp949", "cp932", "gbk", "big5"]
WRITTEN = ["utf_8", "cp1252+", "cp1250+", "cp1251+", "koi8_r", "cp866", "iso8859_5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp949", "euc_jp", "cp932", "gbk", "big5"]
WRITTEN_WIDE = {"utf_8", "cp949", "euc_jp", "cp932", "gbk", "big5"}
TWICE = "utf_8*2"

#: Size of the bigram table (cells), smoothing, least share of a cipher by the page written, start weight of ambiguous
#: words, rounds at most, change of the garbled share at which they end, and the decision.
CELLS = 1 << 20
ALPHA, SPREAD = 0.02, 4000
START_SHARE = {"utf_8": 1e-3, "": 1e-4}
AMBIGUOUS = 0.05
ROUNDS, SETTLED = 60, 0.0005
#: After so many rounds, words whose readings are all less likely by SURE (in logs) count as clean in the rounds to
#: come: partial E steps, which reach the same maximum. The decision looks at every word again.
SURE_AFTER, SURE = 2, 18.0
#: Rows of words for a task of a later round; different words that may be garbled, up to which their scores are broadcast.
TASK_ROWS, HOT_WORDS = 50_000, 200_000
#: UTF-8 checks itself: a reading that is valid needs less of the bigrams.
MIN_POSTERIOR = {"utf_8": 0.4, "": 0.9}
MIN_GAIN = 3.0
#: A cipher that single words speak for only weakly is still taken, if so many different words of a
#: text do, with so much likelihood gained together.
WEAK_WORDS, WEAK_GAIN, WEAK_TOTAL = 3, 1.0, 8.0
#: Odd words: share of sources a bigram may occur in, least bigrams of a word, and share of them that is odd.
ODD_SOURCES, ODD_PAIRS, ODD_SHARE = 0.1, 3, 0.7
LOSS = "�"


@lru_cache(maxsize=64)
def _gaps(page: str) -> dict[str, bytes]:
    """C1 controls that stand for the bytes ``page`` leaves undefined."""
    return {chr(i): bytes([i]) for i in range(0x80, 0xA0) if not bytes([i]).decode(page, errors="ignore")}


_HIGH_TOKEN = re.compile(r"(?<![^\x00-\x20])[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]*")
_TOKEN = re.compile(r"[^\x00-\x20]+")
_WIDE_CHARS = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힣豈-﫿＀-￯]+")


def _encode(text: str, page: str) -> bytes | None:
    base = page.rstrip("+")
    try:
        return text.encode(base)
    except UnicodeEncodeError:
        if base == page:
            return None
    gaps = _gaps(base)
    try:
        return b"".join(gaps.get(c) or c.encode(base) for c in text)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, page: str) -> str | None:
    base = page.rstrip("+")
    try:
        return data.decode(base)
    except UnicodeDecodeError:
        if base == page:
            return None
    gaps = _gaps(base)
    return "".join(chr(b) if chr(b) in gaps else bytes([b]).decode(base, errors="replace") for b in data)


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """Script class of a character; '' joins any script, '!' spoils a reading."""
    o = ord(c)
    if o < 0x80:
        return "" if o >= 0x20 else "!"
    kind = unicodedata.category(c)
    if kind in ("Cc", "Cn", "Co", "Cs") or 0x2500 <= o < 0x25A0:
        return "!"
    if kind[0] != "L":
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin" if c not in "ªº" else ""
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190:
        return "hangul"
    if 0x3040 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0:
        return "cjk"
    return "other"


class _Scripts(dict):
    def __missing__(self, c: str) -> str:
        self[c] = out = _script(c)
        return out


_SCRIPT_OF = _Scripts()
_NEVER = {"!", "other"}


def _plausible(text: str) -> bool:
    scripts = set(map(_SCRIPT_OF.__getitem__, text))
    scripts.discard("")
    return len(scripts) <= 1 and scripts.isdisjoint(_NEVER)


@lru_cache(maxsize=64)
def _bytes_of(page: str) -> tuple[frozenset[str], dict[int, str]]:
    """The non-ASCII characters of a single-byte page, and their bytes as Latin-1."""
    table = {seen: chr(b) for b in range(0xFF, 0x7F, -1) if (seen := _decode(bytes([b]), page)) and _encode(seen, page) == bytes([b])}
    return frozenset(table), {ord(c): x for c, x in table.items()}


@lru_cache(maxsize=1024)
def _swap(page: str, true: str) -> dict[int, str]:
    """What each character of ``page`` is in ``true``; what it can't be is no character."""
    table = {}
    for b in range(0x80, 0x100):
        seen = _decode(bytes([b]), page)
        if seen:
            table[ord(seen)] = _decode(bytes([b]), true) or "\ufffe"
    return table


_TWICE_READ = ("cp1252+", "latin_1", "mac_roman")


def readings(word: str) -> list[tuple[str, str]]:
    """(cipher, reading) for each pair of pages that decodes ``word`` to something plausible."""
    out: dict[str, str] = {}
    wide = bool(_WIDE_CHARS.search(word))
    tried: dict[bytes, dict[str, str | None]] = {}
    high = {c for c in word if c >= "\x80"}
    for page in READ_WIDE if wide else READ_AS:
        if wide:
            data = _encode(word, page)
            if data is None:
                continue
        else:
            held, to_bytes = _bytes_of(page)
            if not high <= held:
                continue
            data = word.translate(to_bytes).encode("latin_1")
        texts = tried.get(data)  # pages that give the same bytes give the same texts
        if texts is None:
            texts = tried[data] = {t: _decode(data, t) if t in WRITTEN_WIDE else word.translate(_swap(page, t)) for t in WRITTEN if not wide or t in WRITTEN_WIDE}
        elif page not in _TWICE_READ:
            continue
        for true, text in texts.items():
            if true == page or text is None or text == word:
                continue
            if true == "utf_8" and page in _TWICE_READ:
                again = _encode(text, page)
                deeper = _decode(again, true) if again is not None else None
                if deeper is not None and deeper != text and _plausible(deeper):
                    out.setdefault(deeper, f"{page}>{TWICE}")
            if text not in out and _plausible(text):
                out[text] = f"{page}>{true}"
    return [(cipher, text) for text, cipher in out.items()]


@lru_cache(maxsize=256)
def translation(cipher: str) -> dict[int, str]:
    """The substitution table of a single-byte pair, for str.translate."""
    page, true = cipher.split(">")
    table = {}
    for b in range(0x80, 0x100):
        seen, meant = _decode(bytes([b]), page), _decode(bytes([b]), true)
        if seen and meant:
            table[ord(seen)] = meant
    return table


def apply_cipher(word: str, cipher: str) -> str:
    page, true = cipher.split(">")
    if true in WRITTEN_WIDE or true == TWICE or page in READ_WIDE:
        steps = 2 if true == TWICE else 1
        for _ in range(steps):
            data = _encode(word, page)
            word = _decode(data, "utf_8" if true == TWICE else true) if data is not None else word
        return word
    return word.translate(translation(cipher))


def pieces(token: str) -> list[str]:
    """Parts of a blank-free token that one cipher can have made: wide characters apart from others."""
    if not _WIDE_CHARS.search(token):
        return [token]
    out, last = [], 0
    for m in re.finditer(r"[^\x00-\x7fᄀ-ᇿ⺀-鿿가-힣豈-﫿＀-￯]{2,}", token):
        if len(m.group()) < 2:
            continue
        out += [token[last : m.start()], m.group()]
        last = m.end()
    return [p for p in [*out, token[last:]] if p]


def tokens(text: str) -> list[str]:
    """The blank-free tokens of a text that hold a non-ASCII character."""
    return _HIGH_TOKEN.findall(text)


def parts(token: str) -> list[str]:
    return [token] if not _WIDE_CHARS.search(token) else [p for p in pieces(token) if not p.isascii()]


class Bigrams:
    """Bigrams with a non-ASCII character of many stretches, word ends included, and whose they are."""

    def __init__(self, stretches: list[str]):
        self.n = len(stretches)
        codes = np.frombuffer(("\n" + "".join(s + "\n" for s in stretches)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        a, b = codes[:-1], codes[1:]
        kept = (a >= 128) | (b >= 128)
        self.owner = np.repeat(np.arange(self.n), [len(s) + 1 for s in stretches])[kept] if self.n else np.zeros(0, dtype=np.int64)
        self.a, self.b = a[kept], b[kept]
        self.cell = (self.a * 1_000_003 + self.b * 7919 + 17) % CELLS
        self.row = (self.a * 69_069 + 5) % CELLS

    def scores(self, pairs: np.ndarray, singles: np.ndarray) -> np.ndarray:
        """Log likelihood of each stretch."""
        logs = np.log((pairs[self.cell] + ALPHA) / (singles[self.row] + ALPHA * SPREAD))
        return np.bincount(self.owner, weights=logs, minlength=self.n)

    def add(self, weights: np.ndarray, pairs: np.ndarray, singles: np.ndarray) -> None:
        w = weights[self.owner]
        pairs += np.bincount(self.cell, weights=w, minlength=CELLS)
        singles += np.bincount(self.row, weights=w, minlength=CELLS)


class Model:
    """Bigram tables, in how many sources each pair of them occurs, and the ciphers' shares over all sources."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, base: dict, spread: np.ndarray | None = None, sources: int = 0):
        self.pairs, self.singles, self.base, self.spread, self.sources = pairs, singles, base, spread, sources

    def prior(self, cipher: str, own: dict | None) -> float:
        """Log share of a cipher in a source; sources without garbled words go by the overall shares."""
        base = self.base.get(cipher, 0.0)
        mine = own.get(cipher, 0.0) if own else base
        return math.log(mine / 2 + base / 2 + START_SHARE.get(cipher.partition(">")[2], START_SHARE[""]))

    def posterior(self, clean: float, scored: list[tuple[str, float]], own: dict | None) -> tuple[float, str]:
        """(weight of clean, best cipher)."""
        logs = [x + self.prior(c, own) for c, x in scored]
        top = max([clean, *logs])
        total = math.exp(clean - top) + sum(math.exp(x - top) for x in logs)
        return math.exp(clean - top) / total, scored[max(range(len(logs)), key=lambda i: logs[i])][0]

    def views(self, stretches: list[str]) -> list[tuple[float, list[tuple[str, float]], dict[str, float]]]:
        """What :meth:`judge` needs of each stretch whatever its source: scores, and what each cipher would gain."""
        options = [readings(w) for w in stretches]
        flat = stretches + [t for o in options for _, t in o]
        scores = Bigrams(flat).scores(self.pairs, self.singles).tolist()
        out, k = [], len(stretches)
        for i, o in enumerate(options):
            scored = [(c, x) for (c, _), x in zip(o, scores[k : k + len(o)])]
            k += len(o)
            out.append((scores[i], scored, {c: x - scores[i] for c, x in scored if x - scores[i] > WEAK_GAIN}))
        return out

    def judge(self, view, own: dict | None) -> tuple[str | None, dict[str, float]]:
        """The cipher that garbled a stretch, or None, and what likelihood each cipher would gain."""
        clean, scored, gains = view
        if not gains:
            return None, gains
        stays, cipher = self.posterior(clean, scored, own)
        least = MIN_POSTERIOR.get(cipher.partition(">")[2], MIN_POSTERIOR[""])
        sure = 1 - stays >= least and gains.get(cipher, 0.0) >= MIN_GAIN
        return (cipher if sure else None), gains

    def odd(self, stretches: list[str]) -> np.ndarray:
        """Which stretches are mostly of bigrams that next to no other source has."""
        if self.spread is None or self.sources < 3:
            return np.zeros(len(stretches), dtype=bool)
        g = Bigrams(stretches)
        rare = self.spread[g.cell] <= max(1.0, ODD_SOURCES * self.sources)
        many = np.bincount(g.owner, minlength=g.n)
        return (many >= ODD_PAIRS) & (np.bincount(g.owner, weights=rare, minlength=g.n) >= ODD_SHARE * many)

    def turns(self, stretch: str, table: dict[str, str] | None) -> str | None:
        """The stretch by a source's learned table, if that is likelier than the stretch."""
        if not table or LOSS in stretch or not any(c in table for c in stretch):
            return None
        text = stretch.translate({ord(k): v for k, v in table.items()})
        was, now = Bigrams([stretch, text]).scores(self.pairs, self.singles)
        return text if text != stretch and self.odd([stretch])[0] and now - was >= MIN_GAIN else None


def _pack(pairs) -> str:
    """Pairs of texts as one; control characters stand in no reading."""
    return "\x1e".join(f"{a}\x1f{b}" for a, b in pairs)


def _unpack(packed: str | None) -> list[list[str]]:
    return [e.split("\x1f") for e in packed.split("\x1e")] if packed else []


def _shares_of(packed: str | None) -> dict[str, float] | None:
    return {c: float(x) for c, x in _unpack(packed)} if packed else None


_WORDS = "word string, source string, n long, options string"
_STATS = "kind int, source string, key string, weight double"


def _flush(kind: int, source: str, counts: dict) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "source": source, "key": [str(k) for k in counts], "weight": list(counts.values())})


def _dense(kind: int, counts: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(counts)
    return pd.DataFrame({"kind": kind, "source": "", "key": at.astype(str), "weight": counts[at]})


def _statistics(model: Model | None):
    """Bigram counts and cipher shares of the rows (word, source, n, options, own), by a model or, at the start, without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles, shares = np.zeros(CELLS), np.zeros(CELLS), defaultdict(lambda: defaultdict(float))
        for pdf in batches:
            which, distinct = pd.factorize(pdf["word"])
            first = np.zeros(len(distinct), dtype=int)
            first[which[::-1]] = np.arange(len(pdf))[::-1]
            word, packed = pdf["word"].to_numpy(), pdf["options"].to_numpy()
            options = [_unpack(packed[i]) for i in first]
            n = pdf["n"].to_numpy(dtype=float)
            plain = np.array([not o for o in options], dtype=bool)[which] if len(options) else np.zeros(0, dtype=bool)
            flat = [word[i] for i in first] + [t for o in options for _, t in o]
            start = len(first) + np.concatenate([[0], np.cumsum([len(o) for o in options])]).astype(int)
            grams, weights = Bigrams(flat), np.zeros(len(flat))
            if model is None:
                # at the start, words that some cipher explains speak for the languages in part only
                np.add.at(weights, which, np.where(plain, n, AMBIGUOUS * n))
            else:
                scores = grams.scores(model.pairs, model.singles)
                names = sorted({c for o in options for c, _ in o})
                number = {c: i for i, c in enumerate(names)}
                cipher = np.array([number[c] for o in options for c, _ in o], dtype=int)
                number_of, sources = pd.factorize(pdf["source"])
                owns = pdf["own"].to_numpy()
                for at, s in enumerate(sources):
                    rows = np.flatnonzero((number_of == at) & ~plain)
                    if not len(rows):
                        continue
                    own = _shares_of(owns[rows[0]])
                    prior = np.array([model.prior(c, own) for c in names])
                    w = which[rows]
                    size = start[w + 1] - start[w]
                    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
                    take = np.repeat(start[w] - begin, size) + np.arange(size.sum())  # the readings of each row, in flat
                    logs = scores[take] + prior[cipher[take - len(first)]]
                    clean = scores[w]
                    top = np.maximum(np.maximum.reduceat(logs, begin), clean)
                    like = np.exp(logs - np.repeat(top, size))
                    stay = np.exp(clean - top)
                    total = np.add.reduceat(like, begin) + stay
                    best = np.maximum.reduceat(like, begin)
                    k = np.flatnonzero(like == np.repeat(best, size))
                    k = k[np.unique(np.repeat(np.arange(len(rows)), size)[k], return_index=True)[1]]  # the first best of each row
                    p, stays = n[rows] * best / total, n[rows] * stay / total
                    np.add.at(weights, w, stays)
                    np.add.at(weights, take[k], p)
                    sums = np.bincount(cipher[take[k] - len(first)], weights=p, minlength=len(names))
                    mine = shares[s]
                    for i in np.flatnonzero(sums > 1e-6):
                        mine[names[i]] += float(sums[i])
                    mine["="] += float(n[rows].sum())
            grams.add(weights, pairs, singles)
            if len(shares) > 10_000:
                for s, c in shares.items():
                    yield _flush(2, s, c)
                shares.clear()
        yield _dense(0, pairs)
        yield _dense(1, singles)
        for s, c in shares.items():
            yield _flush(2, s, c)

    return run


def _sums(stats: DataFrame) -> DataFrame:
    return stats.groupBy("kind", "source", "key").agg(F.sum("weight").alias("weight"))


def _fit(stats: DataFrame, constant: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model, and (source, own: shares of the ciphers that turned up in the source)."""
    sums = cut(_sums(stats if constant is None else stats.unionByName(constant)))
    pairs, singles = np.zeros(CELLS, dtype=np.float32), np.zeros(CELLS, dtype=np.float32)
    cells = sums.where("kind < 2").select("kind", F.col("key").cast("int").alias("k"), "weight").toPandas()  # at most 2 * CELLS rows
    for kind, table in ((0, pairs), (1, singles)):
        got = cells[cells["kind"] == kind]
        table[got["k"].to_numpy(dtype=int)] = got["weight"].to_numpy()
    rows = sums.where("kind = 2")
    every = rows.groupBy("key").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect()  # one row per cipher
    total = max([r["weight"] for r in every if r["key"] == "="], default=1.0)
    base = {r["key"]: r["weight"] / total for r in every if r["key"] != "="}
    mass = rows.groupBy("source").agg(F.sum(F.when(F.col("key") == "=", F.col("weight"))).alias("total"))
    share = (F.col("weight") / F.greatest("total", F.lit(1.0))).cast("string")
    some = rows.where("key <> '=' and weight >= 1").join(mass, "source").select("source", F.concat_ws("\x1f", "key", share).alias("e"))
    shares = some.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("e")), "\x1e").alias("own"))
    return Model(pairs, singles, base), _bounded(shares, sum(r["n"] for r in every))


#: Rows of a frame of sources up to which it is broadcast; larger ones are joined by the engine's choice.
BROADCAST_ROWS = 20_000


def _bounded(sources: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(sources) if rows <= BROADCAST_ROWS else sources


def _rows(documents: DataFrame, text_col: str, source_col: str, *more) -> DataFrame:
    return documents.select(*more, F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).where(F.col("text").rlike(r"[^\x00-\x7f]"))


def word_table(documents: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(word, source, n, options) over all documents, for every word with a non-ASCII character."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict = defaultdict(Counter)
            for text, source in zip(pdf["text"], pdf["source"]):
                seen[source].update(tokens(text))
            counts: dict = defaultdict(int)
            for source, found in seen.items():
                for t, n in found.items():
                    for p in parts(t):
                        counts[p, source] += n
            yield pd.DataFrame([(w, s, n) for (w, s), n in counts.items()], columns=["word", "source", "n"])

    def options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, found = None, ""
        for pdf in batches:
            out = []
            for w in pdf["word"]:
                if w != last:
                    last, found = w, _pack([] if LOSS in w else readings(w))
                out.append(found)
            pdf["options"] = out
            yield pdf

    counts = _rows(documents, text_col, source_col).mapInPandas(extract, "word string, source string, n long").groupBy("word", "source").agg(F.sum("n").alias("n"))
    together = counts.repartition(width(documents.sparkSession), "word").sortWithinPartitions("word")
    return together.mapInPandas(options, _WORDS)


class Learned:
    """The model; shares (source, own) and learned tables (source, table) as frames; the scores of words that may be
    garbled, or None where they are too many to be broadcast and each task works them out for itself."""

    def __init__(self, model: Model, shares: DataFrame, tables: DataFrame, hot: dict | None):
        self.model, self.shares, self.tables, self.hot = model, shares, tables, hot


def learn(documents: DataFrame, text_col: str, source_col: str, rounds: int = ROUNDS) -> Learned:
    table = cut(word_table(documents, text_col, source_col))
    none = F.lit(None).cast("string")
    open_words = table.where("options <> ''")
    constant = cut(_sums(table.where("options = ''").withColumn("own", none).mapInPandas(_statistics(None), _STATS)))  # says the same in every round
    model, shares = _fit(open_words.withColumn("own", none).mapInPandas(_statistics(None), _STATS), constant)
    mass = None
    for k in range(rounds):
        if k == SURE_AFTER:
            marked = cut(_spread(open_words, shares, _marked, model, _WORDS + ", open boolean"))
            sure, open_words = marked.where("not open").withColumn("options", F.lit("")).withColumn("own", none), marked.where("open").drop("open")
            kept = sure.groupBy("source").agg(F.sum("n").cast("double").alias("weight")).select(F.lit(2).alias("kind"), "source", F.lit("=").alias("key"), "weight")
            constant = cut(_sums(constant.unionByName(sure.drop("open").mapInPandas(_statistics(None), _STATS)).unionByName(kept)))
            open_words = cut(open_words.repartition(min(width(table.sparkSession), 1 + open_words.count() // TASK_ROWS)))
        model, shares = _fit(_spread(open_words, shares, _statistics, model, _STATS), constant)
        now = sum(model.base.values())  # the share of words taken for garbled
        if mass is not None and abs(now - mass) <= SETTLED * mass:
            break
        mass = now
    else:
        warnings.warn(f"{rounds} rounds did not settle the share of garbled words ({mass} to {now})", stacklevel=2)
    tables = _tables(table, shares, model)
    rows = cut(_spread(table, shares, _hot, model, "word string, view string").distinct())
    hot = {r["word"]: _view_of(r["view"]) for r in rows.collect()} if rows.count() <= HOT_WORDS else None
    return Learned(model, shares, tables, hot)


def _hot(model: Model):
    """(word, view) of the words that some cipher would gain, or that are odd."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = pdf.drop_duplicates("word")
            part = part[~part["word"].str.contains(LOSS, regex=False)]
            words_, options = part["word"].tolist(), [_unpack(o) for o in part["options"]]
            scores = Bigrams(words_ + [t for o in options for _, t in o]).scores(model.pairs, model.singles).tolist()
            odd, k, rows = model.odd(words_), len(words_), []
            for i, (w, o) in enumerate(zip(words_, options)):
                mine = scores[k : k + len(o)]
                k += len(o)
                if odd[i] or any(x - scores[i] > WEAK_GAIN for x in mine):
                    rows.append((w, _pack([("", repr(scores[i])), *((c, repr(x)) for (c, _), x in zip(o, mine))])))
            yield pd.DataFrame(rows, columns=["word", "view"])

    return run


def _view_of(packed: str) -> tuple[float, list[tuple[str, float]], dict[str, float]]:
    (_, clean), *rest = _unpack(packed)
    scored = [(c, float(x)) for c, x in rest]
    return float(clean), scored, {c: x - float(clean) for c, x in scored if x - float(clean) > WEAK_GAIN}


def _spread(table: DataFrame, shares: DataFrame, make, model: Model, schema: str) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(model)  # tables of CELLS numbers and a share per cipher

    def run(batches):
        yield from make(shared.value)(batches)

    return table.join(shares, "source", "left").select(*table.columns, "own").mapInPandas(run, schema)


def _marked(model: Model):
    """Rows with ``open``: whether any reading comes near the word itself, even if its cipher had made every word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            which, distinct = pd.factorize(pdf["word"])
            first = np.zeros(len(distinct), dtype=int)
            first[which[::-1]] = np.arange(len(pdf))[::-1]
            options = [[t for _, t in _unpack(pdf["options"].iloc[i])] for i in first]
            scores = Bigrams([*distinct, *(t for o in options for t in o)]).scores(model.pairs, model.singles)
            best = np.full(len(distinct), -np.inf)
            np.maximum.at(best, np.repeat(np.arange(len(distinct)), [len(o) for o in options]), scores[len(distinct) :])
            yield pdf.drop(columns="own").assign(open=(best > scores[: len(distinct)] - SURE)[which])

    return run


# pages outside the book ----------------------------------------------------------
_CELLS_OF = "source string, cell int"
_PAIRS = "script string, source string, a string, b string, weight double"


def _cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        g = Bigrams(pdf["word"].tolist())
        source = pdf["source"].to_numpy()
        yield pd.DataFrame({"source": source[g.owner], "cell": g.cell.astype(np.int32)}).drop_duplicates()


def _letters(model: Model):
    """Letter bigrams of clean words by script, and symbol bigrams of odd words by source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words_, sources, n = pdf["word"].tolist(), pdf["source"].tolist(), pdf["n"].tolist()
            odd = model.odd(words_)
            for i in np.flatnonzero(odd):  # what the book explains needs no other page
                texts = [t for _, t in _unpack(pdf["options"].iloc[i])]
                scores = Bigrams([words_[i], *texts]).scores(model.pairs, model.singles)
                odd[i] = not (scores[1:] - scores[0] > WEAK_GAIN).any()
            counts: dict = defaultdict(float)
            for w, s, k, o in zip(words_, sources, n, odd):
                if LOSS in w or _WIDE_CHARS.search(w):
                    continue
                if o:
                    letters = w
                else:
                    scripts = {_alphabet(c) for c in w if c >= "\x80"} - {""}
                    if len(scripts) != 1:
                        continue
                    s, letters = "", w
                key = "" if o else next(iter(scripts))
                a = END
                for b in letters + END:
                    counts[key, s, a, b] += k
                    a = b
            yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["script", "source", "a", "b", "weight"])

    return run


@lru_cache(maxsize=65536)
def _alphabet(c: str) -> str:
    """Script of a letter of an alphabet that a single-byte page can hold."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    name = unicodedata.name(c, "").partition(" ")[0]
    return name.lower() if name in ("LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "THAI", "ARMENIAN", "GEORGIAN") else ""


def _tables(table: DataFrame, shares: DataFrame, model: Model) -> DataFrame:
    """(source, table): symbol -> letter of the page outside the book that garbled words of the source."""
    spread = table.where("word is not null").mapInPandas(_cells_of, _CELLS_OF).distinct().groupBy("cell").count().toPandas()  # at most CELLS rows
    model.spread = np.zeros(CELLS, dtype=np.float32)
    model.spread[spread["cell"].to_numpy(dtype=int)] = spread["count"].to_numpy()
    model.sources = table.select("source").distinct().count()
    counts = cut(_spread(table, shares, _letters, model, _PAIRS).groupBy("script", "source", "a", "b").agg(F.sum("weight").alias("weight")))
    # letter bigrams of eight alphabets: their letters are those of a few Unicode blocks
    known = counts.where("script <> ''").select("script", "a", "b", "weight").toPandas()
    languages = {s: Language({(a, b): w for a, b, w in zip(g["a"], g["b"], g["weight"])}) for s, g in known.groupby("script")}
    shared = table.sparkSession.sparkContext.broadcast(languages)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = learn_table({(a, b): w for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"])}, shared.value)
        rows = [(pdf["source"].iloc[0], got)] if got else []
        return pd.DataFrame({"source": pd.Series([s for s, _ in rows], dtype=object), "table": pd.Series([_pack(t.items()) for _, t in rows], dtype=object)})

    # a group is the different symbol bigrams of one source, not its words
    tables = cut(counts.where("script = ''").groupBy("source").applyInPandas(one, "source string, table string"))
    return _bounded(tables, tables.count())


def _lone(word: str) -> bool:
    return sum(c >= "\x80" or c.isalpha() for c in word) == 1


def mend(text: str, views: list, judge, turn) -> tuple[str, int, int]:
    """(text with garbled words restored, number restored, number lost for good)."""
    weak: dict = defaultdict(float)
    seen: dict = defaultdict(int)
    verdicts, learned, lossy = {}, {}, LOSS in text
    for p, v in views:
        if p in verdicts or p in learned:
            continue
        other = None if v[2] else turn(p)
        if other is not None:
            learned[p] = other
        elif v[2]:
            verdicts[p] = judge(v)
            for cipher, gain in v[2].items():
                weak[cipher] += gain
                seen[cipher] += 1
    if not weak and not lossy and not learned:
        return text, 0, 0  # no reading of any word is likelier than the word
    together = max((c for c in weak if seen[c] >= WEAK_WORDS and weak[c] >= WEAK_TOTAL), key=lambda c: (weak[c], c), default=None)
    # A lone character proves little: some other word has to speak for its cipher.
    spoken = {v[0] for w, v in verdicts.items() if not _lone(w)}
    restored = lost = 0

    def piece(p: str) -> str:
        nonlocal restored, lost
        if p.isascii():
            return p
        if LOSS in p:
            lost += 1
            return p
        if p in learned:
            restored += 1
            return learned[p]
        cipher, gains = verdicts.get(p, (None, {}))
        if cipher not in spoken:
            cipher = None
        if cipher is None and together in gains:
            cipher = together
        if cipher is None:
            return p
        restored += 1
        return apply_cipher(p, cipher)

    def token(m) -> str:
        t = m.group()
        return t if t.isascii() else "".join(map(piece, pieces(t)))

    return _TOKEN.sub(token, text), restored, lost


#: Token views that a task keeps.
KEPT = 200_000


def repair(documents: DataFrame, id_col: str, text_col: str, source_col: str, learned: Learned, with_text: bool = True) -> DataFrame:
    """(id, repaired, n_restored, n_lost) of each document with non-ASCII text."""
    shared = documents.sparkSession.sparkContext.broadcast((learned.model, learned.hot))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hot = shared.value
        known: dict[str, list] = {}  # token -> its parts and their views
        for pdf in batches:
            if len(known) > KEPT:
                known.clear()
            held = [{*tokens(t)} for t in pdf["text"]]
            fresh = [t for t in set().union(*held) if t not in known]
            split = [parts(t) for t in fresh]
            if hot is not None:
                known.update((t, [(p, hot[p]) for p in ps if p in hot]) for t, ps in zip(fresh, split))
                fresh, split = [], []
            every = list(dict.fromkeys(p for ps in split for p in ps if LOSS not in p))
            views = dict(zip(every, model.views(every)))
            # only what some cipher would gain, or a page outside the book might, is looked at again
            odd = dict(zip(every, model.odd(every)))
            for t, ps in zip(fresh, split):
                known[t] = [(p, views[p]) for p in ps if p in views and (views[p][2] or odd[p])]
            out = []
            for text, mine, own, table in zip(pdf["text"], held, pdf["own"], pdf["table"]):
                seen = [v for t in mine for v in known[t]]
                if not seen and LOSS not in text:
                    out.append((text, 0, 0))
                    continue
                shares, symbols = _shares_of(own), dict(_unpack(table))
                out.append(mend(text, seen, lambda v: model.judge(v, shares), lambda p: model.turns(p, symbols)))  # noqa: B023
            yield pd.DataFrame({id_col: pdf["id"], "repaired": [o[0] if with_text else None for o in out], "n_restored": [o[1] for o in out], "n_lost": [o[2] for o in out]})

    rows = _rows(documents, text_col, source_col, F.col(id_col).alias("id"))
    rows = rows.join(learned.shares, "source", "left").join(learned.tables, "source", "left")
    return rows.mapInPandas(run, f"{id_col} {kind}, repaired string, n_restored int, n_lost int")


def found(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id) of each document with a garbled stretch."""
    learned = learn(documents, text_col, source_col)
    rows = repair(documents, id_col, text_col, source_col, learned, with_text=False)
    return rows.where("n_restored + n_lost > 0").select(id_col).distinct()
