"""Substitution tables of unknown single-byte pages, learned by expectation-maximization.

A page that no book names still maps each garbled symbol to one letter. What a source's garbled
words say about that mapping is in the counts of their symbol bigrams, however many words there
are. With a language's letter bigrams P(l, m) fixed and P(c | l) unknown, each counted pair (c, d)
was made by letters (l, m) with the posterior P(l, m) P(c | l) P(d | m); expected counts of (l, c)
give the next P(c | l). Starts are the mappings of all known pages and one by frequency; the most
likely result wins, if it pays for the table that it needs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Single-byte pages tried as starts: as read, and as written.
SEEN = ["cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_15", "mac_roman", "cp437", "cp850", "cp866", "koi8_r"]
MEANT = ["cp1250", "cp1251", "cp1252", "cp1253", "cp1255", "cp1256", "cp1257", "cp874", "iso8859_2", "iso8859_4", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_8", "koi8_r", "koi8_u", "cp437", "cp737", "cp852", "cp855", "cp862", "cp866", "mac_greek", "mac_cyrillic", "mac_latin2", "ptcp154"]
STEPS, SHARP = 40, 50.0
#: A table must gain this much likelihood a pair over symbols that nothing explains, beside its own cost in letters;
#: a page maps to different letters, so this share of them must differ; symbols and pairs at least.
PAIR_GAIN = 4.5
FLOOR = -8.3
DIFFERENT = 0.85
LEAST_SYMBOLS, LEAST_PAIRS = 5, 40
END = "\n"


@lru_cache(maxsize=1024)
def page_table(seen: str, meant: str) -> dict[str, str]:
    out = {}
    for b in range(0x80, 0x100):
        x, y = bytes([b]).decode(seen, errors="ignore"), bytes([b]).decode(meant, errors="ignore")
        if x and y:
            out[x] = y
    return out


class Language:
    """Letter bigrams of one script, word ends included."""

    def __init__(self, pairs: dict[tuple[str, str], float]):
        self.letters = sorted({c for p in pairs for c in p} | {END})
        self.index = {c: i for i, c in enumerate(self.letters)}
        n = len(self.letters)
        table = np.full((n, n), 0.02)
        for (a, b), w in pairs.items():
            table[self.index[a], self.index[b]] += w
        self.joint = table / table.sum()
        self.given = np.log(table / table.sum(axis=1, keepdims=True))


def _em(joint: np.ndarray, counts: np.ndarray, emit: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """P(c | l) after EM on the pair counts; columns in ``fixed`` (word ends, plain ASCII) keep their letters."""
    for _ in range(STEPS):
        seen = emit.T @ joint @ emit
        ratio = counts / np.maximum(seen, 1e-300)
        first = emit * (joint @ emit @ ratio.T)
        second = emit * (joint.T @ emit @ ratio)
        new = first + second + 1e-9 * (emit > 0)
        new[:, fixed] = emit[:, fixed] * np.maximum(new[:, fixed], 1e-9)
        emit = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
    return emit


def learn_table(pairs: dict[tuple[str, str], float], languages: dict[str, Language]) -> dict[str, str]:
    """symbol -> letter for the garbled pairs of one source; empty where no language explains them."""
    symbols = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(symbols)}
    counts = np.zeros((len(symbols), len(symbols)))
    for (a, b), w in pairs.items():
        counts[at[a], at[b]] += w
    total = counts.sum()
    free = [c for c in symbols if c >= "\x80"]
    fixed = np.array([c < "\x80" for c in symbols])
    if len(free) < LEAST_SYMBOLS or total < LEAST_PAIRS:
        return {}
    best: tuple[float, dict[str, str]] = (0.0, {})
    often = sorted(free, key=lambda c: (-counts[at[c]].sum(), c))
    for name in sorted(languages):
        lang = languages[name]
        usual = sorted((c for c in lang.letters if c >= "\x80"), key=lambda c: (-lang.joint[lang.index[c]].sum(), c))
        if len(usual) < 4:
            continue
        starts = {tuple(zip(often, usual))}
        for s in SEEN:
            if sum(c in page_table(s, s) for c in free) < 0.9 * len(free):
                continue
            for m in MEANT:
                known = page_table(s, m)
                if sum(known.get(c) in lang.index for c in free) >= 0.6 * len(free):
                    starts.add(tuple((c, known[c]) for c in free if known.get(c) in lang.index))
        for start in sorted(starts):
            emit = np.zeros((len(lang.letters), len(symbols)))
            for c in symbols:
                if c < "\x80":
                    if c in lang.index:
                        emit[lang.index[c], at[c]] = SHARP * len(symbols)
                else:
                    emit[[lang.index[x] for x in usual], at[c]] = 1.0
            for c, x in start:
                emit[lang.index[x], at[c]] += SHARP
            emit /= np.maximum(emit.sum(axis=1, keepdims=True), 1e-300)
            emit = _em(lang.joint, counts, emit, fixed)
            belief = emit * lang.joint.sum(axis=1)[:, None]
            table = {c: lang.letters[int(np.argmax(belief[:, at[c]]))] for c in free}
            if len(set(table.values())) < DIFFERENT * len(free):
                continue
            kept = [(lang.index.get(table.get(c, c), -1)) for c in symbols]
            k = np.array(kept)
            a, b = np.nonzero(counts)
            ok = (k[a] >= 0) & (k[b] >= 0)
            given = np.where(ok, lang.given[k[a], k[b]], FLOOR)
            gain = float((counts[a, b] * (given - FLOOR)).sum()) - len(free) * np.log(len(usual))
            if gain > best[0] and gain >= PAIR_GAIN * total:
                best = (gain, table)
    return best[1]
