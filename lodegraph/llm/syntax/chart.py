"""A chart (Earley) recogniser over token types, with grammars given as text.

Grammar text: ``name : alternatives ;`` where an alternative is a sequence of
``name`` (a nonterminal, lower case), ``TYPE`` (a token type, upper case), ``'text'`` (a literal
token), ``P.name`` / ``K.name`` / ``B.name`` (a bracketed group that can be read as ``name``),
each optionally followed by ``?``, ``*`` or ``+``, and parentheses around alternatives.

Brackets are taken out before charts are built: a group is a single symbol that carries the set of
readings its content allows. Charts therefore see short sequences, and equal ones are looked up
instead of parsed again.
"""

from __future__ import annotations

import re
from functools import lru_cache

_LEX = re.compile(r"\s*(?:([a-z_][a-z0-9_]*)\s*:(?!:)|([PKBI]\.[a-z_]+)|([A-Z][A-Z0-9_]*)|([a-z_][a-z0-9_]*)|'((?:[^'\\]|\\.)+)'|([|;()?*+]))")


class Grammar:
    """Rules compiled to numbered symbols; negative numbers are terminals."""

    def __init__(self, text: str):
        self.rules: dict[str, list[list[str]]] = {}
        self._fresh = 0
        self._read(text)
        self._compile()

    # reading -----------------------------------------------------------------
    def _read(self, text: str) -> None:
        items = []
        at = 0
        text = re.sub(r"(?m)^\s*#.*$", "", text).strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError("grammar: " + text[at : at + 40])
            items.append(m.groups())
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        i = 0
        while i < len(items):
            name = items[i][0]
            if not name:
                raise ValueError(f"grammar: rule expected at {items[i]}")
            alts, i = self._alternatives(items, i + 1)
            self.rules.setdefault(name, []).extend(alts)
            if items[i][5] != ";":
                raise ValueError(f"grammar: ; expected in {name}")
            i += 1

    def _alternatives(self, items, i):
        alts, seq = [], []
        while True:
            head, group, upper, lower, lit, mark = items[i]
            if mark in (";", ")"):
                return [*alts, seq], i
            if mark == "|":
                alts.append(seq)
                seq = []
                i += 1
                continue
            if mark == "(":
                inner, i = self._alternatives(items, i + 1)
                symbol = self._new(inner)
            else:
                symbol = group or upper or lower or ("'" + lit.replace("\\'", "'"))
            i += 1
            while i < len(items) and items[i][5] in ("?", "*", "+"):
                op = items[i][5]
                i += 1
                if op == "?":
                    symbol = self._new([[symbol], []])
                else:  # left recursion keeps lists linear
                    more = self._new([])
                    self.rules[more] = [[more, symbol], [symbol]] if op == "+" else [[more, symbol], []]
                    symbol = more
            seq.append(symbol)

    def _new(self, alts):
        self._fresh += 1
        name = f"_{self._fresh}"
        self.rules[name] = alts
        return name

    # compiling ---------------------------------------------------------------
    def _compile(self) -> None:
        self.nonterminal = {n: i for i, n in enumerate(self.rules)}
        self.terminal: dict[str, int] = {}
        #: items: for each dotted position the symbol after the dot (None at the end) and its owner
        self.after: list[int | None] = []
        self.owner: list[int] = []
        self.starts: list[list[int]] = [[] for _ in self.rules]
        for name, alts in self.rules.items():
            for alt in alts:
                self.starts[self.nonterminal[name]].append(len(self.after))
                for s in [*alt, None]:
                    self.after.append(None if s is None else self._symbol(s))
                    self.owner.append(self.nonterminal[name])
        self.nullable = set()
        changed = True
        while changed:
            changed = False
            for n, starts in enumerate(self.starts):
                if n not in self.nullable:
                    for s in starts:
                        k = s
                        while self.after[k] is not None and self.after[k] in self.nullable:
                            k += 1
                        if self.after[k] is None:
                            self.nullable.add(n)
                            changed = True
                            break
        self._closures: dict[int, tuple] = {}

    def _symbol(self, s: str) -> int:
        if s in self.nonterminal:
            return self.nonterminal[s]
        if s[0] != "'" and not s[0].isupper():
            raise ValueError(f"grammar: {s} is not defined")
        return self.terminal.setdefault(s, -1 - len(self.terminal))

    def closure(self, n: int) -> tuple[int, ...]:
        """Items predicted by nonterminal ``n``, dots moved over what may be empty."""
        got = self._closures.get(n)
        if got is None:
            seen, todo, done = set(), list(self.starts[n]), {n}
            while todo:
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                a = self.after[k]
                if a is not None and a >= 0:
                    if a not in done:
                        done.add(a)
                        todo += self.starts[a]
                    if a in self.nullable:
                        todo.append(k + 1)
            got = self._closures[n] = tuple(seen)
        return got


class Recogniser:
    def __init__(self, text: str, memory: int = 200_000):
        self.grammar = Grammar(text)
        self.memory = memory
        self.known: dict = {}
        #: failures by the prefix that shows them, and the lengths of such prefixes, by start symbol
        self.failed: dict[str, tuple[set, set]] = {}
        self._kinds: dict = {}

    def symbols(self, token) -> tuple[int, ...]:
        """Terminals that a token (a type, a literal, or a group's readings) stands for."""
        got = self._kinds.get(token)
        if got is None:
            t = self.grammar.terminal
            if isinstance(token, tuple):  # a group: (bracket, readings)
                got = tuple(t[f"{token[0]}.{r}"] for r in token[1] if f"{token[0]}.{r}" in t)
            else:
                kind, _, literal = token.partition(" ")
                got = tuple(t[s] for s in ([kind, "'" + literal] if literal else [kind, "'" + kind]) if s in t)
            if len(self._kinds) > self.memory:
                self._kinds.clear()
            self._kinds[token] = got
        return got

    def parse(self, start: str, tokens: tuple) -> int:
        """-1 if ``tokens`` derive from ``start``, else the index of the token that can't follow."""
        key = (start, tokens)
        if key in self.known:
            return -1
        prefixes, lengths = self.failed.setdefault(start, (set(), set()))
        for k in lengths:
            if tokens[:k] in prefixes and k <= len(tokens):
                return k - 1
        got = self._earley(self.grammar.nonterminal[start], tokens)
        if got < 0:
            if len(self.known) > self.memory:
                self.known.clear()
            self.known[key] = True
        elif got < len(tokens):
            if len(prefixes) > self.memory:
                prefixes.clear()
                lengths.clear()
            prefixes.add(tokens[: got + 1])  # whatever follows, this can't go on
            lengths.add(got + 1)
        return got

    def first(self, start: str, tokens: list, at: int, ends: set) -> tuple[int, bool]:
        """Where the shortest part of ``tokens`` from ``at`` to one of ``ends`` (or the end) that derives from ``start`` ends, and True; or the first fault and False."""
        got = self._earley(self.grammar.nonterminal[start], tokens, at, ends)
        return (len(tokens) if got == -1 else at - 1 - got, True) if got < 0 else (at + got, False)

    def _earley(self, start: int, tokens: tuple | list, at: int = 0, ends: set | tuple = ()) -> int:
        g = self.grammar
        after, owner, nullable = g.after, g.owner, g.nullable
        n = len(tokens) - at
        # chart[i]: for each symbol awaited at i, the (item, origin) pairs that wait for it
        waiting: list[dict[int, list[tuple[int, int]]]] = []
        current = {(k, 0) for k in g.closure(start)}
        accept = start in nullable and n == 0
        for i in range(n + 1):
            todo = list(current)
            seen = current
            wait: dict[int, list[tuple[int, int]]] = {}
            predicted = {start} if i == 0 else set()
            waiting.append(wait)
            accept_here = False
            while todo:
                item = todo.pop()
                k, origin = item
                a = after[k]
                if a is None:
                    done = owner[k]
                    if done == start and origin == 0:
                        accept_here = True
                    if origin != i:  # empty completions are taken care of by the closures
                        for p, o in waiting[origin].get(done, ()):
                            nxt = (p + 1, o)
                            if nxt not in seen:
                                seen.add(nxt)
                                todo.append(nxt)
                    continue
                wait.setdefault(a, []).append(item)
                if a >= 0:
                    if a not in predicted:
                        predicted.add(a)
                        for p in g.closure(a):
                            nxt = (p, i)
                            if nxt not in seen:
                                seen.add(nxt)
                                todo.append(nxt)
                    if a in nullable:
                        nxt = (k + 1, origin)
                        if nxt not in seen:
                            seen.add(nxt)
                            todo.append(nxt)
            if i == n:
                accept = accept or accept_here
                break
            if accept_here and i and at + i in ends:
                return -1 - i
            following = set()
            for t in self.symbols(tokens[at + i]):
                for p, o in wait.get(t, ()):
                    following.add((p + 1, o))
            if not following:
                return i
            current = following
        return -1 if accept else n


@lru_cache(maxsize=32)
def recogniser(text: str) -> Recogniser:
    return Recogniser(text)
