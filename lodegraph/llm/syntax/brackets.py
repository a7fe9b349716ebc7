"""Bracketed token streams: groups are read innermost first, by what their grammar allows them to be."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodegraph.llm.syntax.chart import Recogniser

CLOSE = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
NAME = {"(": "P", "[": "K", "{": "B", "INDENT": "I"}
_OPENS = {v: k for k, v in NAME.items()}
_CLOSING = frozenset(CLOSE.values())


def _opening(t):
    """The token a symbol begins with."""
    return _OPENS[t[0]] if isinstance(t, tuple) else t


class SyntaxFault(Exception):
    """The first unrecoverable error: offset in the text and what stood there."""

    def __init__(self, offset: int, what: str):
        super().__init__(what)
        self.offset, self.what = offset, what


@dataclass
class Reading:
    """How a group's content may be read: items between separators, each of a nonterminal."""

    name: str
    item: str  # nonterminal of an item, or of the whole content if there is no separator
    separator: str | None = None
    empty: bool = True
    trailing: bool = False  # a separator may stand at the end
    holes: bool = False  # items may be empty
    whole: str | None = None  # nonterminal of the whole content, tried when items fail
    first: str | None = None  # nonterminal of the first item, if it differs
    statements: bool = False  # items are statements instead


@dataclass
class Language:
    recogniser: Recogniser
    readings: dict[str, list[Reading]]
    top: Reading
    #: tokens that continue a statement after a closing brace
    continues: frozenset = frozenset()
    end: str | None = None  # token put at the end of statements that lack one
    semicolon: str = ";"
    block: str = "B"  # the group after which a statement may end
    joins: frozenset = frozenset(["else", "KW else"])  # tokens that go on even after a semicolon
    block_first: bool = False  # a statement that begins with braces is a block, never an expression
    memory: dict = field(default_factory=dict)
    symbols_of: dict = field(default_factory=dict)

    def check(self, tokens: list[tuple[str, int]]) -> None:
        """tokens: (type, offset). Raises SyntaxFault."""
        stack: list[tuple[str, int, list]] = [("", 0, [])]
        for token in tokens:
            t, at = token
            if t in CLOSE:
                stack.append((t, at, []))
            elif t in _CLOSING:
                if len(stack) == 1 or CLOSE[stack[-1][0]] != t:
                    raise SyntaxFault(at, t)
                opening, start, content = stack.pop()
                stack[-1][2].append((self.group(opening, content, start), start))
            else:
                stack[-1][2].append(token)
        if len(stack) > 1:
            raise SyntaxFault(stack[-1][1], stack[-1][0])
        content = stack[0][2]
        fault = self.fits(self.top, content)
        if fault is not None:
            raise SyntaxFault(content[fault][1] if fault < len(content) else (content[-1][1] if content else 0), str(content[fault][0]) if fault < len(content) else "end")

    def accepts(self, types: list[str]) -> bool:
        """The same decision without places: most files are valid, and faults are looked for again."""
        known, stack, content = self.symbols_of, [], []
        for t in types:
            if t in CLOSE:
                stack.append((t, content))
                content = []
            elif t in _CLOSING:
                if not stack:
                    return False
                opening, outer = stack.pop()
                if CLOSE[opening] != t:
                    return False
                inner = tuple(content)
                symbol = known.get((opening, inner))
                if symbol is None:
                    try:
                        symbol = self.group(opening, [(x, 0) for x in inner], 0)
                    except SyntaxFault:
                        return False
                    if len(inner) < 400:
                        if len(known) > 100_000:
                            known.clear()
                        known[opening, inner] = symbol
                outer.append(symbol)
                content = outer
            else:
                content.append(t)
        return not stack and self.fits(self.top, [(x, 0) for x in content]) is None

    def group(self, opening: str, content: list, start: int):
        key = (opening, tuple(t for t, _ in content)) if len(content) < 400 else None
        got = self.memory.get(key) if key else None
        if got is None:
            ok, worst = [], -1
            for r in self.readings[opening]:
                fault = self.fits(r, content)
                if fault is None:
                    ok.append(r.name)
                else:
                    worst = max(worst, fault)
            got = ((NAME[opening], tuple(ok)), worst)
            if key:
                if len(self.memory) > 100_000:
                    self.memory.clear()
                self.memory[key] = got
        symbol, worst = got
        if not symbol[1]:
            raise SyntaxFault(content[worst][1] if 0 <= worst < len(content) else start, "in " + opening)
        return symbol

    def fits(self, r: Reading, content: list) -> int | None:
        """None if ``content`` can be read as ``r``, else the index of the first fault."""
        if not content:
            return None if r.empty else 0
        if r.statements:
            return self._statements(r.item, content)
        types = [t for t, _ in content]
        if r.separator is None:
            fault = self.recogniser.parse(r.item, tuple(types))
            return None if fault < 0 else fault
        fault = self._items(r, types)
        if fault is None or r.whole is None:
            return fault
        again = self.recogniser.parse(r.whole, tuple(types))
        return None if again < 0 else max(again, fault)

    def _items(self, r: Reading, types: list) -> int | None:
        a, last, item = 0, len(types), r.first or r.item
        sep = r.separator
        while True:
            try:
                b = types.index(sep, a)
            except ValueError:
                b = last
            if b == a:
                if not (r.holes or (b == last and r.trailing and a)):
                    return min(a, last - 1)
            else:
                fault = self.recogniser.parse(item, tuple(types[a:b]))
                if fault >= 0:
                    return a + fault
            if b == last:
                return None
            a, item = b + 1, r.item
            if a == last:
                return None if r.trailing or r.holes else last - 1

    def _cut(self, types: list, i: int) -> bool:
        """A statement may end with token ``i``."""
        t, n = types[i], len(types)
        return (t == self.semicolon and (i + 1 == n or types[i + 1] not in self.joins)) or (isinstance(t, tuple) and t[0] == self.block and (i + 1 == n or _opening(types[i + 1]) not in self.continues))

    def _statements(self, item: str, content: list) -> int | None:
        types = [t for t, _ in content]
        a, i, n = 0, 0, len(types)
        parse = self.recogniser.parse
        whole = types if not self.end or types[-1] == self.semicolon else [*types, self.end]
        cuts = None  # where statements may end, once a cut was wrong
        wrong = None  # start of the first statement that a wrong cut divided
        while i < n:
            if self._cut(types, i) or i + 1 == n:
                part = types[a : i + 1]
                if self.end and part[-1] != self.semicolon:
                    part.append(self.end)
                if self.block_first and isinstance(part[0], tuple) and part[0][0] == "B" and "block" not in part[0][1]:
                    return a
                fault = parse(item, tuple(part))
                if fault >= 0:
                    failed = a + min(fault, i - a)
                    if fault > i - a and i + 1 < n:
                        # nothing is wrong yet, so the cut may be: the statement goes on to a later one
                        cuts = cuts or {k + 1 for k in range(n) if self._cut(types, k)}
                        to, ok = self.recogniser.first(item, whole, a, cuts)
                        if ok:
                            wrong = a if wrong is None else wrong
                            a = i = to
                            continue
                        failed = max(failed, min(to, n - 1))
                    if wrong is None:
                        return failed
                    # a later cut may have been wrong as well: all from the first one as one sequence decides
                    to, ok = self.recogniser.first(item, whole, wrong, set())
                    return None if ok else max(failed, min(to, n - 1))
                a = i + 1
            i += 1
        return None
