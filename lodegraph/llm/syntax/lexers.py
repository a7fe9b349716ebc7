"""Token streams of the languages: (type, offset), comments and blanks dropped.

A type is a literal (punctuation), a class (``ID``, ``NUM``, ``STR``) or ``CLASS literal`` for words
that grammars name. Characters no token begins with, and literals or comments that don't end, are
faults where they begin.
"""

from __future__ import annotations

import re

from lodegraph.llm.syntax.brackets import SyntaxFault

Token = tuple[str, int]

_JAVA_KW = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split())
_JAVA_LIT = {"true", "false", "null"}
_JAVA_SOFT = {"record", "sealed", "permits", "yield", "var", "non"}
_JAVA = re.compile(
    r'(?P<s>[ \t\r\n\f]+|//[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d(?:[\w.]|(?<=[eEpP])[+-])*|\.\d(?:[\w]|(?<=[eE])[+-])*)'
    r'|(?P<str>"""(?:[^\\]|\\.)*?"""|"(?!"")(?:[^"\\\n]|\\.)*"|""|\'(?:[^\'\\\n]|\\.[0-7a-fA-Fu]*)\')'
    r"|(?P<op>->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.\.|[-+*/%=<>!~?:;,.&|^@(){}\[\]])",
    re.S,
)


def java(text: str, start: int = 0) -> list[Token]:
    out: list[Token] = []
    at, n = start, len(text)
    match = _JAVA.match
    while at < n:
        m = match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        kind = m.lastgroup
        if kind == "id":
            w = m.group()
            out.append((w if w in _JAVA_KW else "LIT" if w in _JAVA_LIT else "ID " + w if w in _JAVA_SOFT else "ID", at))
        elif kind == "op":
            w = m.group()
            if w == "/" and text.startswith("/*", at):
                raise SyntaxFault(at, "/*")
            out.append((w, at))
        elif kind == "num":
            out.append(("LIT", at))
        elif kind == "str":
            out.append(("LIT", at))
        at = m.end()
    return out


class _Types(dict):
    """Token text -> types, filled by a lexer; '' drops a token, None marks one that can't be."""

    def __init__(self, lexer, bound: int = 200_000):
        super().__init__()
        self.lexer, self.bound = lexer, bound

    def __missing__(self, text: str):
        try:
            got = [t for t, _ in self.lexer(text)]
        except SyntaxFault:
            got = [None]
        if len(got) > 1:
            got = [None]
        if len(self) > self.bound:
            self.clear()
        self[text] = got = got[0] if got else ""
        return got


def _all_of(pattern: re.Pattern) -> re.Pattern:
    """The pattern without group names, and any other character as a token of its own."""
    return re.compile(re.sub(r"\?P<\w+>", "?:", pattern.pattern) + r"|/\*|.", pattern.flags)


_JAVA_ALL = _all_of(_JAVA)
_JAVA_TYPES = _Types(java)


def java_types(text: str) -> list[str] | None:
    """Types alone, without offsets; None if some character begins no token."""
    types = list(filter(_NOT_EMPTY, map(_JAVA_TYPES.__getitem__, _JAVA_ALL.findall(text))))
    return None if None in types else types


def _NOT_EMPTY(t) -> bool:
    return t != ""


_JS_KW = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_JS_SOFT = {"let", "of", "async", "get", "set", "static", "from", "as", "await", "yield"}
_JS = re.compile(
    r"(?P<s>[^\S\n]+|//[^\n]*|/\*.*?\*/|\n|﻿)|(?P<id>[#]?(?:[^\W\d]|[$])[\w$]*)|(?P<num>\d(?:[\w.]|(?<=[eE])[+-])*|\.\d(?:[\w]|(?<=[eE])[+-])*)"
    r'|(?P<str>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<tpl>`)'
    r"|(?P<op>=>|\?\.(?!\d)|\.\.\.|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|===|!==|==|!=|>>>=|>>=|<<=|\*\*=|>>>|>>|<<|<=|>=|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%=<>!~?:;,.&|^@(){}\[\]])",
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_JS_ENDS = {"ID", "NUM", "STR", "TPL", "REGEX", ")", "]", "++", "--"}
_JS_KW_ENDS = {"KW this", "KW null", "KW true", "KW false", "KW super", "KW break", "KW continue", "KW return", "KW debugger"}
_JS_STARTS = {"ID", "NUM", "STR", "REGEX", "++", "--", "!", "~", "@"}


def _template(text: str, at: int) -> int:
    """End of the template literal that begins at ``at``; its parts are parsed as programs' expressions elsewhere."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    continue
                if c in "\"'":
                    j = text.find(c, i + 1)
                    i = j if j > 0 else n
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    raise SyntaxFault(at, "`")


def javascript(text: str) -> list[Token]:
    out: list[Token] = []
    opened: list[str] = []
    at, n, newline = 0, len(text), False
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    match = _JS.match
    while at < n:
        m = match(text, at)
        kind = m.lastgroup if m else None
        if kind == "s":
            newline = newline or "\n" in m.group()
            at = m.end()
            continue
        end = m.end() if m else at
        if kind == "id":
            w = m.group()
            t = "KW " + w if w in _JS_KW else "ID " + w if w in _JS_SOFT else "ID"
        elif kind == "num":
            t = "NUM"
        elif kind == "str":
            t = "STR"
        elif kind == "tpl":
            end = _template(text, at)
            t = "TPL"
        elif kind == "op":
            t = m.group()
            if t[0] == "/":
                if text.startswith("/*", at):
                    raise SyntaxFault(at, "/*")
                last = out[-1][0] if out else ";"
                if last.partition(" ")[0] not in _JS_ENDS and last not in _JS_KW_ENDS and last != "}":
                    r = _JS_REGEX.match(text, at)
                    if not r:
                        raise SyntaxFault(at, "/")
                    t, end = "REGEX", r.end()
        else:
            raise SyntaxFault(at, text[at : at + 10])
        if newline and out and (not opened or opened[-1] == "{"):
            last = out[-1][0]
            if (last.partition(" ")[0] in _JS_ENDS or last in _JS_KW_ENDS) and (t.partition(" ")[0] in _JS_STARTS or (t[:2] == "KW" and t not in ("KW in", "KW instanceof"))):
                out.append(("NL", at))
        newline = False
        if t in ("(", "[", "{"):
            opened.append(t)
        elif t in (")", "]", "}") and opened:
            opened.pop()
        out.append((t, at))
        at = end
    return out


_CSS = re.compile(
    r"(?P<s>\s+|/\*.*?\*/|<!--|-->)|(?P<at>@[-\w]+)|(?P<hash>#[-\w]+)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:%|[a-zA-Z]+)?)|(?P<url>url\(\s*[^\"'()\s]*\s*\))|(?P<id>-{0,2}[^\W\d][-\w]*|--[-\w]+)"
    r'|(?P<str>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<op>[-+*/%=<>!~:;,.&|^$(){}\[\]])',
    re.S,
)


def css(text: str) -> list[Token]:
    out = []
    at = 0
    while at < len(text):
        m = _CSS.match(text, at)
        if not m or (m.lastgroup == "op" and text.startswith("/*", at)):
            raise SyntaxFault(at, text[at : at + 10])
        k = m.lastgroup
        if k != "s":
            out.append(({"at": "AT", "hash": "HASH", "num": "NUM", "url": "STR", "id": "ID", "str": "STR"}.get(k) or m.group(), at))
        at = m.end()
    return out


_JSON = re.compile(r'(?P<s>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<lit>true|false|null)\b|(?P<op>[{}\[\],:])')


def json(text: str) -> list[Token]:
    out, at = [], 0
    if text.startswith("﻿"):
        at = 1
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        k = m.lastgroup
        if k != "s":
            out.append((m.group() if k == "op" else "STR" if k == "str" else "LIT", at))
        at = m.end()
    return out


_SQL_KW = set("select from where group order having by on join left right full inner outer cross natural union minus intersect insert into values update set delete create alter table and or not null is in like between exists as case when then else end distinct connect start with for grant revoke drop using begin declare if elsif loop exception merge".split())
_SQL = re.compile(
    r"(?P<s>\s+|--[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d][\w$#]*)|(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>[nN]?'(?:[^']|'')*')|(?P<qid>\"[^\"\n]+\")|(?P<bind>:[^\W\d]\w*|:\d+|&&?\w+|\?)"
    r"|(?P<op>:=|\|\||<=|>=|<>|!=|\^=|=>|\.\.|\*\*|[-+*/%=<>;,.()@])",
    re.S,
)


def sql(text: str, words: frozenset = frozenset()) -> list[Token]:
    """``words`` are the ones that the grammar names."""
    out, at = [], 0
    while at < len(text):
        m = _SQL.match(text, at)
        if not m or (m.lastgroup == "op" and text.startswith("/*", at)):
            raise SyntaxFault(at, text[at : at + 10])
        k = m.lastgroup
        if k == "id":
            w = m.group().lower()
            out.append(("KW " + w if w in _SQL_KW else "ID " + w if w in words else "ID", at))
        elif k in ("num", "str", "bind"):
            out.append((k.upper(), at))
        elif k == "qid":
            out.append(("ID", at))
        elif k == "op":
            out.append((m.group(), at))
        at = m.end()
    return out


_SQL_ALL = _all_of(_SQL)
_SQL_TYPES: dict[frozenset, _Types] = {}


def sql_types(text: str, words: frozenset = frozenset()) -> list[str] | None:
    known = _SQL_TYPES.get(words)
    if known is None:
        known = _SQL_TYPES[words] = _Types(lambda t: sql(t, words))
    types = list(filter(_NOT_EMPTY, map(known.__getitem__, _SQL_ALL.findall(text))))
    return None if None in types else types


_PY_KW = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY = re.compile(
    r"(?P<s>[ \t\f]+|\\\r?\n|#[^\n]*)|(?P<nl>\r?\n)|(?P<str>(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'|\"\"|''))"
    r"|(?P<id>[^\W\d]\w*)|(?P<num>(?:0[xXoObB][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[jJ]?)(?!\w)"
    r"|(?P<op>->|:=|\*\*=|//=|>>=|<<=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\.\.\.|[-+*/%=<>~:;,.&|^@(){}\[\]])",
    re.S,
)


def python(text: str) -> list[Token]:
    out: list[Token] = []
    levels, depth, at, fresh = [0], 0, 0, True
    n = len(text)
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = m.end()
            if rest >= n or text[rest] in "\r\n#":
                end = text.find("\n", rest)
                at = n if end < 0 else end + 1
                continue
            width = len(m.group().expandtabs(8))
            if width > levels[-1]:
                levels.append(width)
                if out and out[-1][0] == "NEWLINE":
                    out.pop()
                out.append(("INDENT", rest))
            while width < levels[-1]:
                levels.pop()
                out.append(("DEDENT", rest))
                if width > levels[-1]:
                    raise SyntaxFault(rest, "indent")
            at, fresh = rest, False
        m = _PY.match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        k = m.lastgroup
        if k == "nl":
            if not depth:
                out.append(("NEWLINE", at))
                fresh = True
        elif k == "id":
            w = m.group()
            out.append(("KW " + w if w in _PY_KW else "ID", at))
        elif k in ("num", "str"):
            out.append(("LIT" if k == "num" else "STR", at))
        elif k == "op":
            w = m.group()
            depth += (w in "([{") - (w in ")]}")
            out.append((w, at))
        at = m.end()
    if out and out[-1][0] not in ("NEWLINE",):
        out.append(("NEWLINE", n))
    out += [("DEDENT", n)] * (len(levels) - 1)
    return out


_EL = re.compile(r"(?P<s>\s+)|(?P<id>[^\W\d][\w$]*)|(?P<num>\d[\w.]*|\.\d+)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<op>&&|\|\||==|!=|<=|>=|\+=|[-+*/%<>!?:.,()\[\]])", re.S)
_EL_WORDS = set("div mod eq ne lt gt le ge and or not empty".split())


def el(text: str) -> list[Token]:
    """Expression language of pages."""
    out, at = [], 0
    while at < len(text):
        m = _EL.match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        k, w = m.lastgroup, m.group()
        if k != "s":
            out.append((w if k == "op" or w in _EL_WORDS else "ID" if k == "id" and w not in ("true", "false", "null") else "LIT", at))
        at = m.end()
    return out


_FLOW = re.compile(
    r"(?P<s>\s+|(?<=\s)#[^\n]*)|(?P<prop>[&!][^\s,\[\]{}]*)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<op>[,\[\]{}]|:(?=[\s,\[\]{}]|$)|\?(?=\s)|(?<=[\"'}\]]):)"
    r"|(?P<plain>(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<!\s)#|[^\S\n]+(?![\s#,\[\]{}:]|$)|[^\S\n]+(?=:(?![\s,\[\]{}]|$)))+)",
    re.S,
)


def flow(text: str) -> list[Token]:
    """Flow collections of YAML; tags and anchors dropped."""
    out, at = [], 0
    while at < len(text):
        m = _FLOW.match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        k = m.lastgroup
        if k not in ("s", "prop"):
            out.append((m.group() if k == "op" else "SCALAR", at))
        at = m.end()
    return out


def returns_outside(types: list[str]) -> int | None:
    """Index of the first ``return`` of a script that no function's body holds."""
    opened: list[tuple[str, int]] = []  # bracket and where it opened
    bodies: list[bool] = []  # braces: within a function
    head = -1  # where the last closed parenthesis opened
    for i, t in enumerate(types):
        if t == "KW return" and not any(bodies[-1:]):
            return i
        if t == "{":
            last = types[i - 1] if i else ""
            inner = bodies[-1] if bodies else False
            if last == ")":
                before = types[head - 1] if head > 0 else ""
                inner = inner or before not in ("KW if", "KW for", "KW while", "KW switch", "KW with", "KW catch", "ID await")
            bodies.append(inner or last == "=>")
        elif t == "}" and bodies:
            bodies.pop()
        if t in ("(", "[", "{"):
            opened.append((t, i))
        elif t in (")", "]", "}") and opened:
            o, at = opened.pop()
            if t == ")":
                head = at
    return None
