"""XML documents, JSP pages, YAML and properties files: what brackets and charts don't cover."""

from __future__ import annotations

import re
from xml.parsers import expat

from lodegraph.llm.syntax import grammars, lexers
from lodegraph.llm.syntax.brackets import SyntaxFault

_NAME = r"[^\W\d][\w.\-]*(?::[^\W\d][\w.\-]*)?"
_XML = re.compile(
    r"(?P<text>[^<&]+)|(?P<entity>&(?:\w+|#\d+|#x[0-9a-fA-F]+);)|(?P<comment><!--(?:(?!--).)*-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<pi><\?.*?\?>)|(?P<doctype><!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*')*(?:\[.*?\]\s*)?>)"
    rf"|(?P<close></(?P<cname>{_NAME})\s*>)|(?P<open><(?P<oname>{_NAME})(?P<attrs>(?:\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<self>/?)>)",
    re.S,
)


def xml(text: str) -> None:
    """Tags are brackets that carry names; exactly one element, nothing but white space around it."""
    at = 1 if text.startswith("﻿") else 0
    stack: list[tuple[str, int]] = []
    rooted = False
    n = len(text)
    while at < n:
        m = _XML.match(text, at)
        if not m:
            raise SyntaxFault(at, text[at : at + 10])
        kind = m.lastgroup if m.lastgroup not in ("cname", "oname", "attrs", "self") else ("close" if m.group("close") else "open")
        if m.group("open"):
            if rooted and not stack:
                raise SyntaxFault(at, m.group("oname"))
            rooted = True
            if not m.group("self"):
                stack.append((m.group("oname"), at))
        elif m.group("close"):
            if not stack or stack[-1][0] != m.group("cname"):
                raise SyntaxFault(at, m.group("cname"))
            stack.pop()
        elif kind in ("text", "entity", "cdata") and not stack and (kind != "text" or m.group().strip()):
            raise SyntaxFault(at, m.group()[:10])
        elif kind == "pi" and m.group().startswith("<?xml ") and at > 1:
            raise SyntaxFault(at, "<?xml")
        at = m.end()
    if stack:
        raise SyntaxFault(stack[-1][1], stack[-1][0])
    if not rooted:
        raise SyntaxFault(n, "end")


def xml_exactly(text: str) -> bool:
    try:
        expat.ParserCreate().Parse(text.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError, ValueError):
        return False
    return True


_JSP = re.compile(r"<%--|<%@|<%!|<%=|<%|<!--|\$\{|#\{|</?[A-Za-z][\w.\-]*:[A-Za-z]")
_TAG = re.compile(r"<(/?)([A-Za-z][\w.\-]*:[\w.\-]+)((?:\s+[\w:.\-]+\s*=\s*(?:\"(?:[^\"]|<%=.*?%>)*\"|'(?:[^']|<%=.*?%>)*'))*)\s*(/?)>", re.S)


_ELS = re.compile(r"[$#]\{((?:[^}'\"]|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*)(\}?)", re.S)


def _expression(m: re.Match, at: int) -> None:
    if not m.group(2):
        raise SyntaxFault(at, m.group()[:2])
    if "<%" not in m.group(1):
        try:
            grammars.language("el").check(lexers.el(m.group(1)))
        except SyntaxFault as f:
            raise SyntaxFault(at + 2 + f.offset, f.what) from None


def jsp(text: str) -> None:
    """Scriptlets become one method body, with a statement for every stretch of template text."""
    code: list[tuple[str, int]] = []
    members: list[tuple[str, int]] = []
    tags: list[tuple[str, int]] = []
    at, n = 0, len(text)
    written = [("ID", 0), (".", 0), ("ID", 0), ("(", 0), (")", 0), (";", 0)]
    while at < n:
        m = _JSP.search(text, at)
        start = m.start() if m else n
        if text[at:start].strip():
            code += [(t, at) for t, _ in written]
        if not m:
            break
        kind = m.group()
        if kind in ("<%--", "<%@", "<%!", "<%=", "<%"):
            mark = "--%>" if kind == "<%--" else "%>"
            end = text.find(mark, m.end())
            if end < 0:
                raise SyntaxFault(start, kind)
            body = text[m.end() : end]
            if kind == "<%@":
                if not re.fullmatch(r"\s*[A-Za-z]\w*(?:\s+[\w:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*", body):
                    raise SyntaxFault(start, kind)
            elif kind != "<%--":
                tokens = [(t, m.end() + o) for t, o in _fragment(body, m.end())]
                if kind == "<%!":
                    members += tokens
                elif kind == "<%=":
                    grammars.language("java expression").check(tokens)
                    code += [(t, start) for t, _ in written]
                else:
                    code += tokens
            at = end + len(mark)
        elif kind == "<!--":
            at = m.end()
        elif kind in ("${", "#{"):
            e = _ELS.match(text, start)
            _expression(e, start)
            code += [(t, start) for t, _ in written]
            at = e.end()
        else:
            t = _TAG.match(text, start)
            if not t:
                raise SyntaxFault(start, kind)
            if t.group(1):
                if not tags or tags[-1][0] != t.group(2):
                    raise SyntaxFault(start, t.group(2))
                tags.pop()
            elif not t.group(4):
                tags.append((t.group(2), start))
            code += [(x, start) for x, _ in written]
            for v in re.finditer(r"\"([^\"]*)\"|'([^']*)'", t.group(3)):
                value = v.group(1) if v.group(1) is not None else v.group(2)
                for e in _ELS.finditer(value.replace("&quot;", '"').replace("&#39;", "'")):
                    _expression(e, start)
            # expressions inside attribute values
            for e in re.finditer(r"<%=(.*?)%>", t.group(3), re.S):
                grammars.language("java expression").check(_fragment(e.group(1), start))
            at = t.end()
    if tags:
        raise SyntaxFault(tags[-1][1], tags[-1][0])
    if members:
        grammars.language("java members").check(members)
    if code:
        grammars.language("java block").check(code)


def _fragment(body: str, at: int) -> list:
    try:
        return lexers.java(body)
    except SyntaxFault as f:
        raise SyntaxFault(at + f.offset, f.what) from None


_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'\"%@`][^\n]*?|[\-?:](?=\S)[^\n]*?)\s*:(?=\s|$)")
_BLOCK = re.compile(r"[|>][+\-\d]*\s*(?:#.*)?$")
_ANCHOR = re.compile(r"(?:^|[\s\[{,])&([^\s,\[\]{}]+)")
_PROPS = re.compile(r"(?:[&!][^\s]+\s+)+")


def yaml(text: str) -> None:
    """Indentation opens and closes collections; each line is a key, an item, or goes on with a scalar."""
    stack: list[tuple[int, str]] = []  # (column, "map" or "seq")
    lines, offset = text.split("\n"), 0
    i, flow, scalar_from, open_value = 0, "", -1, False
    quoted = ""
    anchors: set[str] = set()
    for i, raw in enumerate(lines):
        at = offset
        offset += len(raw) + 1
        line = raw.rstrip("\r")
        if quoted:  # a quoted scalar goes on
            quoted = _unclosed(quoted + line)
            continue
        stripped = line.strip()
        if scalar_from >= 0:
            if not stripped or len(line) - len(line.lstrip(" ")) > scalar_from:
                continue
            scalar_from = -1
        if not stripped or stripped[0] == "#":
            continue
        anchors.update(_ANCHOR.findall(line))
        if flow:
            flow = _flow(flow + "\n" + stripped, at)
            continue
        if stripped in ("---", "...") or stripped.startswith("--- ") or stripped[0] == "%":
            stack, open_value = [], False
            continue
        column = len(line) - len(line.lstrip(" "))
        if line[column] == "\t":
            raise SyntaxFault(at + column, "tab")
        rest = line[column:]
        while True:
            item = rest == "-" or rest.startswith("- ")
            key = None if item else _KEY.match(_PROPS.sub("", rest) if rest[0] in "&!" else rest)
            if not item and not key:
                break
            while stack and stack[-1][0] > column:
                stack.pop()
                open_value = False
            kind = "seq" if item else "map"
            if stack and stack[-1][0] == column and stack[-1][1] != kind:
                if kind == "seq" and open_value:
                    stack.append((column, "seq"))  # a sequence may stand as deep as its key
                elif kind == "map" and len(stack) > 1 and stack[-2] == (column, "map"):
                    stack.pop()
                else:
                    raise SyntaxFault(at + column, rest[:10])
            elif not stack or stack[-1][0] < column:
                if stack and not open_value:
                    raise SyntaxFault(at + column, rest[:10])
                if not stack and i and any(x.strip() and x.strip()[0] != "#" for x in lines[:i]) and column:
                    raise SyntaxFault(at + column, rest[:10])
                stack.append((column, kind))
            open_value = True
            if item:
                more = rest[1:]
                column += 1 + len(more) - len(more.lstrip(" "))
                rest = more.strip()
            else:
                rest = rest[key.end() :].strip()
                if rest and (m := _KEY.match(rest)) and rest[0] not in "\"'{[|>&*!":
                    raise SyntaxFault(at + column + key.end(), rest[:10])  # a mapping can't begin behind a key
            if not rest or rest[0] == "#":
                rest = ""
                break
            if not item or not (rest.startswith("- ") or _KEY.match(rest)):
                break
        if not rest:
            continue
        if not stack or (not (item if False else open_value)):
            # a line that is neither key nor item: only a plain scalar that goes on, or the whole document
            if not stack and i == len(lines) - 1 - sum(not x.strip() for x in lines[i + 1 :]):
                continue
            raise SyntaxFault(at + column, rest[:10])
        key_line = key is not None or item or rest != line[len(line) - len(line.lstrip(" ")) :]
        if not key_line and column <= stack[-1][0]:
            raise SyntaxFault(at + column, rest[:10])
        if rest[0] == "*" and rest[1:].split(" ")[0].rstrip(",") not in anchors:
            raise SyntaxFault(at + column, rest[:10])
        if rest[0] in "&!*":
            rest = _PROPS.sub("", rest + " ").strip()
            if not rest or rest[0] == "*":
                continue
        if _BLOCK.match(rest):
            scalar_from = stack[-1][0]
        elif rest[0] in "\"'":
            quoted = _unclosed(rest)
            if not quoted:
                tail = re.sub(r"^(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')", "", rest).strip()
                if tail and tail[0] != "#":
                    raise SyntaxFault(at + column, tail[:10])
        elif rest[0] in "{[":
            flow = _flow(rest, at)
        elif rest[0] in "%@`|>,]}":
            raise SyntaxFault(at + column, rest[:10])
        open_value = key_line and False if rest else True
        open_value = open_value or (key_line and not rest[0] in "\"'{[|>")
    if quoted or flow:
        raise SyntaxFault(len(text), "end")


def _unclosed(s: str) -> str:
    """What is left open of a quoted scalar: empty when it ends within ``s``."""
    q = s[0]
    i = 1
    while i < len(s):
        if q == '"' and s[i] == "\\":
            i += 2
            continue
        if s[i] == q:
            if q == "'" and s[i + 1 : i + 2] == "'":
                i += 2
                continue
            return ""
        i += 1
    return s + " "


def _flow(s: str, at: int) -> str:
    depth: list[str] = []
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{}]", s):
        c = m.group()
        if c in "[{":
            depth.append("]" if c == "[" else "}")
        elif c in "]}":
            if not depth or depth.pop() != c:
                raise SyntaxFault(at, c)
            if not depth:
                tail = s[m.end() :].strip()
                if tail and tail[0] != "#":
                    raise SyntaxFault(at, tail[:10])
                try:
                    grammars.language("flow").check(lexers.flow(s[: m.end()]))
                except SyntaxFault as f:
                    raise SyntaxFault(at, f.what) from None
                return ""
    return s


def properties(text: str) -> None:
    """Any line is a key with or without a value; only malformed unicode escapes are errors."""
    m = re.search(r"(?<!\\)(?:\\\\)*\\u(?![0-9a-fA-F]{4})", text)
    if m:
        raise SyntaxFault(m.start(), "\\u")
