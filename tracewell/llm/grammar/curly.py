"""A lexer for the languages of the C family without context: Go, Java, C, C++."""

from __future__ import annotations

import re

from tracewell.llm.grammar.base import Bad, Tokens

_PUNCT = r"\.\.\.|<<=|>>>=|>>=|<=>|->\*?|::|\+\+|--|&&=?|\|\|=?|==|!=|<=|<<|<-|:=|&\^=?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_NUM = r"(?:0[xX][\da-fA-F_'.]+(?:[pP][+-]?\d+)?|0[bB][01_']+|(?:\d[\d_']*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[a-zA-Z]*(?!\w)"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"


def _scanner(strings: str) -> re.Pattern:
    return re.compile(rf"(?P<w>(?:[\s﻿]|//[^\n]*|/\*.*?\*/)+)|(?P<s>{strings})|(?P<n>{_NAME})|(?P<d>{_NUM})|(?P<p>{_PUNCT})", re.S)


_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)+'"
_QUOTED = r"\"(?:[^\"\\\n]|\\[^\n])*\""
JAVA = _scanner(rf"\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|{_QUOTED}|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'")
GO = _scanner(rf"`[^`]*`|{_QUOTED}|{_CHAR}")
C = _scanner(rf"(?:u8|[uUL])?R\"(?P<raw>[^\s()\\]{{0,16}})\(.*?\)(?P=raw)\"|(?:u8|[uUL])?(?:\"(?:[^\"\\\n]|\\\r?\n|\\[^\n])*\"|{_CHAR})")


def lex(text: str, scanner: re.Pattern) -> Tokens:
    kind, value, nl, i, line, n = [], [], [], 0, True, len(text)
    match = scanner.match
    while i < n:
        m = match(text, i)
        if m is None or m.end() == i:
            raise Bad(f"character {text[i]!r}")
        k = m.lastgroup if m.lastgroup != "raw" else "s"
        i = m.end()
        if k == "w":
            line = line or "\n" in m.group() or "\r" in m.group()
            continue
        kind.append(k)
        value.append(m.group() if k in "np" else "")
        nl.append(line)
        line = False
    return Tokens(kind, value, nl)
