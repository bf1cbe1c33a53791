"""C and C++: a recursive-descent recognizer after a light preprocessor.

Conditional sections become variants of the text, so that each branch is in one of them at least; ``#if 0`` is in
none. Names in capitals may stand as attributes, as macros do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tracewell.llm.grammar import curly
from tracewell.llm.grammar.base import Bad, Parser

_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)(.*)", re.S)
_INCLUDE = re.compile(r"\s*(?:<[^<>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*(?:\([^\n]*\))?)\s*(?://.*|/\*.*)?$", re.S)
_BUILTIN = frozenset("void char short int long float double signed unsigned bool _Bool wchar_t char8_t char16_t char32_t auto __int128 _Complex".split())
_SPECIFIERS = frozenset("const volatile static extern register inline restrict typedef constexpr consteval constinit mutable virtual explicit friend thread_local _Thread_local _Noreturn __inline __inline__ __restrict __restrict__ __extension__ _Atomic".split())
_STATEMENT = frozenset("if else for while do switch case default return break continue goto try catch".split())
_KEYWORDS_C = _BUILTIN | _SPECIFIERS | _STATEMENT | frozenset("struct union enum sizeof".split())
_CPP_ONLY = frozenset("class namespace template typename using public private protected new delete this operator throw nullptr true false static_cast dynamic_cast const_cast reinterpret_cast noexcept decltype typeid co_await co_return co_yield requires concept static_assert alignof alignas".split())
_KEYWORDS_CPP = _KEYWORDS_C | _CPP_ONLY
_BINARY = frozenset("+ - * / % & | ^ << == != < <= && || <=>".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_MACRO = re.compile(r"[A-Z_][A-Z0-9_]+$")
_ATTRIBUTES = ("__attribute__", "__declspec", "alignas", "_Alignas", "__asm__", "asm", "__cdecl", "__stdcall")
_CASTS = ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast")


class _Section:
    """A conditional section: whether each branch was kept so far, and the sections inside each."""

    def __init__(self, dead: bool):
        self.kept, self.inside, self.dead, self.chosen = [False], [[]], dead, 0

    def branch(self) -> None:
        self.kept.append(False)
        self.inside.append([])

    def choose(self) -> None:
        """The first branch that is still to be kept, else the first one."""
        rank = [(self.kept[k] and not any(s.pending() for s in held), k) for k, held in enumerate(self.inside) if k or not self.dead]
        self.chosen = min(rank)[1] if rank else -1
        if rank:
            self.kept[self.chosen] = True
            for s in self.inside[self.chosen]:
                s.choose()

    def pending(self) -> bool:
        return any(not (self.dead and k == 0) and (not self.kept[k] or any(s.pending() for s in held)) for k, held in enumerate(self.inside))


def variants(text: str) -> Iterator[str]:
    """The text without directives, once for each choice of branches until every branch was kept."""
    text = re.sub(r"\\\r?\n", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines, stack, top, comment = [], [], [], False  # lines: the text and the branches that hold it
    for line in text.split("\n"):
        if not comment and (m := _DIRECTIVE.match(line)):
            word, rest = m.group(1), m.group(2)
            if "/*" in rest and "*/" not in rest:
                comment = True
            if word in ("if", "ifdef", "ifndef"):
                if not rest.strip():
                    raise Bad("condition")
                section = _Section(word == "if" and re.match(r"\s*0\s*(?://.*|/\*.*)?$", rest) is not None)
                (stack[-1][0].inside[-1] if stack else top).append(section)
                stack.append((section, 0))
            elif word in ("elif", "elifdef", "elifndef", "else"):
                if not stack:
                    raise Bad(word)
                section, k = stack[-1]
                section.branch()
                stack[-1] = (section, k + 1)
            elif word == "endif":
                if not stack:
                    raise Bad(word)
                stack.pop()
            elif word in ("include", "import", "include_next"):
                if not _INCLUDE.match(rest):
                    raise Bad("include")
            elif word == "define":
                if not re.match(r"\s+[A-Za-z_]\w*", rest):
                    raise Bad("define")
            elif word == "undef":
                if not re.match(r"\s+[A-Za-z_]\w*\s*(?://.*|/\*.*)?$", rest):
                    raise Bad("undef")
            elif word not in ("", "pragma", "error", "warning", "line", "ident") or word == "" and rest.strip():
                raise Bad(f"directive {word}")
            lines.append(("", ()))
            continue
        comment = _in_comment(line, comment)
        lines.append((line, tuple(stack)))
    if stack:
        raise Bad("open section")
    while True:
        for section in top:
            section.choose()
        yield "\n".join(line if all(s.chosen == k for s, k in held) else "" for line, held in lines)
        if not any(s.pending() for s in top):
            return


_PARTS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*|/\*|\*/")


def _in_comment(line: str, inside: bool) -> bool:
    i = 0
    while True:
        if inside:
            i = line.find("*/", i)
            if i < 0:
                return True
            i, inside = i + 2, False
        m = _PARTS.search(line, i)
        if not m:
            return False
        i = m.end()
        inside = m.group() == "/*"


class CFamily(Parser):
    def __init__(self, tokens, cpp: bool):
        super().__init__(tokens)
        self.cpp = cpp
        self.keywords = _KEYWORDS_CPP if cpp else _KEYWORDS_C

    def ident(self) -> None:
        if self.name() in self.keywords:
            raise Bad("keyword")

    def at_ident(self, k: int = 0) -> bool:
        return self.kind[self.i + k] == "n" and self.value[self.i + k] not in self.keywords

    def attributes(self) -> None:
        while True:
            if self.at(*_ATTRIBUTES):
                self.i += 1
                if self.at_p("("):
                    self.i = self.t.match[self.i] + 1
            elif self.cpp and self.at_p("[") and self.peek(1, "["):
                self.i = self.t.match[self.i] + 1
            else:
                return

    # declarations

    def program(self) -> None:
        while not self.ended():
            self.external()

    def external(self) -> None:
        if self.take(";"):
            return None
        self.attributes()
        if self.at("extern") and self.kind[self.i + 1] == "s":
            self.i += 2
            return self.externals() if self.at_p("{") else self.external()
        if self.cpp:
            if self.at("namespace") or self.at("inline") and self.peek(1, "namespace"):
                self.take("inline")
                self.i += 1
                self.attributes()
                if self.at_ident():
                    self.qualified(False)
                    if self.take("="):
                        self.qualified(False)
                        return self.need(";")
                return self.externals()
            if self.take("template"):
                if self.at_p("<"):
                    self.template_parameters()
                if self.take("requires"):
                    self.binary()
                return self.external()
            if self.take("concept"):
                self.ident()
                self.need("=")
                self.expression()
                return self.need(";")
            if self.at("using"):
                return self.using()
            if self.take("static_assert"):
                self.call()
                return self.need(";")
        return self.declaration(True)

    def externals(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.external()

    def using(self) -> None:
        self.need("using")
        if self.take("namespace", "enum"):
            self.qualified()
        else:
            self.take("typename")
            self.qualified()
            self.attributes()
            if self.take("="):
                self.type_id()
        self.need(";")

    def template_parameters(self) -> None:
        self.need("<")
        while not self.take(">"):
            if self.take("typename", "class"):
                self.take("...")
                if self.at_ident():
                    self.ident()
                if self.take("="):
                    self.type_id()
            elif self.at("template"):
                self.i += 1
                self.template_parameters()
                continue
            else:
                self.specifiers()
                self.take("...")
                self.declarator(True)
                if self.take("="):
                    self.shift()
            if not self.at_p(">"):
                self.need(",")

    def declaration(self, outer: bool) -> None:
        """A declaration or, where ``outer``, a function with its body."""
        defined = self.specifiers(outer)
        if self.take(";"):
            if not defined:
                raise Bad("declares nothing")
            return
        while True:
            function = self.declarator(False)
            if function and outer:
                if self.cpp and self.take("try"):
                    pass
                if self.cpp and self.at_p(":"):
                    self.initializers()
                if self.at_p("{"):
                    self.block()
                    while self.cpp and self.at("catch"):
                        self.catch()
                    return
                if self.cpp and self.at_p("=") and self.peek(1, "default", "delete"):
                    self.i += 2
                    break
            if self.take(":"):
                self.conditional()
            if self.take("="):
                self.initializer()
            elif self.cpp and self.at_p("{"):
                self.braces()
            if not self.take(","):
                break
        self.need(";")

    def initializers(self) -> None:
        self.need(":")
        while True:
            self.qualified()
            self.braces() if self.at_p("{") else self.call()
            self.take("...")
            if not self.take(","):
                return

    def specifiers(self, outer: bool = False) -> bool:
        """Type specifiers; True where a struct, union, class or enum is meant, which needs no declarator."""
        typed = defined = macro = False
        start = self.i
        while self.kind[self.i] == "n" or self.cpp and (self.at_p("[") and self.peek(1, "[") or self.at_p("::")):
            self.attributes()
            v = self.value[self.i]
            if v in _SPECIFIERS:
                self.i += 1
                if v == "explicit" and self.at_p("("):
                    self.call()
            elif v in _BUILTIN:
                if typed == "name":
                    raise Bad("two types")
                self.i += 1
                typed = "builtin"
            elif v in ("struct", "union", "enum") or self.cpp and v == "class":
                if typed:
                    raise Bad("two types")
                self.i += 1
                self.record(v)
                typed, defined = "name", True
            elif self.cpp and v == "decltype":
                self.i += 1
                self.call()
                typed = "name"
            elif self.cpp and v == "typename":
                self.i += 1
                self.qualified()
                typed = "name"
            elif v in ("typeof", "__typeof__"):
                self.i += 1
                self.call()
                typed = "name"
            elif (self.at_ident() or v == "::") and not typed:
                if self.cpp and outer and self._constructor():
                    return defined
                if not macro and _MACRO.match(v) and self.kind[self.i + 1] == "n" and self.value[self.i + 1] not in ("operator",) and not self.peek(2, ";", "=", "[", ",", ")", "("):
                    self.i += 1
                    macro = True
                    continue
                self.qualified()
                typed = "name"
            elif typed and self.at_ident() and _MACRO.match(v) and self.kind[self.i + 1] == "n":
                self.i += 1
            else:
                break
        if not typed and not (self.cpp and (self.at_p("~") or self.at("operator"))):
            if self.i == start or not self.at_ident():
                raise Bad(f"type at {self.i}: {self.value[self.i]!r}")
        return defined

    def _constructor(self) -> bool:
        """A name, maybe qualified, directly before its parameters: it has no type."""
        j = self.i
        while self.kind[j] == "n" and self.value[j + 1] == "::":
            j += 2
            if self.value[j] == "~" or self.value[j] == "operator":
                return True
        if not (self.kind[j] == "n" and self.value[j + 1] == "(" and self.kind[j + 1] == "p"):
            return False
        k = self.t.match[j + 1] + 1
        return self.kind[k] in "pn" and self.value[k] in (":", "{", ";", "noexcept", "=", "try") and not self.value[j + 2] in ("*", "&")

    def record(self, word: str) -> None:
        self.attributes()
        if word == "enum" and self.cpp:
            self.take("class", "struct")
        while self.at_ident() and _MACRO.match(self.value[self.i]) and self.at_ident(1):
            self.i += 1
        named = self.at_ident() or self.cpp and self.at_p("::")
        if named:
            self.qualified()
            self.cpp and self.take("final")
        if word == "enum":
            if self.take(":"):
                self.specifiers()
            if self.take("{"):
                while not self.take("}"):
                    self.ident()
                    self.attributes()
                    if self.take("="):
                        self.conditional()
                    if not self.at_p("}"):
                        self.need(",")
            elif not named:
                raise Bad("enum")
            return
        if self.cpp and self.at_p(":"):
            self.i += 1
            while True:
                self.take("virtual")
                self.take("public", "private", "protected")
                self.take("virtual")
                self.qualified()
                self.take("...")
                if not self.take(","):
                    break
            if not self.at_p("{"):
                raise Bad("bases")
        if self.take("{"):
            while not self.take("}"):
                if self.cpp and self.at("public", "private", "protected"):
                    self.i += 1
                    self.take("slots", "Q_SLOTS")
                    self.need(":")
                elif self.cpp:
                    self.external()
                elif not self.take(";"):
                    self.declaration(False)
        elif not named:
            raise Bad(word)

    def qualified(self, arguments: bool = True) -> None:
        if self.cpp:
            self.take("::")
        self.ident()
        if not self.cpp:
            return
        if arguments and self.at_p("<"):
            self.attempt(self.template_arguments)
        while self.at_p("::") and (self.at_ident(1) or self.peek(1, "template")):
            self.i += 1
            self.take("template")
            self.ident()
            if arguments and self.at_p("<"):
                self.attempt(self.template_arguments)

    def template_arguments(self) -> None:
        self.need("<")
        while not self.take(">"):
            if not self.attempt(self._type_argument):
                self.shift()
            self.take("...")
            if not self.at_p(">"):
                self.need(",")

    def _type_argument(self) -> None:
        self.type_id()
        self.take("...")
        if not self.at(",", ">"):
            raise Bad("no type")

    def type_id(self) -> None:
        self.specifiers()
        self.declarator(True)

    def declarator(self, abstract: bool) -> bool:
        """True for a function. Where ``abstract`` the name may lack."""
        function = False
        while True:
            self.attributes()
            if self.take("*") or self.cpp and self.take("&", "&&"):
                while self.at("const", "volatile", "restrict", "__restrict", "__restrict__", "_Nonnull", "_Nullable"):
                    self.i += 1
            elif self.cpp and self.at_ident() and self.peek(1, "::") and self.peek(2, "*"):
                self.i += 3
            else:
                break
        self.take("...") if self.cpp else None
        while self.at_ident() and _MACRO.match(self.value[self.i]) and self.at_ident(1):
            self.i += 1
        if self.at_p("(") and (self.peek(1, "*", "&", "&&") or self.at_ident(1) and (self.peek(2, "::") and self.peek(3, "*") or not abstract)):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.cpp and self.at_p("[") and self.at_ident(1) and self.peek(2, ",", "]"):
            self.i += 1
            self.ident()
            while self.take(","):
                self.ident()
            self.need("]")
        elif self.at_ident() or self.cpp and (self.at_p("~") or self.at("operator")):
            self.declared_name()
        elif not abstract and not self.at_p(":"):
            raise Bad(f"declarator at {self.i}: {self.value[self.i]!r}")
        while True:
            if self.at_p("["):
                if self.cpp and self.peek(1, "["):
                    self.attributes()
                    continue
                self.i += 1
                self.take("static")
                if not self.take("]"):
                    self.assignment()
                    self.need("]")
            elif self.at_p("("):
                if not self.attempt(self.parameters):
                    if abstract or not self.cpp:
                        raise Bad("parameters")
                    self.call()
                    return False
                function = True
                while self.cpp:
                    if self.take("const", "volatile", "override", "final", "&", "&&", "throw", "mutable"):
                        if self.value[self.i - 1] == "throw":
                            self.call()
                    elif self.take("noexcept"):
                        if self.at_p("("):
                            self.call()
                    elif self.take("->"):
                        self.type_id()
                    elif self.take("requires"):
                        self.binary()
                    else:
                        break
                self.attributes()
            else:
                break
        self.attributes()
        return function

    def declared_name(self) -> None:
        while self.at_ident() and self.peek(1, "::", "<"):
            if self.peek(1, "<"):
                i = self.i
                self.ident()
                if not (self.attempt(self.template_arguments) and self.at("::", "(")):
                    self.i = i
                    break
                if not self.take("::"):
                    return
            else:
                self.i += 2
        if self.take("~"):
            self.ident()
        elif self.take("operator"):
            if self.take("(", "["):
                self.need(")", "]")
            elif self.take("new", "delete"):
                if self.take("["):
                    self.need("]")
            elif self.kind[self.i] == "p":
                while self.kind[self.i] == "p" and not self.at_p("("):
                    self.i += 1
            elif self.kind[self.i] == "s":
                self.i += 1
                self.ident()
            else:
                self.specifiers()
                while self.take("*", "&"):
                    pass
        else:
            self.ident()

    def parameters(self) -> None:
        self.need("(")
        if self.at("void") and self.peek(1, ")"):
            self.i += 2
            return
        while not self.take(")"):
            if not self.take("..."):
                self.specifiers()
                self.declarator(True)
                if self.cpp and self.take("="):
                    self.initializer()
            if not self.at_p(")"):
                self.need(",")
                if self.at_p(")"):
                    raise Bad("comma")

    def initializer(self) -> None:
        if self.at_p("{"):
            self.braces()
        else:
            self.assignment()

    def braces(self) -> None:
        self.need("{")
        while not self.take("}"):
            designated = False
            while self.at(".", "["):
                if self.cpp and self.at_p("["):
                    break
                designated = True
                if self.take("."):
                    self.ident()
                else:
                    self.i += 1
                    self.conditional()
                    self.need("]")
            if designated and not self.take("=") and not self.at_p("{"):
                raise Bad("designator")
            self.initializer()
            self.cpp and self.take("...")
            if not self.at_p("}"):
                self.need(",")

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.i += 1
                return None
            if self.cpp and v == "[" and self.peek(1, "["):
                self.attributes()
                return self.statement()
        elif k == "n":
            if v in _STATEMENT and (v != "catch" and v != "try" or self.cpp):
                self.i += 1
                return getattr(self, f"s_{v}")()
            if self.at_ident() and self.peek(1, ":") and not self.peek(2, ":"):
                self.i += 2
                return None if self.at_p("}") else self.statement()
            if self.cpp and v in ("using", "static_assert", "namespace"):
                return self.external()
            if v in ("struct", "union", "enum", "class", "typedef", "static", "extern") and v in self.keywords:
                return self.declaration(False)
            if self.attempt(lambda: self.declaration(False)):
                return None
        if self.cpp and self.take("co_return"):
            if not self.at_p(";"):
                self.expression()
            return self.need(";")
        self.expression()
        return self.need(";")

    def condition(self) -> None:
        self.need("(")
        if self.cpp and self.attempt(self._declared_condition):
            return
        self.expression()
        self.need(")")

    def _declared_condition(self) -> None:
        self.specifiers()
        self.declarator(False)
        if self.take("="):
            self.initializer()
        elif self.at_p("{"):
            self.braces()
        else:
            raise Bad("no declaration")
        if self.take(";"):
            self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.cpp and self.take("constexpr")
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_else(self) -> None:
        raise Bad("else")

    def s_while(self) -> None:
        self.condition()
        self.statement()

    def s_switch(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        if self.cpp and self.attempt(self._range):
            return self.statement()
        if not self.take(";") and not self.attempt(lambda: self.declaration(False)):
            self.expression()
            self.need(";")
        if not self.at_p(";"):
            self.expression()
        self.need(";")
        if not self.at_p(")"):
            self.expression()
        self.need(")")
        return self.statement()

    def _range(self) -> None:
        self.specifiers()
        self.declarator(False)
        self.need(":")
        self.initializer()
        self.need(")")

    def s_case(self) -> None:
        self.conditional()
        if self.take("..."):
            self.conditional()
        self.need(":")

    def s_default(self) -> None:
        self.need(":")

    def s_return(self) -> None:
        if not self.at_p(";"):
            self.braces() if self.cpp and self.at_p("{") else self.expression()
        self.need(";")

    def s_break(self) -> None:
        self.need(";")

    s_continue = s_break

    def s_goto(self) -> None:
        self.ident()
        self.need(";")

    def s_try(self) -> None:
        self.block()
        if not self.at("catch"):
            raise Bad("try alone")
        while self.at("catch"):
            self.catch()

    def s_catch(self) -> None:
        raise Bad("catch alone")

    def catch(self) -> None:
        self.need("catch")
        self.need("(")
        if not self.take("..."):
            self.type_id()
        self.need(")")
        self.block()

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        if self.cpp and self.take("throw"):
            if not self.at(";", ")", ","):
                self.assignment()
            return
        self.conditional()
        v = self.value[self.i]
        if self.kind[self.i] == "p" and (v in _ASSIGN or v == ">" and self.peek(1, ">=")):
            self.i += 1 + (v == ">")
            self.initializer()

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            if not self.at_p(":"):
                self.expression()
            self.need(":")
            self.assignment()

    def binary(self) -> None:
        self.unary()
        while self.kind[self.i] == "p":
            v = self.value[self.i]
            if v == ">":
                if self.peek(1, ">="):
                    return
                self.i += 1
                self.take(">") or self.take("=")
            elif v in _BINARY or self.cpp and v == "->*":
                self.i += 1
            else:
                return
            self.unary()

    def shift(self) -> None:
        """An expression that ends at a closing angle bracket."""
        self.unary()
        while self.kind[self.i] == "p" and self.value[self.i] in _BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.at("*", "&", "+", "-", "!", "~", "++", "--", "&&") or self.cpp and self.at("co_await", "not"):
            self.i += 1
        if self.take("sizeof", "alignof", "_Alignof", "decltype", "typeid", "noexcept"):
            self.take("...")
            if self.at_p("(") and self.attempt(self._type_in_parens):
                return None
            return self.unary()
        if self.at_p("(") and self._cast():
            return None
        self.primary()
        while True:
            if self.take(".", "->"):
                if self.cpp:
                    self.take("template")
                    if self.take("~"):
                        pass
                    if self.at("operator"):
                        self.declared_name()
                    else:
                        self.qualified_call()
                else:
                    self.ident()
            elif self.at_p("("):
                self.call()
            elif self.at_p("["):
                self.i += 1
                self.expression()
                self.need("]")
            elif self.take("++", "--"):
                pass
            elif self.cpp and self.at_p("{") and self.kind[self.i - 1] in "np" and (self.kind[self.i - 1] == "n" or self.value[self.i - 1] == ">"):
                self.braces()
            elif self.cpp and self.at_p("..."):
                self.i += 1
            else:
                return None

    def _type_in_parens(self) -> None:
        self.need("(")
        self.type_id()
        self.need(")")

    def _cast(self) -> bool:
        j = self.t.match[self.i] + 1
        k, v = self.kind[j], self.value[j]
        if not (k in "sd" or k == "n" and v not in _STATEMENT or k == "p" and v in ("(", "{", "*", "&", "-", "+", "!", "~")):
            return False
        if k == "p" and v in ("*", "&", "-", "+", "(") and not (self.kind[j - 2] == "p" and self.value[j - 2] == "*" or self.kind[j - 2] == "n" and (self.value[j - 2] in _BUILTIN or self.value[j - 2].endswith("_t"))):
            return False
        i = self.i
        if self.attempt(self._type_in_parens):
            if self.at_p("{"):
                self.braces()
                return True
            if self.attempt(self.unary):
                return True
        self.i = i
        return False

    def qualified_call(self) -> None:
        """A name; template arguments count where a call, a brace or a scope follows."""
        self.take("::")
        self.take("template")
        while True:
            self.ident()
            if self.at_p("<"):
                i = self.i
                if not (self.attempt(self.template_arguments) and self.at("(", "{", "::", ")", ",", ";")):
                    self.i = i
            if not self.at_p("::"):
                return
            self.i += 1
            self.take("template")
            if self.take("~"):
                pass
            if self.at("operator"):
                return self.declared_name()

    def primary(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k in "sd":
            while self.kind[self.i] == "s":
                self.i += 1
                while self.at_ident() and _MACRO.match(self.value[self.i]) and self.kind[self.i + 1] == "s":
                    self.i += 1
            if k == "d":
                self.i += 1
            return None
        if k == "p":
            if v == "(":
                if self.peek(1, "{"):
                    self.i += 1
                    self.block()
                else:
                    self.i += 1
                    self.expression()
                return self.need(")")
            if self.cpp and v == "[":
                return self.lambda_()
            if self.cpp and v == "::":
                return self.qualified_call()
        elif k == "n":
            if self.cpp:
                if v in ("this", "nullptr", "true", "false"):
                    self.i += 1
                    return None
                if v in _CASTS:
                    self.i += 1
                    self.need("<")
                    self.type_id()
                    self.need(">")
                    return self.call()
                if v == "new":
                    self.i += 1
                    if self.at_p("("):
                        self.call()
                    self.specifiers()
                    while self.take("*"):
                        pass
                    if self.at_p("["):
                        return None
                    if self.at_p("("):
                        self.call()
                    elif self.at_p("{"):
                        self.braces()
                    return None
                if v == "delete":
                    self.i += 1
                    if self.take("["):
                        self.need("]")
                    return self.unary()
                if v in _BUILTIN or v == "typename":
                    self.specifiers()
                    return self.braces() if self.at_p("{") else self.call()
                if v == "operator":
                    return self.declared_name()
                return self.qualified_call()
            return self.ident()
        raise Bad(f"expression at {self.i}: {v!r}")

    def lambda_(self) -> None:
        self.i = self.t.match[self.i] + 1
        if self.at_p("<"):
            self.template_parameters()
        if self.at_p("("):
            self.parameters()
        while self.take("mutable", "constexpr", "noexcept"):
            pass
        if self.take("->"):
            self.type_id()
        self.block()

    def call(self) -> None:
        self.need("(")
        while not self.take(")"):
            if not self.at_p("{") and not self.cpp and self.at(*_BUILTIN) and self.attempt(self._type_argument_of_macro):
                pass
            else:
                self.initializer()
            self.cpp and self.take("...")
            if not self.at_p(")"):
                self.need(",")
                if self.at_p(")"):
                    raise Bad("comma")

    def _type_argument_of_macro(self) -> None:
        self.type_id()
        if not self.at(",", ")"):
            raise Bad("no type")


def parse(text: str, cpp: bool) -> None:
    """Raises Bad where the text is no translation unit."""
    for variant in variants(text):
        CFamily(curly.lex(variant, curly.C), cpp).program()
