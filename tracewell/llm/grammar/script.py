"""JavaScript and TypeScript, with JSX: a recursive-descent recognizer."""

from __future__ import annotations

import re

from tracewell.llm.grammar.base import Bad, Parser, Tokens

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/|<!--[^\n]*)*", re.S)
_NAME = re.compile(r"#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUM = re.compile(r"(?:0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])")
_STR = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\*\*|\+\+|--|==|!=|<=|<<|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
#: White space and comments, then a token that needs no look at what stands before it.
_NEXT = re.compile(rf"(?P<w>{_SKIP.pattern})(?:(?P<n>{_NAME.pattern})|(?P<d>(?=\.?\d){_NUM.pattern})|(?P<s>{_STR.pattern})|(?P<p>{_PUNCT.pattern.replace('|/=|', '|').replace('<<=|', '').replace('<=|<<|', '').replace('<>', '>').replace('*/%', '*%')}))?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())
_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** == != === !== < <= << && || ?? & | ^ instanceof in".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())


class _Lexer:
    def __init__(self, text: str, jsx: bool):
        self.s, self.jsx = text, jsx

    def run(self, i: int, inner: bool) -> tuple[Tokens, int]:
        """Tokens from i to the end, or with ``inner`` to the brace that closes an embedded expression."""
        s, n, kind, value, nl, depth = self.s, len(self.s), [], [], [], 0
        while True:
            m = _NEXT.match(s, i)
            i, k = m.end("w"), m.lastgroup
            w = m.group("w")
            line = not kind or "\n" in w or "\r" in w
            if k != "w":
                if k == "n":
                    v = m.group(k)
                elif k == "p":
                    v = m.group(k)
                    if v == "{":
                        depth += 1
                    elif v == "}":
                        if inner and depth == 0:
                            return Tokens(kind, value, nl), i + 1
                        depth -= 1
                else:
                    v = ""
                i = m.end()
                kind.append(k)
                value.append(v)
                nl.append(line)
                continue
            if i >= n:
                if inner:
                    raise Bad("open expression")
                return Tokens(kind, value, nl), i
            c = s[i]
            operand = not kind or (
                kind[-1] == "p" and value[-1] not in (")", "]", "}", "++", "--") or kind[-1] == "n" and value[-1] in _BEFORE_OPERAND and not (len(value) > 1 and value[-2] in (".", "?."))
            )
            if c == "/" and (operand or kind[-1] == "p" and value[-1] == "}" and line):
                m = _REGEX.match(s, i)
                if not m:
                    raise Bad("regex")
                k, v, i = "r", "", m.end()
            elif c == "`":
                v, i = self.template(i + 1)
                k = "t"
            elif c == "<" and self.jsx and operand and self._is_jsx(i):
                v, i = self.element(i)
                k = "j"
            elif c in "/<":
                m = _PUNCT.match(s, i)
                k, v, i = "p", m.group(), m.end()
            elif i == 0 and s.startswith("#!"):
                i = s.find("\n") if "\n" in s else n
                continue
            else:
                raise Bad(f"character {c!r}")
            kind.append(k)
            value.append(v)
            nl.append(line)

    def template(self, i: int) -> tuple[list, int]:
        s, n, parts = self.s, len(self.s), []
        while i < n:
            c = s[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return parts, i + 1
            elif c == "$" and s.startswith("${", i):
                t, i = self.run(i + 2, True)
                parts.append(t)
            else:
                i += 1
        raise Bad("open template")

    def _is_jsx(self, i: int) -> bool:
        m = re.compile(r"<\s*(?:>|[A-Za-z_$][\w$.:-]*(\s*[,=]|\s+extends\b)?)").match(self.s, i)
        return bool(m) and not m.group(1)

    def element(self, i: int) -> tuple[list, int]:
        """A JSX element with its embedded expressions."""
        s, parts = self.s, []
        ws = lambda j: _SKIP.match(s, j).end()
        i = ws(i + 1)
        m = _JSX_NAME.match(s, i)
        tag = m.group() if m else ""
        i = ws(m.end() if m else i)
        while not s.startswith((">", "/>"), i):
            if not tag:
                raise Bad("tag")
            if s.startswith("{", i):
                t, i = self.run(i + 1, True)
                parts.append(t)
            else:
                m = _JSX_NAME.match(s, i)
                if not m:
                    raise Bad("attribute")
                i = ws(m.end())
                if s.startswith("=", i):
                    i = ws(i + 1)
                    if s.startswith("{", i):
                        t, i = self.run(i + 1, True)
                        parts.append(t)
                    elif m := re.compile(r"\"[^\"]*\"|'[^']*'").match(s, i):
                        i = m.end()
                    elif s.startswith("<", i):
                        inner, i = self.element(i)
                        parts += inner
                    else:
                        raise Bad("attribute value")
            i = ws(i)
            if i >= len(s):
                raise Bad("open tag")
        if s.startswith("/>", i):
            return parts, i + 2
        i += 1
        while True:
            m = re.compile(r"[^<{}>]*").match(s, i)
            i = m.end()
            if i >= len(s) or s[i] in "}>":
                raise Bad("element")
            if s[i] == "{":
                t, i = self.run(i + 1, True)
                parts.append(t)
            elif m := re.compile(r"</\s*([\w$.:-]*)\s*>").match(s, i):
                if m.group(1) != tag:
                    raise Bad("closing tag")
                return parts, m.end()
            else:
                inner, i = self.element(i)
                parts += inner


class Script(Parser):
    def __init__(self, tokens: Tokens, ts: bool):
        super().__init__(tokens)
        self.ts = ts
        self.no_in = False

    # statements

    def program(self) -> None:
        while not self.ended():
            self.statement()

    def semi(self) -> None:
        if not self.take(";") and not self.at_p("}") and not self.ended() and not self.t.nl[self.i]:
            raise Bad(f"; at {self.i}: {self.value[self.i]!r}")

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
            if v == "@":
                self.decorators()
                self.take("export") and self.take("default")
                self.take("abstract")
                return self.class_()
        if k == "n":
            rule = getattr(self, f"s_{v}", None) if v in _STATEMENTS else None
            if rule and not (v in _SOFT and not self._soft(v)):
                return rule()
            if self.peek(1, ":") and v not in _RESERVED:
                self.i += 2
                return self.statement()
        self.expressions()
        return self.semi()

    def _soft(self, v: str) -> bool:
        """Whether a word that is no keyword everywhere begins a statement here."""
        nk, nv = self.kind[self.i + 1], self.value[self.i + 1]
        same_line = not self.t.nl[self.i + 1]
        if v == "async":
            return nk == "n" and nv == "function" and same_line
        if v == "import":
            return not (nk == "p" and nv in ("(", "."))
        if v == "let":
            return nk == "n" or nk == "p" and nv in ("[", "{")
        if not self.ts or not same_line:
            return False
        if v in ("interface", "type", "namespace", "enum", "abstract", "declare"):
            return nk == "n" and nv not in ("in", "instanceof", "of")
        return v == "module" and nk in ("n", "s") or v == "global" and nv == "{"

    def s_var(self) -> None:
        self.declarations()
        self.semi()

    s_let = s_var

    def s_const(self) -> None:
        if self.ts and self.peek(1, "enum"):
            self.i += 1
            return self.s_enum()
        return self.s_var()

    def declarations(self, in_for: bool = False) -> None:
        kind = self.name()
        while True:
            simple = self.kind[self.i] == "n"
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assignment()
            elif not in_for and (kind == "const" and not self.ambient or not simple):
                raise Bad("no initializer")
            if not self.take(","):
                return

    ambient = False

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.at_p("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    plain = self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        raise Bad("binding")
                    if self.take("="):
                        self.assignment()
                if not self.at_p("}"):
                    self.need(",")
        elif self.name() in _RESERVED:
            raise Bad("reserved")

    def s_function(self) -> None:
        self.i += 1
        self.take("*")
        if not self.at_p("(") and not self.at_p("<"):
            if self.name() in _RESERVED:
                raise Bad("reserved")
        self.function_rest(body=not self.ts)

    def s_async(self) -> None:
        self.i += 1
        self.s_function()

    def function_rest(self, body: bool = True) -> None:
        """From the parameters on; without ``body`` a declaration may end instead."""
        self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()
        if not body and not self.at_p("{"):
            return self.semi()
        keep, self.no_in = self.no_in, False
        self.block()
        self.no_in = keep
        return None

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.decorators()
            if self.ts:
                while self.at("public", "private", "protected", "readonly", "override") and self.kind[self.i + 1] == "n":
                    self.i += 1
            self.take("...")
            if self.ts and self.at("this"):
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assignment()
            if not self.at_p(")"):
                self.need(",")

    def decorators(self) -> None:
        while self.take("@"):
            if self.at_p("("):
                self.primary()
            else:
                self.name()
                while self.take("."):
                    self.name()
                if self.at_p("("):
                    self.arguments()

    def s_class(self) -> None:
        self.class_()

    def s_abstract(self) -> None:
        self.i += 1
        self.class_()

    def class_(self) -> None:
        self.need("class")
        if self.kind[self.i] == "n" and not self.at("extends", "implements"):
            if self.name() in _RESERVED:
                raise Bad("reserved")
        self.type_parameters()
        if self.take("extends"):
            self.unary_postfix(call=True)
            self.type_arguments()
        if self.ts and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.at("static") and self.peek(1, "{"):
            self.i += 1
            return self.block()
        ends = ("(", "=", ";", ":", "?", "}", "!", "<", ",")
        while self.kind[self.i] == "n" and not self.peek(1, *ends) and (
            self.at("static", "async", "accessor") or self.ts and self.value[self.i] in _MODIFIERS
        ) and not (self.t.nl[self.i + 1] and self.at("async")):
            self.i += 1
        self.take("*")
        if self.at("get", "set") and not self.peek(1, *ends):
            self.i += 1
        if self.ts and self.at_p("[") and self.kind[self.i + 1] == "n" and self.peek(2, ":"):
            self.i += 3
            self.type_()
            self.need("]")
            self.need(":")
            self.type_()
            return self.semi()
        self.property_name()
        if self.ts:
            self.take("?", "!")
        if self.at_p("(") or self.at_p("<"):
            return self.function_rest(body=not self.ts)
        if self.ts and self.take(":"):
            self.type_()
        if self.take("="):
            self.assignment()
        return self.semi()

    def property_name(self) -> bool:
        """True for a plain name, which may stand for itself."""
        k = self.kind[self.i]
        if k == "n":
            self.i += 1
            return True
        if k in "ds":
            self.i += 1
            return False
        if self.take("["):
            self.assignment()
            self.need("]")
            return False
        raise Bad(f"property at {self.i}: {self.value[self.i]!r}")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expressions()
        self.need(")")

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def s_with(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.at_p(";"):
            keep, self.no_in = self.no_in, True
            if self.at("var", "const") or self.at("let") and self._soft("let"):
                self.declarations(in_for=True)
            else:
                self.expressions()
            self.no_in = keep
        if self.take("of"):
            self.assignment()
        elif self.take("in"):
            self.expressions()
        else:
            self.need(";")
            if not self.at_p(";"):
                self.expressions()
            self.need(";")
            if not self.at_p(")"):
                self.expressions()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.i += 1
        if not (self.at_p(";") or self.at_p("}") or self.ended() or self.t.nl[self.i]):
            self.expressions()
        self.semi()

    def s_throw(self) -> None:
        self.i += 1
        self.expressions()
        self.semi()

    def s_break(self) -> None:
        self.i += 1
        if self.kind[self.i] == "n" and not self.t.nl[self.i]:
            self.i += 1
        self.semi()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            raise Bad("try alone")

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expressions()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def s_import(self) -> None:
        self.i += 1
        if self.kind[self.i] == "s":
            self.i += 1
        else:
            if self.ts and self.at("type") and (self.kind[self.i + 1] == "n" and not (self.peek(1, "from") and self.kind[self.i + 2] == "s") or self.peek(1, "{", "*")):
                self.i += 1
            if self.kind[self.i] == "n":
                self.name()
                if self.ts and self.take("="):
                    self.expressions()
                    return self.semi()
                if not self.at("from"):
                    self.need(",")
            if self.take("*"):
                self.need("as")
                self.name()
            elif self.at_p("{"):
                self.specifiers()
            self.need("from")
            if self.kind[self.i] != "s":
                raise Bad("module")
            self.i += 1
        if self.at("with", "assert") and self.peek(1, "{"):
            self.i += 1
            self.object_()
        return self.semi()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.ts and self.at("type") and self.kind[self.i + 1] in "ns" and not self.peek(1, "as"):
                self.i += 1
            if self.kind[self.i] not in "ns":
                raise Bad("specifier")
            self.i += 1
            if self.take("as"):
                if self.kind[self.i] not in "ns":
                    raise Bad("specifier")
                self.i += 1
            if not self.at_p("}"):
                self.need(",")

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function") or self.at("async") and self.peek(1, "function"):
                self.take("async")
                return self.s_function()
            if self.at("class", "abstract") or self.ts and self.at("interface"):
                return self.s_interface() if self.at("interface") else (self.take("abstract"), self.class_())[1]
            if self.at_p("@"):
                self.decorators()
                return self.class_()
            self.assignment()
            return self.semi()
        if self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.i += 1
            return self.semi()
        if self.ts and self.take("="):
            self.expressions()
            return self.semi()
        if self.ts and self.at("type") and self.peek(1, "{", "*"):
            self.i += 1
        if self.at_p("{"):
            self.specifiers()
            if self.take("from"):
                if self.kind[self.i] != "s":
                    raise Bad("module")
                self.i += 1
            return self.semi()
        words = ("var", "let", "const", "function", "class", "async", "interface", "type", "enum", "abstract", "declare", "namespace", "module", "import")
        if self.at_p("@") or self.at(*words):
            return self.statement()
        raise Bad("export")

    def s_interface(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        self.object_type()

    def s_type(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("=")
        self.type_()
        self.semi()

    def s_enum(self) -> None:
        self.i += 1
        self.name()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assignment()
            if not self.at_p("}"):
                self.need(",")

    def s_declare(self) -> None:
        self.i += 1
        keep, self.ambient = self.ambient, True
        self.statement()
        self.ambient = keep

    def s_namespace(self) -> None:
        self.i += 1
        if self.kind[self.i] == "s":
            self.i += 1
        elif not self.at_p("{"):
            self.name()
            while self.take("."):
                self.name()
        if self.at_p("{"):
            self.block()
        else:
            self.semi()

    s_module = s_namespace

    def s_global(self) -> None:
        self.i += 1
        self.block()

    # expressions

    def expressions(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        if self.kind[self.i] == "n":
            v = self.value[self.i]
            if v == "yield" and not self.peek(1, "=", ".", "(", ")", ",", ";"):
                self.i += 1
                self.take("*")
                if not (self.t.nl[self.i] or self.at(")", "]", "}", ",", ";", ":")):
                    self.assignment()
                return
            if v == "async" and not self.t.nl[self.i + 1] and (self.peek(1, "(", "<") or self.kind[self.i + 1] == "n" and self.peek(2, "=>")):
                i = self.i
                self.i += 1
                if self.arrow():
                    return
                self.i = i
        if self.arrow():
            return
        simple = self.conditional()
        if self.kind[self.i] == "p":
            v = self.value[self.i]
            if v in _ASSIGN or v == ">" and self._shift_assign():
                if not simple:
                    raise Bad("assignment to an expression")
                if v in _ASSIGN:
                    self.i += 1
                self.assignment()

    def _shift_assign(self) -> bool:
        j = self.i
        while self.value[j] == ">" and self.kind[j] == "p":
            j += 1
        if j - self.i >= 2 and self.value[j] == "=" and self.kind[j] == "p":
            self.i = j + 1
            return True
        return False

    def arrow(self) -> bool:
        """Reads an arrow function if there is one here."""
        if self.kind[self.i] == "n":
            if self.peek(1, "=>") and self.value[self.i] not in _RESERVED:
                self.i += 2
                self.arrow_body()
                return True
            return False
        if self.at_p("("):
            j = self.t.match[self.i] + 1
            after = self.value[j] if self.kind[j] == "p" else ""
            if after == "=>":
                self.parameters()
                self.i += 1
                self.arrow_body()
                return True
            return self.ts and after == ":" and self.attempt(self._typed_arrow)
        return self.ts and self.at_p("<") and self.attempt(self._typed_arrow)

    def _typed_arrow(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.take(":"):
            self.return_type()
        self.need("=>")
        self.arrow_body()

    def arrow_body(self) -> None:
        if self.at_p("{"):
            keep, self.no_in = self.no_in, False
            self.block()
            self.no_in = keep
        else:
            self.assignment()

    def conditional(self) -> bool:
        simple = self.binary()
        if self.at_p("?"):
            self.i += 1
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need(":")
            self.assignment()
            return False
        return simple

    def binary(self) -> bool:
        simple = self.unary()
        while True:
            k, v = self.kind[self.i], self.value[self.i]
            if k not in "pn":
                return simple
            if v == ">" and k == "p":
                j = self.i + 1
                while self.value[j] == ">" and self.kind[j] == "p":
                    j += 1
                if self.value[j] == "=" and self.kind[j] == "p":
                    if j - self.i >= 2:
                        return simple
                    j += 1
                self.i = j
            elif v in _BINARY and (k == "p" or v in ("instanceof", "in")):
                if v == "in" and self.no_in:
                    return simple
                self.i += 1
            elif self.ts and k == "n" and v in ("as", "satisfies") and not self.t.nl[self.i]:
                self.i += 1
                if not self.take("const"):
                    self.type_()
                simple = True
                continue
            else:
                return simple
            self.unary()
            simple = False

    def unary(self) -> bool:
        k, v = self.kind[self.i], self.value[self.i]
        if k == "p" and v in ("!", "~", "+", "-", "++", "--") or k == "n" and v in ("typeof", "void", "delete") or k == "n" and v == "await" and not self.peek(1, ")", ",", ";", "=", ".", "]", "=>"):
            self.i += 1
            self.unary()
            return False
        if self.ts and k == "p" and v == "<":
            self.i += 1
            self.type_()
            self.need(">")
            self.unary()
            return False
        return self.unary_postfix()

    def unary_postfix(self, call: bool = True) -> bool:
        simple = self.primary()
        while True:
            k, v = self.kind[self.i], self.value[self.i]
            if k == "t":
                self.templated(self.value[self.i])
                self.i += 1
                simple = False
                continue
            if k != "p":
                return simple
            if v == "." or v == "?.":
                self.i += 1
                simple = v == "."
                if v == "?." and self.at_p("("):
                    self.arguments()
                elif v == "?." and self.take("["):
                    self.expressions()
                    self.need("]")
                else:
                    self.name()
            elif v == "[":
                self.i += 1
                keep, self.no_in = self.no_in, False
                self.expressions()
                self.no_in = keep
                self.need("]")
                simple = True
            elif v == "(":
                self.arguments()
                simple = False
            elif v in ("++", "--") and not self.t.nl[self.i]:
                if not simple:
                    raise Bad("increment of an expression")
                self.i += 1
                return False
            elif self.ts and v == "!" and not self.t.nl[self.i]:
                self.i += 1
                simple = True
            elif self.ts and v == "<" and self.attempt(self._call_arguments):
                simple = False
            else:
                return simple

    def _call_arguments(self) -> None:
        self.type_arguments()
        if self.kind[self.i] == "t":
            return
        if not self.at_p("("):
            raise Bad("no call")
        self.arguments()

    def arguments(self) -> None:
        self.need("(")
        keep, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.at_p(")"):
                self.need(",")
        self.no_in = keep

    def templated(self, parts: list[Tokens]) -> None:
        for t in parts:
            inner = Script(t, self.ts)
            inner.expressions()
            if not inner.ended():
                raise Bad("template")

    def primary(self) -> bool:
        k, v = self.kind[self.i], self.value[self.i]
        if k == "n":
            if v == "function":
                self.i += 1
                self.take("*")
                if self.kind[self.i] == "n":
                    self.i += 1
                self.function_rest()
                return False
            if v == "async" and self.peek(1, "function"):
                self.i += 1
                return self.primary()
            if v == "class":
                self.class_()
                return False
            if v == "new":
                self.i += 1
                if self.take("."):
                    self.need("target")
                    return False
                self.new_target()
                if self.at_p("("):
                    self.arguments()
                return False
            if v == "import":
                self.i += 1
                if self.take("."):
                    self.name()
                else:
                    self.arguments()
                return False
            if v in _RESERVED and v not in ("this", "super", "null", "true", "false"):
                raise Bad(f"reserved {v}")
            self.i += 1
            return v not in ("this", "super", "null", "true", "false")
        if k in "dsr":
            self.i += 1
            return False
        if k == "t":
            self.templated(v)
            self.i += 1
            return False
        if k == "j":
            for t in v:
                inner = Script(t, self.ts)
                if not inner.ended():
                    inner.take("...")
                    inner.expressions()
                    if not inner.ended():
                        raise Bad("jsx")
            self.i += 1
            return False
        if k == "p":
            keep, self.no_in = self.no_in, False
            if v == "(":
                self.i += 1
                self.expressions()
                self.need(")")
                self.no_in = keep
                return True
            if v == "[":
                self.i += 1
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment()
                    if not self.at_p("]"):
                        self.need(",")
                self.no_in = keep
                return True
            if v == "{":
                self.object_()
                self.no_in = keep
                return True
            if v == "@":
                self.decorators()
                self.class_()
                return False
        raise Bad(f"expression at {self.i}: {v!r}")

    def new_target(self) -> None:
        if self.at("new"):
            self.primary()
        elif self.at("class"):
            self.class_()
        else:
            self.primary()
        while True:
            if self.take("."):
                self.name()
            elif self.take("["):
                self.expressions()
                self.need("]")
            else:
                break
        if self.ts and self.at_p("<"):
            self.attempt(self.type_arguments)

    def object_(self) -> None:
        self.need("{")
        ends = (",", ":", "(", "}", "=", "<")
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                while self.at("async", "get", "set") and not self.peek(1, *ends):
                    self.i += 1
                star = self.take("*")
                plain = self.property_name()
                if self.at_p("(") or self.at_p("<"):
                    self.function_rest()
                elif star:
                    raise Bad("generator")
                elif self.take(":"):
                    self.assignment()
                elif not plain:
                    raise Bad("property")
                elif self.take("="):
                    self.assignment()
            if not self.at_p("}"):
                self.need(",")

    # types

    def type_parameters(self) -> None:
        if not self.ts or not self.take("<"):
            return
        while not self.take(">"):
            while self.at("const", "in", "out") and self.kind[self.i + 1] == "n":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if not self.at_p(">"):
                self.need(",")

    def type_arguments(self) -> None:
        if not self.ts or not self.take("<"):
            return
        while True:
            self.type_()
            if self.take(">"):
                return
            self.need(",")

    def return_type(self) -> None:
        if self.at("asserts") and self.kind[self.i + 1] == "n" and not self.t.nl[self.i + 1]:
            self.i += 2
            if self.take("is"):
                self.type_()
            return
        if self.kind[self.i] == "n" and self.peek(1, "is") and not self.t.nl[self.i + 1]:
            self.i += 2
        self.type_()

    def type_(self) -> None:
        if self.take("new") or self.at("abstract") and self.peek(1, "new"):
            self.take("abstract")
            self.take("new")
            return self.function_type()
        if self.at_p("<") or self.at_p("(") and self._function_type_ahead():
            return self.function_type()
        self.union()
        if self.at("extends") and not self.t.nl[self.i] and not self._no_conditional:
            self.i += 1
            keep, self._no_conditional = self._no_conditional, True
            self.union()
            self._no_conditional = keep
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()
        return None

    _no_conditional = False

    def _function_type_ahead(self) -> bool:
        j = self.t.match[self.i] + 1
        return self.kind[j] == "p" and self.value[j] == "=>"

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        self.take("|", "&")
        self.postfix_type()
        while self.take("|", "&"):
            if self.at_p("(") and self._function_type_ahead():
                self.function_type()
            else:
                self.postfix_type()

    def postfix_type(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.kind[self.i + 1] in "nst" or self.peek(1, "(", "[", "{")) and not self.t.nl[self.i + 1]:
            self.i += 1
        self.basic_type()
        while self.at_p("[") and not self.t.nl[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type_()
                self.need("]")

    def basic_type(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k in "sd":
            self.i += 1
        elif k == "t":
            for t in v:
                inner = Script(t, True)
                inner.type_()
                if not inner.ended():
                    raise Bad("template type")
            self.i += 1
        elif k == "p" and v == "-" and self.kind[self.i + 1] == "d":
            self.i += 2
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):
            while not self.take("]"):
                self.take("...")
                if self.kind[self.i] == "n" and (self.peek(1, ":") or self.peek(1, "?") and self.peek(2, ":")):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type_()
                self.take("?")
                if not self.at_p("]"):
                    self.need(",")
        elif self.at_p("{"):
            self.object_type()
        elif k == "n":
            if v == "typeof":
                self.i += 1
                self.name()
                while self.take("."):
                    self.name()
            elif v == "import" and self.peek(1, "("):
                self.i += 1
                self.arguments()
                while self.take("."):
                    self.name()
            elif v in _RESERVED and v not in ("this", "null", "void", "true", "false"):
                raise Bad("type")
            else:
                self.name()
                while self.take("."):
                    self.name()
            if self.at_p("<") and not self.t.nl[self.i]:
                self.type_arguments()
        else:
            raise Bad(f"type at {self.i}: {v!r}")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.type_member()
            if not self.take(";", ",") and not self.at_p("}") and not self.t.nl[self.i]:
                raise Bad("member")

    def type_member(self) -> None:
        ends = ("?", ":", "(", "<", ";", ",", "}")
        self.take("-", "+")
        while self.at("readonly", "get", "set") and not self.peek(1, *ends):
            self.i += 1
        if self.take("new"):
            pass
        elif self.at_p("["):
            if self.kind[self.i + 1] == "n" and self.peek(2, ":"):
                self.i += 3
                self.type_()
            elif self.kind[self.i + 1] == "n" and self.peek(2, "in"):
                self.i += 3
                self.type_()
                if self.take("as"):
                    self.type_()
            else:
                self.i += 1
                self.assignment()
            self.need("]")
        elif not (self.at_p("(") or self.at_p("<")):
            self.property_name()
        self.take("-", "+")
        self.take("?")
        if self.at_p("(") or self.at_p("<"):
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
        elif self.take(":"):
            self.type_()


_STATEMENTS = frozenset(m[2:] for m in dir(Script) if m.startswith("s_"))
_SOFT = frozenset("async import let interface type namespace module enum abstract declare global".split())


def parse(text: str, ts: bool, jsx: bool) -> None:
    """Raises Bad where the text is no program."""
    tokens, _ = _Lexer(text, jsx).run(0, False)
    Script(tokens, ts).program()
