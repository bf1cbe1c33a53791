"""Go: a recursive-descent recognizer with the language's automatic semicolons."""

from __future__ import annotations

from tracewell.llm.grammar import curly
from tracewell.llm.grammar.base import Bad, Parser

_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_ENDS = frozenset("break continue fallthrough return".split())
_BINARY = frozenset("+ - * / % & | ^ << &^ == != < <= && ||".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Go(Parser):
    composite = True

    def semi(self) -> None:
        if self.take(";") or self.at_p(")") or self.at_p("}") or self.ended():
            return
        if self.t.nl[self.i] and self._ends_line():
            return
        raise Bad(f"; at {self.i}: {self.value[self.i]!r}")

    def _ends_line(self) -> bool:
        k, v = self.kind[self.i - 1], self.value[self.i - 1]
        return k in "sd" or k == "n" and (v not in _KEYWORDS or v in _ENDS) or k == "p" and v in (")", "]", "}", "++", "--")

    def broken(self) -> bool:
        """Whether a semicolon was put before the current token."""
        return self.t.nl[self.i] and self._ends_line()

    def ident(self) -> None:
        if self.name() in _KEYWORDS:
            raise Bad("keyword")

    def program(self) -> None:
        self.need("package")
        self.ident()
        self.semi()
        while self.at("import"):
            self.i += 1
            self.group(self.import_spec)
            self.semi()
        while not self.ended():
            if self.take("func"):
                if self.at_p("("):
                    self.params()
                self.ident()
                self.signature()
                if self.at_p("{"):
                    self.block()
            elif self.at("var", "const", "type"):
                self.declaration()
            else:
                raise Bad(f"top level {self.value[self.i]!r}")
            self.semi()

    def group(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                self.semi()
        else:
            rule()

    def import_spec(self) -> None:
        if self.kind[self.i] == "n" or self.at_p("."):
            self.i += 1
        if self.kind[self.i] != "s":
            raise Bad("import")
        self.i += 1

    def declaration(self) -> None:
        word = self.name()
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[word])

    def var_spec(self) -> None:
        self.names()
        typed = not self.at_p("=")
        if typed:
            self.type_()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not (self.at_p("=") or self.at_p(";") or self.at_p(")") or self.broken()):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.ident()
        if self.at_p("[") and self.kind[self.i + 1] == "n" and not self.peek(2, "]"):
            self.type_params()
        self.take("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.at_p("]"):
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def names(self) -> None:
        self.ident()
        while self.take(","):
            self.ident()

    def signature(self) -> None:
        if self.at_p("["):
            self.type_params()
        self.params()
        if self.at_p("("):
            self.params()
        elif not (self.at_p("{") or self.broken() or self.ended() or self.at(",", ")", ";", "}", "]", ":", "=", ":=") or self.kind[self.i] == "s"):
            self.type_()

    def params(self) -> None:
        """Either all are types or all have names; a name followed by a type is one of either."""
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.type_()
            if not (self.at_p(",") or self.at_p(")")):
                self.take("...")
                self.type_()
            if not self.at_p(")"):
                self.need(",")

    def type_(self) -> None:
        if self.take("*"):
            return self.type_()
        if self.take("("):
            self.type_()
            return self.need(")")
        if self.take("["):
            if not self.take("]"):
                if not self.take("..."):
                    self.expression()
                self.need("]")
            return self.type_()
        if self.take("map"):
            self.need("[")
            self.type_()
            self.need("]")
            return self.type_()
        if self.take("chan"):
            self.take("<-")
            return self.type_()
        if self.take("<-"):
            self.need("chan")
            return self.type_()
        if self.take("func"):
            return self.signature()
        if self.take("struct"):
            self.need("{")
            while not self.take("}"):
                if self.take("*") or self.peek(1, ".") or self.kind[self.i + 1] == "s" or self.peek(1, ";", "}") or self.t.nl[self.i + 1]:
                    self.type_()
                else:
                    self.names()
                    self.type_()
                if self.kind[self.i] == "s":
                    self.i += 1
                self.semi()
            return None
        if self.take("interface"):
            self.need("{")
            while not self.take("}"):
                if self.kind[self.i] == "n" and self.peek(1, "("):
                    self.ident()
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            return None
        self.ident()
        if self.take("."):
            self.ident()
        if self.at_p("[") and not self.peek(1, "]") and not self.broken():
            self.attempt(self.type_args)
        return None

    def type_args(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.type_()
            if not self.at_p("]"):
                self.need(",")

    def block(self) -> None:
        self.need("{")
        keep, self.composite = self.composite, True
        while not self.take("}"):
            self.statement()
            self.semi()
        self.composite = keep

    def statement(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k == "p" and v in ("{", ";", "}"):
            return self.block() if v == "{" else None
        if k == "n" and v in _KEYWORDS:
            if v in ("var", "const", "type"):
                return self.declaration()
            if v == "return":
                self.i += 1
                if not (self.at_p("}") or self.at_p(";") or self.broken()):
                    self.expressions()
                return None
            if v in ("break", "continue", "goto"):
                self.i += 1
                if self.kind[self.i] == "n" and not self.broken():
                    self.ident()
                return None
            if v == "fallthrough":
                self.i += 1
                return None
            if v in ("go", "defer"):
                self.i += 1
                return self.expression()
            if v == "if":
                return self.if_()
            if v == "for":
                return self.for_()
            if v in ("switch", "select"):
                return self.switch(v)
            if v not in ("func", "struct", "map", "chan", "interface"):
                raise Bad(f"statement {v}")
        if k == "n" and self.peek(1, ":"):
            self.i += 2
            return self.statement()
        return self.simple()

    def simple(self) -> None:
        self.expressions()
        if self.kind[self.i] == "p":
            v = self.value[self.i]
            if v in _ASSIGN or v == ":=" or v == ">" and self.peek(1, ">="):
                self.i += 1 + (v == ">")
                if self.take("range"):
                    self.expression()
                else:
                    self.expressions()
            elif v in ("++", "--"):
                self.i += 1
            elif v == "<-":
                self.i += 1
                self.expression()

    def header(self) -> None:
        """What stands between a keyword and its block."""
        keep, self.composite = self.composite, False
        while not self.at_p("{"):
            if not self.take(";"):
                if self.take("range"):
                    self.expression()
                else:
                    self.simple()
                if not self.at_p("{"):
                    self.need(";")
        self.composite = keep

    def if_(self) -> None:
        self.i += 1
        if self.at_p("{"):
            raise Bad("condition")
        self.header()
        self.block()
        if self.take("else"):
            self.if_() if self.at("if") else self.block()

    def for_(self) -> None:
        self.i += 1
        self.header()
        self.block()

    def switch(self, word: str) -> None:
        self.i += 1
        self.header()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                if word == "select":
                    self.simple()
                else:
                    while True:
                        self.type_or_expression()
                        if not self.take(","):
                            break
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()
                self.semi()

    def type_or_expression(self) -> None:
        if self.at("[", "map", "chan", "struct", "interface") or self.at("func") or self.at_p("*"):
            if self.attempt(self._lone_type):
                return
        self.expression()

    def _lone_type(self) -> None:
        self.type_()
        if not self.at(",", ":", ")"):
            raise Bad("no type")

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.kind[self.i] == "p":
            v = self.value[self.i]
            if v == ">":
                if self.peek(1, ">="):
                    return
                self.i += 1
                self.take(">") or self.take("=")
            elif v in _BINARY:
                self.i += 1
            else:
                return
            self.unary()

    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
        k, v = self.kind[self.i], self.value[self.i]
        if k in "sd":
            self.i += 1
        elif k == "p" and v == "(":
            self.i += 1
            keep, self.composite = self.composite, True
            self.type_or_expression()
            self.composite = keep
            self.need(")")
        elif k == "p" and v == "[" or k == "n" and v in ("map", "chan", "struct", "interface"):
            self.type_()
            if self.at_p("{"):
                self.literal()
        elif k == "n" and v == "func":
            self.i += 1
            self.signature()
            if self.at_p("{"):
                keep, self.composite = self.composite, True
                self.block()
                self.composite = keep
        elif k == "n" and v not in _KEYWORDS:
            self.i += 1
        else:
            raise Bad(f"expression at {self.i}: {v!r}")
        while self.kind[self.i] == "p" and not self.broken():
            v = self.value[self.i]
            if v == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                else:
                    self.ident()
            elif v == "(":
                self.call()
            elif v == "[":
                self.index()
            elif v == "{" and self.composite and self.kind[self.i - 1] in "np" and self.value[self.i - 1] not in (")",):
                self.literal()
            else:
                return

    def call(self) -> None:
        self.need("(")
        keep, self.composite = self.composite, True
        while not self.take(")"):
            self.type_or_expression()
            self.take("...")
            if not self.at_p(")"):
                self.need(",")
        self.composite = keep

    def index(self) -> None:
        self.need("[")
        keep, self.composite = self.composite, True
        while not self.take("]"):
            if not self.take(":"):
                self.type_or_expression()
                self.take(",")
        self.composite = keep

    def literal(self) -> None:
        self.need("{")
        keep, self.composite = self.composite, True
        while not self.take("}"):
            for _ in range(2):
                self.literal() if self.at_p("{") else self.expression()
                if not self.take(":"):
                    break
            if self.at_p("}") and self.t.nl[self.i]:
                raise Bad("comma")
            if not self.at_p("}"):
                self.need(",")
        self.composite = keep


def parse(text: str) -> None:
    """Raises Bad where the text is no Go file."""
    Go(curly.lex(text, curly.GO)).program()
