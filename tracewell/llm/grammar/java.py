"""Java: a recursive-descent recognizer."""

from __future__ import annotations

from tracewell.llm.grammar import curly
from tracewell.llm.grammar.base import Bad, Parser

_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_PRIMITIVE = frozenset("boolean byte short int long char float double void".split())
_KEYWORDS = _PRIMITIVE | frozenset(
    "abstract assert break case catch class const continue do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while true false null".split()
)
_BINARY = frozenset("+ - * / % & | ^ << == != < <= && || instanceof".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Java(Parser):
    def ident(self) -> None:
        if self.name() in _KEYWORDS:
            raise Bad("keyword")

    def qualified(self) -> None:
        self.ident()
        while self.at_p(".") and self.kind[self.i + 1] == "n":
            self.i += 1
            self.ident()

    def program(self) -> None:
        self.modifiers()
        if self.take("package"):
            self.qualified()
            self.need(";")
        elif self.i:
            self.i = 0
        while self.at("import"):
            self.i += 1
            self.take("static")
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";")
        while not self.ended():
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def modifiers(self) -> None:
        while True:
            if self.at_p("@") and not self.peek(1, "interface"):
                self.i += 1
                self.qualified()
                if self.at_p("("):
                    self.annotation_values()
            elif self.kind[self.i] == "n" and (self.value[self.i] in _MODIFIERS and not (self.at("default") and self.peek(1, ":", "->"))):
                self.i += 1
            elif self.at("non") and self.peek(1, "-"):
                self.i += 3
            else:
                return

    def annotation_values(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.kind[self.i] == "n" and self.peek(1, "="):
                self.i += 2
            self.annotation_value()
            if not self.at_p(")"):
                self.need(",")

    def annotation_value(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                self.annotation_value()
                if not self.at_p("}"):
                    self.need(",")
        elif self.at_p("@"):
            self.modifiers()
        else:
            self.conditional()

    def at_type_declaration(self) -> bool:
        return self.at("class", "interface", "enum", "@") or self.at("record") and self.kind[self.i + 1] == "n" and self.peek(2, "(", "<")

    def type_declaration(self) -> None:
        self.take("@")
        word = self.name()
        if word not in ("class", "interface", "enum", "record"):
            raise Bad(f"declaration {word}")
        self.ident()
        self.type_parameters()
        if word == "record":
            self.parameters()
        while self.take("extends", "implements", "permits"):
            self.type_()
            while self.take(","):
                self.type_()
        self.body(word == "enum")

    def body(self, enum: bool = False) -> None:
        self.need("{")
        if enum:
            while not self.at(";", "}"):
                self.modifiers()
                self.ident()
                if self.at_p("("):
                    self.arguments()
                if self.at_p("{"):
                    self.body()
                if not self.at(";", "}"):
                    self.need(",")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return None
        if self.at_p("{") or self.at("static") and self.peek(1, "{"):
            self.take("static")
            return self.block()
        self.modifiers()
        if self.at_type_declaration():
            return self.type_declaration()
        self.type_parameters()
        if self.kind[self.i] == "n" and self.peek(1, "(", "{") and not self.at("void"):
            self.ident()
            if self.at_p("("):
                self.parameters()
            self.throws()
            return self.block()
        self.type_()
        self.ident()
        if self.at_p("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.annotation_value()
            if self.at_p("{"):
                return self.block()
            return self.need(";")
        self.declarators()
        return self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.ident()

    def initializer(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                self.initializer()
                if not self.at_p("}"):
                    self.need(",")
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.modifiers()
            self.type_()
            self.take("...")
            if self.take("this"):
                pass
            else:
                self.ident()
                self.dims()
            if not self.at_p(")"):
                self.need(",")
                if self.at_p(")"):
                    raise Bad("comma")

    def dims(self) -> None:
        while self.at_p("[") and self.peek(1, "]"):
            self.i += 2

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while True:
            self.modifiers()
            self.ident()
            if self.take("extends"):
                self.type_()
                while self.take("&"):
                    self.type_()
            if self.take(">"):
                return
            self.need(",")

    def type_(self) -> None:
        self.modifiers()
        if self.kind[self.i] == "n" and self.value[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            self.ident()
            self.type_arguments()
            while self.at_p(".") and self.kind[self.i + 1] == "n":
                self.i += 1
                self.ident()
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if not self.take("<"):
            return
        if self.take(">"):
            return
        while True:
            self.modifiers()
            if self.take("?"):
                if self.take("extends", "super"):
                    self.type_()
            else:
                self.type_()
            if self.take(">"):
                return
            self.need(",")

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k == "p" and v in ("{", ";"):
            if v == "{":
                return self.block()
            self.i += 1
            return None
        if k == "n":
            rule = getattr(self, f"s_{v}", None)
            if rule and not (v == "yield" and self.peek(1, "=", ".", "(", "++", "--")):
                self.i += 1
                return rule()
            if self.peek(1, ":") and v not in _KEYWORDS:
                self.i += 2
                return self.statement()
        i = self.i
        self.modifiers()
        if self.at_type_declaration():
            return self.type_declaration()
        if self.i != i:
            self.local()
            return self.need(";")
        if not (k == "n" and self.attempt(self._local_statement)):
            self.expression_statement()
            self.need(";")
        return None

    def _local_statement(self) -> None:
        self.local()
        self.need(";")

    def local(self) -> None:
        self.type_()
        self.ident()
        self.declarators()

    def expression_statement(self) -> None:
        i = self.i
        self.expression()
        words = self.value[i : self.i]
        if not (self.value[self.i - 1] in (")", "++", "--", "]", "}") or any(w in _ASSIGN or w in ("++", "--", "new") for w in words)):
            raise Bad("no statement")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        if self.attempt(self._for_each):
            return self.statement()
        if not self.at_p(";") and not self.attempt(self._for_local):
            self.comma_expressions()
        self.need(";")
        if not self.at_p(";"):
            self.expression()
        self.need(";")
        if not self.at_p(")"):
            self.comma_expressions()
        self.need(")")
        return self.statement()

    def _for_each(self) -> None:
        self.modifiers()
        self.type_()
        self.ident()
        self.need(":")
        self.expression()
        self.need(")")

    def _for_local(self) -> None:
        self.modifiers()
        self.local()
        if not self.at_p(";"):
            raise Bad("for")

    def comma_expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def s_return(self) -> None:
        if not self.at_p(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.expression()
        self.need(";")

    s_yield = s_throw

    def s_break(self) -> None:
        if self.kind[self.i] == "n":
            self.ident()
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.condition()
        self.block()

    def s_try(self) -> None:
        resources = self.at_p("(")
        if self.take("("):
            while not self.take(")"):
                if not self.attempt(self._resource):
                    self.expression()
                if not self.at_p(")"):
                    self.need(";")
        self.block()
        caught = False
        while self.take("catch"):
            caught = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.ident()
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught and not resources:
            raise Bad("try alone")

    def _resource(self) -> None:
        self.modifiers()
        self.type_()
        self.ident()
        self.need("=")
        self.expression()

    def s_switch(self) -> None:
        self.switch_body()

    def switch_body(self) -> None:
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if not self.take("default") and not self.attempt(self._pattern):
                        self.conditional()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at_p("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not (self.at("case", "}") or self.at("default") and self.peek(1, ":", "->")):
                    self.statement()

    def _pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.at_p("("):
            self.need("(")
            while not self.take(")"):
                self._pattern()
                if not self.at_p(")"):
                    self.need(",")
            if self.kind[self.i] == "n" and not self.at("when"):
                self.ident()
        else:
            self.ident()
        if not self.at(",", ":", "->", "when", ")", "&&"):
            raise Bad("pattern")

    # expressions

    def expression(self) -> None:
        if self.lambda_():
            return
        self.conditional()
        if self.kind[self.i] == "p" and (self.value[self.i] in _ASSIGN or self.value[self.i] == ">" and self.peek(1, ">=", ">")):
            while self.take(">"):
                pass
            self.i += 1
            self.expression()

    def lambda_(self) -> bool:
        if self.kind[self.i] == "n" and self.peek(1, "->"):
            self.ident()
        elif self.at_p("(") and self.value[self.t.match[self.i] + 1] == "->" and self.kind[self.t.match[self.i] + 1] == "p":
            if self.kind[self.i + 1] == "n" and self.peek(2, ",", ")"):
                self.i += 1
                self.ident()
                while self.take(","):
                    self.ident()
                self.need(")")
            else:
                self.parameters()
        else:
            return False
        self.need("->")
        if self.at_p("{"):
            self.block()
        else:
            self.expression()
        return True

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            self.expression()
            self.need(":")
            if not self.lambda_():
                self.conditional()

    def binary(self) -> None:
        self.unary()
        while self.kind[self.i] in "pn":
            v = self.value[self.i]
            if v == ">" and self.kind[self.i] == "p":
                if self.peek(1, ">=") or self.peek(1, ">") and self.peek(2, ">="):
                    return
                self.i += 1
                self.take("=")
                while self.take(">"):
                    pass
            elif v in _BINARY:
                self.i += 1
                if v == "instanceof":
                    self.take("final")
                    if not self.attempt(self._pattern):
                        self.type_()
                        if self.kind[self.i] == "n":
                            self.ident()
                    continue
            else:
                return
            self.unary()

    def unary(self) -> None:
        while self.take("+", "-", "!", "~", "++", "--"):
            pass
        if self.at_p("(") and self._cast():
            return None
        if self.lambda_():
            return None
        self.primary()
        while True:
            if self.take("."):
                if self.at_p("<"):
                    self.type_arguments()
                if self.at("new"):
                    self.primary()
                elif not self.take("class", "this", "super"):
                    self.ident()
            elif self.at_p("("):
                self.arguments()
            elif self.at_p("[") and not self.peek(1, "]"):
                self.i += 1
                self.expression()
                self.need("]")
            elif self.take("::"):
                if not self.take("new"):
                    self.ident()
            elif self.take("++", "--"):
                pass
            else:
                return None

    def _cast(self) -> bool:
        """A type in parentheses before an operand."""
        i, j = self.i, self.t.match[self.i]
        k, v = self.kind[j + 1], self.value[j + 1]
        if not (k in "sd" or k == "n" and v != "instanceof" or k == "p" and v in ("(", "!", "~") or self.kind[i + 1] == "n" and self.value[i + 1] in _PRIMITIVE):
            return False

        def rule() -> None:
            self.need("(")
            self.type_()
            while self.take("&"):
                self.type_()
            self.need(")")

        if self.attempt(rule):
            self.unary()
            return True
        return False

    def primary(self) -> None:
        k, v = self.kind[self.i], self.value[self.i]
        if k in "sd":
            self.i += 1
        elif self.take("("):
            self.expression()
            self.need(")")
        elif k == "n":
            if v == "new":
                self.i += 1
                self.modifiers()
                if self.kind[self.i] == "n" and self.value[self.i] in _PRIMITIVE:
                    self.i += 1
                else:
                    self.ident()
                    self.type_arguments()
                    while self.take("."):
                        self.ident()
                        self.type_arguments()
                if self.at_p("["):
                    while self.take("["):
                        if not self.take("]"):
                            self.expression()
                            self.need("]")
                    if self.at_p("{"):
                        self.initializer()
                else:
                    self.arguments()
                    if self.at_p("{"):
                        self.body()
            elif v == "switch":
                self.i += 1
                self.switch_body()
            elif v in ("this", "super", "true", "false", "null"):
                self.i += 1
            elif v in _PRIMITIVE:
                self.type_()
                if not self.at(".", "::"):
                    raise Bad("type as expression")
            else:
                self.ident()
                if self.at_p("<"):
                    self.attempt(self._generic_reference)
                elif self.at_p("[") and self.peek(1, "]"):
                    self.dims()
                    if not self.at(".", "::"):
                        raise Bad("array type")
        else:
            raise Bad(f"expression at {self.i}: {v!r}")

    def _generic_reference(self) -> None:
        self.type_arguments()
        self.dims()
        if not self.at_p("::"):
            raise Bad("no reference")

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.expression()
            if not self.at_p(")"):
                self.need(",")
                if self.at_p(")"):
                    raise Bad("comma")


def parse(text: str) -> None:
    """Raises Bad where the text is no Java file."""
    Java(curly.lex(text, curly.JAVA)).program()
