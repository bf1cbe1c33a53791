"""What the grammars share: token lists, brackets, errors."""

from __future__ import annotations


class Bad(Exception):
    """The text is not in the language."""


class Tokens:
    """Parallel lists of kinds, values, and whether a line ends before; with the matching bracket of each."""

    __slots__ = ("kind", "value", "nl", "match", "n")

    def __init__(self, kind: list[str], value: list, nl: list[bool]):
        self.kind, self.value, self.nl, self.n = kind, value, nl, len(kind)
        kind.append("e")
        value.append("")
        nl.append(True)
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        match, stack, pair = {}, [], {")": "(", "]": "[", "}": "{"}
        for i in range(self.n):
            if self.kind[i] != "p":
                continue
            v = self.value[i]
            if v in ("(", "[", "{"):
                stack.append(i)
            elif v in pair:
                if not stack or self.value[stack[-1]] != pair[v]:
                    raise Bad("bracket")
                j = stack.pop()
                match[j] = i
        if stack:
            raise Bad("open bracket")
        return match


class Parser:
    """A cursor on tokens; grammars add the rules."""

    def __init__(self, tokens: Tokens):
        self.t, self.i = tokens, 0
        self.kind, self.value = tokens.kind, tokens.value

    def at(self, *values: str) -> bool:
        return self.kind[self.i] in ("p", "n") and self.value[self.i] in values

    def at_p(self, value: str) -> bool:
        return self.value[self.i] == value and self.kind[self.i] == "p"

    def peek(self, k: int, *values: str) -> bool:
        j = self.i + k
        return j < self.t.n and self.kind[j] in ("p", "n") and self.value[j] in values

    def take(self, *values: str) -> bool:
        if self.kind[self.i] in ("p", "n") and self.value[self.i] in values:
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.take(*values):
            raise Bad(f"{values} at {self.i}: {self.value[self.i]!r}")

    def name(self) -> str:
        if self.kind[self.i] != "n":
            raise Bad(f"name at {self.i}: {self.value[self.i]!r}")
        self.i += 1
        return self.value[self.i - 1]

    def ended(self) -> bool:
        return self.kind[self.i] == "e"

    def attempt(self, rule) -> bool:
        """Runs the rule; where it fails, nothing was read."""
        i = self.i
        try:
            rule()
            return True
        except Bad:
            self.i = i
            return False
