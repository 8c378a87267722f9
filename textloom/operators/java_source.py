"""A lexer and block parser for Java sources: units, blocks, names and calls, as far as segmentation needs them.

No bindings are resolved: two occurrences of one name in a file count as the same thing, and a call goes to the first
method of the file with its name and number of parameters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

#: The parser looks at so many tokens at once.
AHEAD = 4
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
#: Words of the language that name nothing.
KEYWORDS = frozenset(
    (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
        "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient "
        "try void volatile while true false null"
    ).split()
)
TOKEN = re.compile(
    r"""(?:(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>[][(){},;])|(?P<space>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<sign>->|::|[-+*/%&|^<>=!]=|&&|\|\||\+\+|--|.))\s*""",
    re.S,
)
#: What the parser passes over.
PASSED = frozenset(("space", "doc", "comment"))
TYPES = ("class", "interface", "enum")


class ParseError(ValueError):
    """The source is not what the parser can follow."""


#: Words that a statement may begin with that is more than an expression.
STATEMENTS = frozenset("if while switch synchronized for do try abstract final static assert return throw break continue".split()).union(TYPES)


@dataclass(eq=False, slots=True)
class Node:
    """A piece of the source: [start, end) in code points, its parts in order."""

    kind: str
    start: int
    end: int = 0
    name: str = ""
    parameters: int = 0
    parent: Node | None = None
    parts: Sequence[Node] = field(default_factory=list)

    @property
    def depth(self) -> int:
        n, node = 0, self.parent
        while node is not None:
            n, node = n + 1, node.parent
        return n

    def add(self, node: Node) -> Node:
        node.parent = self
        self.parts.append(node)
        return node

    def covers(self, other: Node) -> bool:
        return self.start <= other.start and other.end <= self.end

    def walk(self) -> list[Node]:
        """The node and all beneath it, in order of the source."""
        found, todo = [], [self]
        while todo:
            node = todo.pop()
            found.append(node)
            if node.parts:
                todo += node.parts[::-1]
        return found


class Parser:
    """Recursive descent over the tokens of one source."""

    def __init__(self, text: str):
        self.text, self.at, self.docs = text, 0, {}
        found = [(m.lastgroup, m[m.lastindex], m.start()) for m in TOKEN.finditer(text)]
        if not PASSED.isdisjoint([kind for kind, _, _ in found]):
            kept, doc = [], None
            for token in found:
                if token[0] == "doc":
                    doc = token[2]
                elif token[0] not in PASSED:
                    if doc is not None:
                        self.docs[len(kept)], doc = doc, None
                    kept.append(token)
            found = kept
        self.n = len(found)
        self.starts = [start for _, _, start in found]
        # What is looked at beyond the end.
        self.words = [word for _, word, _ in found] + [""] * AHEAD
        self.kinds = [kind for kind, _, _ in found] + ["end"] * AHEAD
        self.named = [kind == "name" and word not in KEYWORDS for kind, word in zip(self.kinds, self.words)]

    # Tokens

    def look(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead]

    def kind(self, ahead: int = 0) -> str:
        return self.kinds[self.at + ahead]

    def place(self) -> int:
        return self.starts[self.at] if self.at < self.n else len(self.text)

    def behind(self) -> int:
        return self.starts[self.at - 1] + len(self.words[self.at - 1]) if self.at else 0

    def take(self, wanted: str = "") -> str:
        got = self.words[self.at]
        if not got or wanted and got != wanted:
            raise ParseError(f"{wanted or 'more'} expected at {self.place()}, found {got or 'the end'}")
        self.at += 1
        return got

    def is_name(self, ahead: int = 0) -> bool:
        return self.named[self.at + ahead]

    def put_name(self, node: Node) -> None:
        at = self.at
        name = self.words[at] or self.take()  # which fails at the end
        start = self.starts[at]
        self.at = at + 1
        node.parts.append(Node("name", start, start + len(name), name, 0, node, ()))

    # Declarations

    def unit(self) -> Node:
        top = Node("compilation_unit", 0, len(self.text))
        while self.at < self.n:
            before = self.at
            if self.look() in ("package", "import"):
                while self.take() != ";":
                    pass
            elif self.look() == ";":
                self.take()
            else:
                self.member(top)
            if self.at == before:
                raise ParseError(f"unexpected {self.look()} at {self.place()}")
        return top

    def modifiers(self, node: Node) -> None:
        while True:
            if self.look() == "@" and self.look(1) != "interface":
                self.take()
                self.qualified(node)
                if self.look() == "(":
                    self.expression(node, ")", inside="(")
            elif self.look() in MODIFIERS:
                if self.look() == "synchronized" and self.look(1) == "(" or self.look() == "default" and self.look(1) in (":", "->"):
                    return
                self.take()
            else:
                return

    def qualified(self, node: Node) -> None:
        self.put_name(node)
        while self.look() == "." and self.is_name(1):
            self.take()
            self.put_name(node)

    def member(self, owner: Node) -> None:
        start = self.docs.get(self.at, self.place())
        node = Node("field", start)
        self.modifiers(node)
        if self.look() in TYPES or self.look() == "@" and self.look(1) == "interface":
            owner.add(node)
            node.kind = "type"
            self.type_rest(node)
        elif self.look() == "{":
            owner.add(node)
            node.kind = "initializer"
            self.block(node)
        else:
            owner.add(node)
            if self.look() == "<":
                self.type_arguments(node)
            if self.is_name() and self.look(1) == "(":
                node.kind = "method"
                self.method_rest(node)
            else:
                self.type_name(node)
                if self.is_name() and self.look(1) == "(":
                    node.kind = "method"
                    self.method_rest(node)
                else:
                    self.expression(node, ";")
        node.end = self.behind()

    def type_rest(self, node: Node) -> None:
        if self.take() == "@":
            self.take()
        node.name = self.look()
        self.put_name(node)
        while self.look() != "{":
            if self.is_name():
                self.put_name(node)
            else:
                self.take()
        self.body(node)

    def body(self, node: Node) -> None:
        """Members between braces; before them, constants of an enumeration."""
        self.take("{")
        if node.kind == "type" and self.is_name() and self.look(1) in (",", "(", ";", "}", "{"):
            while self.look() not in (";", "}"):
                if self.is_name():
                    self.put_name(node)
                elif self.look() == "(":
                    self.expression(node, ")", inside="(")
                elif self.look() == "{":
                    self.body(node.add(Node("anonymous", self.place())))
                    node.parts[-1].end = self.behind()
                else:
                    self.take()
        while self.look() != "}":
            if self.look() == ";":
                self.take()
            else:
                self.member(node)
        self.take("}")

    def type_arguments(self, node: Node) -> None:
        level = 0
        while True:
            got = self.look()
            if self.is_name():
                self.put_name(node)
            else:
                self.take()
                level += got.count("<") - got.count(">") if set(got) <= set("<>") else 0
            if level <= 0:
                return

    def type_name(self, node: Node) -> None:
        """A type: names, arguments in angle brackets, array brackets."""
        if self.is_name():
            self.qualified(node)
        elif self.kind() == "name":
            self.take()
        else:
            raise ParseError(f"a type expected at {self.place()}, found {self.look() or 'the end'}")
        if self.look() == "<":
            self.type_arguments(node)
            if self.look() == "." and self.is_name(1):
                self.take()
                self.type_name(node)
        while self.look() == "[" and self.look(1) == "]":
            self.take()
            self.take("]")

    def method_rest(self, node: Node) -> None:
        node.name = self.look()
        self.put_name(node)
        self.take("(")
        level, some = 0, False
        while self.look() != ")" or level:
            got = self.look()
            some = True
            if self.is_name():
                self.put_name(node)
                continue
            self.take()
            level += (got in "([") - (got in ")]") + (got.count("<") - got.count(">") if set(got) <= set("<>") else 0)
            node.parameters += got == "," and not level
        node.parameters += some
        self.take(")")
        while self.look() not in ("{", ";", ""):
            if self.is_name():
                self.put_name(node)
            elif self.look() == "default":
                self.take()
                self.expression(node, ";")
                return
            else:
                self.take()
        if self.look() == "{":
            self.block(node)
        else:
            self.take(";")

    # Statements

    def block(self, owner: Node) -> None:
        node = owner.add(Node("block", self.place()))
        self.take("{")
        while self.look() != "}":
            self.statement(node)
        self.take("}")
        node.end = self.behind()

    def statement(self, owner: Node) -> None:
        word = self.look()
        if word == "{":
            return self.block(owner)
        node = owner.add(Node("statement", self.place()))
        if word not in STATEMENTS and self.look(1) != ":":
            self.expression(node, ";")
            node.end = self.behind()
            return None
        if word in ("if", "while", "switch", "synchronized"):
            node.kind = word
            self.take()
            self.expression(node, ")", inside="(")
            if word == "switch":
                self.switch_body(node)
            else:
                self.statement(node)
                if word == "if" and self.look() == "else":
                    self.take()
                    self.statement(node)
        elif word == "for":
            node.kind = word
            self.take()
            self.expression(node, ")", inside="(")
            self.statement(node)
        elif word == "do":
            node.kind = word
            self.take()
            self.statement(node)
            self.take("while")
            self.expression(node, ")", inside="(")
            self.take(";")
        elif word == "try":
            node.kind = word
            self.take()
            if self.look() == "(":
                self.expression(node, ")", inside="(")
            self.block(node)
            while self.look() == "catch":
                clause = node.add(Node("catch", self.place()))
                self.take()
                self.expression(clause, ")", inside="(")
                self.block(clause)
                clause.end = self.behind()
            if self.look() == "finally":
                self.take()
                self.block(node)
        elif word in TYPES or word in ("abstract", "final", "static") and self.look(1) in TYPES:
            node.kind = "type_statement"
            self.member(node)
        elif self.is_name() and self.look(1) == ":":
            node.kind = "labeled"
            self.put_name(node)
            self.take(":")
            self.statement(node)
        elif word == "assert" or word in ("return", "throw", "break", "continue"):
            self.take()
            self.expression(node, ";")
        else:
            self.expression(node, ";")
        node.end = self.behind()
        return None

    def switch_body(self, node: Node) -> None:
        self.take("{")
        while self.look() != "}":
            if self.look() in ("case", "default"):
                case = node.add(Node("case", self.place()))
                if self.take() == "case":
                    self.expression(case, (":", "->"))
                else:
                    self.take()
                case.end = self.behind()
            else:
                self.statement(node)
        self.take("}")

    def expression(self, node: Node, until: str | tuple[str, ...], inside: str = "") -> None:
        """Names, calls, lambda bodies and anonymous classes up to a closing sign, which is taken."""
        if inside:
            self.take(inside)
        ends = (until,) if isinstance(until, str) else until
        asked, words, named, starts = 0, self.words, self.named, self.starts
        while True:
            at = self.at
            got = words[at]
            if named[at]:
                if words[at + 1] == "(" and words[at - 1] != "new":
                    self.call(node)
                else:
                    start = starts[at]
                    self.at = at + 1
                    node.parts.append(Node("name", start, start + len(got), got, 0, node, ()))
                continue
            if not got:
                raise ParseError(f"{until} expected, found the end")
            if got in ends and not (got == ":" and asked):
                self.at = at + 1
                return
            if got == "(":
                self.expression(node, ")", inside="(")
                if self.look() == "{" and self.look(-1) == ")":
                    body = node.add(Node("anonymous", self.place()))
                    self.body(body)
                    body.end = self.behind()
            elif got == "[":
                self.expression(node, "]", inside="[")
            elif got == "->" and self.look(1) == "{":
                self.take()
                self.block(node)
            elif got == "{":
                self.expression(node, "}", inside="{")
            elif got in (")", "]", "}"):
                raise ParseError(f"unexpected {got} at {self.place()}")
            else:
                if got == "?":
                    asked += 1
                elif got == ":":
                    asked -= 1
                self.at = at + 1

    def call(self, node: Node) -> None:
        made = node.add(Node("call", self.place(), name=self.look()))
        self.put_name(made)
        first = self.at
        self.expression(made, ")", inside="(")
        made.end = self.behind()
        # Arguments are what top-level commas part.
        level, commas, inside = 0, 0, self.words[first : self.at]
        if "," in inside:
            for sign in inside:
                level += (sign in ("(", "[", "{")) - (sign in (")", "]", "}"))
                commas += sign == "," and level == 1
        made.parameters = commas + (len(inside) > 2)


def parse(text: str) -> Node:
    return Parser(text).unit()


def methods(top: Node) -> list[Node]:
    """All methods, in order of source."""
    return [n for n in top.walk() if n.kind == "method"]


def locate_unit(top: Node, relevant: set[str] | frozenset[str]) -> Node | None:
    """The whole source if no names are given, else the first method with one of the names, if any."""
    return next((m for m in methods(top) if m.name in relevant), None) if relevant else top
