"""A level-ordered cascade of pattern rules over the categories of a sentence's nodes.

Patterns are written over categories, not over text:
    A              a node of category A; several in a row are separated by blanks
    {A B}  !{A B}  one of these, none of these
    ( )  |  ? * +  as in regular expressions; ^ and $ are the sentence's ends
    [[ ]]          what becomes a new node, if not all that matches
    V( ) P( ) I( ) T( )   named stretches that features and constraints look at
    @NAME          a macro, which holds a pattern, or categories when it stands inside braces
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from re import _parser

_TOKEN = re.compile(r"\s*(\[\[|\]\]|!?\{|\}|[VPIT]\(|[()|?*+^]|\$(?![,.(])|@\w+|\$[,.(]|\w+)")


class Node:
    """A labelled node; children are nodes, or tokens (dicts)."""

    __slots__ = ("label", "children", "feats")

    def __init__(self, label: str, children: Iterable = (), feats: dict | None = None):
        self.label, self.children, self.feats = label, list(children), dict(feats or {})

    def tokens(self) -> Iterator[dict]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.tokens()
            else:
                yield child

    def descendants(self, label: str | None = None) -> Iterator:
        """Pre-order, without the node itself; tokens too if no label is asked for."""
        for child in self.children:
            if isinstance(child, Node):
                if label is None or child.label == label:
                    yield child
                yield from child.descendants(label)
            elif label is None:
                yield child

    def first(self):
        return self.children[0] if self.children else None

    def last(self):
        return self.children[-1] if self.children else None

    def replace(self, child, *others) -> None:
        at = next(k for k, c in enumerate(self.children) if c is child)
        self.children[at : at + 1] = others

    def preterminals(self) -> Iterator["Node"]:
        """Nodes of which no child is a node."""
        if not any(isinstance(c, Node) for c in self.children):
            yield self
        for child in self.children:
            if isinstance(child, Node):
                yield from child.preterminals()

    def pretty(self, depth: int = 0) -> list[str]:
        """Lines: label and features, then what is inside, four blanks deeper."""
        pad = "    " * depth
        feats = ", ".join(f"{k}={v}" for k, v in sorted(self.feats.items()) if not isinstance(v, dict) and v is not None)
        lines = [f"{pad}({self.label}" + (f" [{feats}]" if feats else "")]
        for child in self.children:
            lines += child.pretty(depth + 1) if isinstance(child, Node) else [f"{pad}    {child['form']}/{child['pos']}"]
        return [*lines, f"{pad})"]


class Alphabet:
    """One private-use character for each category."""

    def __init__(self) -> None:
        self._codes: dict[str, str] = {}

    def __getitem__(self, category: str) -> str:
        if category not in self._codes:
            if len(self._codes) >= 6400:
                raise OverflowError("more than 6400 categories")
            self._codes[category] = chr(0xE000 + len(self._codes))
        return self._codes[category]


def translate(pattern: str, macros: dict[str, str], alphabet: Alphabet) -> str:
    """The regular expression of a pattern."""

    def expand(source: str) -> list[str]:
        found, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"bad pattern at: {source[at : at + 20]!r}")
            at = m.end()
            token = m[1]
            if token.startswith("@"):
                if token[1:] not in macros:
                    raise KeyError(f"unknown macro {token}")
                inner = expand(macros[token[1:]])
                depth = sum(t in ("{", "!{") for t in found) - found.count("}")
                found += inner if depth else ["(", *inner, ")"]
            else:
                found.append(token)
        return found

    out, braces = [], False
    for token in expand(pattern):
        if token in ("{", "!{"):
            out.append("[^" if token[0] == "!" else "[")
            braces = True
        elif token == "}":
            out.append("]")
            braces = False
        elif braces:
            out.append(alphabet[token])
        elif token == "[[":
            out.append("(?P<core>")
        elif token == "]]":
            out.append(")")
        elif token[-1] == "(" and len(token) == 2 and token[0] in "VPIT":
            out.append(f"(?P<{token[0]}>")
        elif token == "(":
            out.append("(?:")
        elif token in ")|?*+^":
            out.append(token)
        elif token == "$":
            out.append(r"\Z")
        else:
            out.append(alphabet[token])
    return "".join(out)


class Match:
    """Nodes of a match and of its named stretches."""

    def __init__(self, match: re.Match, nodes: list):
        self._match, self._nodes = match, nodes

    def __getitem__(self, name: str) -> list:
        if name not in self._match.re.groupindex or self._match.start(name) < 0:
            return []
        return self._nodes[self._match.start(name) : self._match.end(name)]

    def all(self) -> list:
        return self._nodes[self._match.start() : self._match.end()]


@dataclass
class Rule:
    """pattern is found at a level, and makes a node of category lhs."""

    level: int
    lhs: str
    pattern: str
    feats: Callable[[Match], dict] | None = None
    constraint: Callable[[Match], bool] | None = None
    regex: re.Pattern | None = field(default=None, repr=False)
    needs: list[frozenset] = field(default_factory=list, repr=False)


class Cascade:
    """Rules in order of level, and within a level as given."""

    def __init__(self, rules: Iterable[Rule], macros: dict[str, str] | None = None, category: Callable[[dict], str] = lambda t: t["pos"]):
        self.alphabet, self.category = Alphabet(), category
        self.rules = sorted(rules, key=lambda r: r.level)
        for r in self.rules:
            r.regex = re.compile(translate(r.pattern, macros or {}, self.alphabet))
            r.needs = needed(r.regex.pattern)

    def string(self, nodes: list) -> str:
        return "".join(self.alphabet[n.label if isinstance(n, Node) else self.category(n)] for n in nodes)

    def parse(self, nodes: Iterable, root: str = "ROOT") -> Node:
        nodes = list(nodes)
        tags = self.string(nodes)
        there = set(tags)
        for rule in self.rules:
            if any(map(there.isdisjoint, rule.needs)):
                continue
            made, codes, at = [], [], 0
            core = "core" if "core" in rule.regex.groupindex else 0
            for m in rule.regex.finditer(tags):
                start, end = m.span(core)
                if start == end:
                    continue
                found = Match(m, nodes)
                if rule.constraint is not None and not rule.constraint(found):
                    continue
                feats = rule.feats(found) if rule.feats else None
                made += nodes[at:start]
                made.append(Node(rule.lhs, nodes[start:end], feats))
                codes += tags[at:start], self.alphabet[rule.lhs]
                at = end
            if at:
                nodes = made + nodes[at:]
                tags = "".join(codes) + tags[at:]
                there = set(tags)
        return Node(root, nodes)


def needed(regex: str) -> list[frozenset]:
    """Sets of characters of each of which every match holds one at least."""

    def walk(parts) -> list[frozenset]:
        found = []
        for op, value in parts:
            if op is _parser.LITERAL:
                found.append(frozenset((chr(value),)))
            elif op is _parser.IN and all(kind is _parser.LITERAL for kind, _ in value):
                found.append(frozenset(chr(c) for _, c in value))
            elif op is _parser.SUBPATTERN:
                found += walk(value[3])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                found += walk(value[2])
            elif op is _parser.BRANCH:
                each = [walk(x) for x in value[1]]
                if all(each):  # one of each way's sets: the smallest
                    found.append(frozenset().union(*(min(sets, key=len) for sets in each)))
        return found

    return list(dict.fromkeys(walk(_parser.parse(regex))))


def read_rules(lines: Iterable[str]) -> tuple[list[Rule], dict[str, str]]:
    """Rules and macros of a file: name=pattern, or level, tab, category, tab, pattern; # begins a comment."""
    rules, macros = [], {}
    for line in lines:
        line = line.partition("#")[0].strip()
        if not line:
            continue
        parts = line.split("\t")
        if len(parts) == 3:
            rules.append(Rule(int(parts[0]), parts[1], parts[2]))
        elif "=" in line:
            name, pattern = (x.strip() for x in line.split("=", 1))
            if name in macros:
                raise ValueError(f"macro {name} is defined twice")
            macros[name] = pattern
        else:
            raise ValueError(f"neither macro nor rule: {line!r}")
    return rules, macros
