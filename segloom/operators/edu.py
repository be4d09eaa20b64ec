"""Elementary discourse segments from a sentence's clauses: a fold that decides which clause begins a segment."""

from __future__ import annotations

from functools import cache

from ..sources import lexicon
from .cascade import Node
from .grammar import clause_tree

MAIN, SUB, REL, PAREN = "MainCl", "SubCl", "RelCl", "Paren"
_COMPLEMENTIZERS = ("dass", "daß", "ob")


@cache
def _verbs(kind: str) -> dict:
    return lexicon.verb_table(lexicon.COMPLEMENT_VERBS if kind == "complement" else lexicon.REPORTING_VERBS)


@cache
def _skips() -> tuple:
    split = lambda side: tuple(tuple(p.split("|")) for p in side.split("_") if p)
    return tuple((split(back), split(front)) for back, _, front in (r.partition("@") for r in lexicon.SKIP_RULES))


def begins_like(rule: tuple, tokens: list[dict], previous: list[dict]) -> bool:
    """Whether a clause's first tokens, and the last ones before it, are those of the rule, by form or by tag."""
    back, front = rule
    fits = lambda words, side: len(words) >= len(side) and all(w["form"] in p or w["pos"] in p for w, p in zip(words, side))
    return fits(tokens, front) and fits(previous[-len(back) :] if back else [], back)


def is_token(x) -> bool:
    return x is not None and not isinstance(x, Node)


class Folder:
    """Segments of one sentence. The root's children are segments; one that is embedded stands inside another."""

    def __init__(self) -> None:
        self.root = Node("SDS")
        self.previous: list[dict] = []

    def new(self, kind: str | None = None) -> Node:
        self.root.children.append(Node("EDS", feats={"type": kind} if kind else {}))
        return self.root.children[-1]

    @staticmethod
    def embed(segment: Node, kind: str | None = None) -> Node:
        inner = Node("EDS", feats={"embedded": True} | ({"type": kind} if kind else {}))
        segment.children.append(inner)
        return inner

    def fold(self, clauses: Node) -> Node:
        segment = self.new(MAIN)
        for k in range(len(clauses.children)):
            segment = self.clause(clauses.children[k], k, clauses.children, segment, 0)
        return self.root

    def open(self, segment: Node, depth: int, kind: str | None = None) -> Node:
        """A segment of its own: embedded if inside a clause, else a new one unless the present one is still empty."""
        if depth > 0:
            return self.embed(segment, kind)
        return self.new(kind) if segment.children else segment

    def inside(self, clause: Node, segment: Node, depth: int) -> Node:
        for k, child in enumerate(clause.children):
            if is_token(child):
                segment.children.append(child)
            else:
                segment = self.clause(child, k, clause.children, segment, depth)
        return segment

    def clause(self, clause, at: int, siblings: list, segment: Node, depth: int) -> Node:
        if is_token(clause):
            segment.children.append(clause)
            return segment
        if not clause.children:
            return segment
        clause = join_coordination(clause)
        if 0 < at < len(siblings) - 1 and is_token(siblings[at - 1]) and is_token(siblings[at + 1]):
            depth += 1
        first = clause.first()
        if not is_token(first) and first.label == clause.label:
            for k, child in enumerate(clause.children):
                segment = self.clause(child, k, clause.children, segment, depth)
            return segment
        tokens, before = list(clause.tokens()), self.previous
        self.previous = tokens
        if any(begins_like(r, tokens, before) for r in _skips()):
            return self.inside(clause, segment, depth)
        by_label = getattr(self, "on_" + clause.label.lower(), None)
        return segment if by_label is None else by_label(clause, at, siblings, segment, depth)

    def on_maincl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        verb, with_it = verb_and_dependants(clause)
        if clause.feats.get("makeVerbLess"):
            segment = self.new(MAIN)
        elif verb is None:
            segment.children += clause.tokens()
            return segment
        elif segment.children and not lexicon.verb_matches(_verbs("reporting"), verb["lemma"], with_it) and not self.is_bare_complement(clause, at, siblings):
            segment = self.open(segment, depth, MAIN)
        seen = False
        for k, child in enumerate(clause.children):
            if not is_token(child):
                segment = self.clause(child, k, clause.children, segment, depth)
                continue
            if not seen and segment.feats.get("type") != MAIN:
                segment = self.new(MAIN)
            seen = True
            segment.children.append(child)
        return self.root.last()

    def on_sntsubcl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        if not is_complement(clause):
            segment = self.open(segment, depth)
            segment.feats["type"] = SUB
        self.inside(clause, segment, depth)
        return self.root.last()

    def on_infsubcl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        if is_subordinate(clause, segment):
            segment = self.open(segment, 0)
            segment.feats["type"] = SUB
        return self.inside(clause, segment, depth)

    def on_relcl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        segment = self.open(segment, depth)
        segment.feats["type"] = REL
        self.inside(clause, segment, depth)
        return self.root.last()

    def on_infcl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        return self.inside(clause, segment, depth)

    def on_intcl(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        if any(t["form"] in ("weswegen", "weshalb") for t in list(clause.tokens())[:2]):
            segment = self.open(segment, depth)
            segment.feats["type"] = SUB
        segment = self.inside(clause, segment, depth)
        last = clause.last()
        return self.new(MAIN) if is_token(last) and last["form"] == ":" else segment

    def on_paren(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        tokens = list(clause.tokens())
        if tokens[0]["form"] not in lexicon.QUOTES and any(t["pos"].startswith("VV") for t in tokens):
            segment = self.open(segment, depth, PAREN)
        segment.children += tokens
        return self.root.last()

    def on_pc(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        segment.children += clause.tokens()
        return segment

    def on_any(self, clause: Node, at: int, siblings: list, segment: Node, depth: int) -> Node:
        segment.feats.setdefault("type", MAIN)
        segment.children += clause.tokens()
        return segment

    def is_bare_complement(self, clause: Node, at: int, siblings: list) -> bool:
        """A main clause without a conjunction that is the object of the verb before it."""
        before = siblings[at - 1] if at else None
        if not isinstance(before, Node):
            return False
        verb, with_it = verb_and_dependants(before)
        if verb is None:
            return False
        tokens = list(clause.tokens())[:2]
        if tokens and tokens[0]["pos"] == "KON":
            return False
        if tokens and tokens[0]["pos"] != "ADV" and len(tokens) > 1 and tokens[1]["lemma"] in ("dass", "daß"):
            return False
        return lexicon.verb_matches(_verbs("complement"), verb["lemma"], with_it)


def verb_and_dependants(clause: Node) -> tuple[dict | None, list[dict]]:
    verb = clause.feats.get("verb")
    return (None, []) if verb is None else (verb, [t for t in clause.tokens() if t["phead"] == verb["idx"]])


def is_complement(clause: Node) -> bool:
    """A that-clause, unless an adverb or so goes before; or one that a conjunction begins."""
    before = None
    for token in list(clause.tokens())[:3]:
        if token["lemma"] in _COMPLEMENTIZERS:
            return before is None or (before["pos"] != "ADV" and before["lemma"] != "so")
        if token["pos"] == "KON":
            return True
        before = token
    return False


def is_subordinate(clause: Node, segment: Node) -> bool:
    """Not of the kind "zu klein, um ...": with um, always; else unless an adjective near the segment's end has zu or genug."""
    if any(is_token(t) and (t["lemma"] or "").lower() == "um" for t in clause.children[:2]):
        return True
    back = list(segment.tokens())[::-1][:9]
    for k, token in enumerate(back):
        if token["pos"] in ("ADJD", "VVPP"):
            if back[k - 1]["lemma"] == "genug":
                return False
            if k + 1 >= len(back):
                return True
            if back[k + 1]["lemma"] in ("genug", "zu"):
                return False
    return True


def join_coordination(clause: Node) -> Node:
    """In X KON X ... a conjunction becomes the first word of the conjunct after it."""
    first, second = (*clause.children[:2], None, None)[:2]
    if second is None or is_token(first) or first.label != clause.label or not is_token(second) or second["pos"] != "KON":
        return clause
    out, waiting = Node(clause.label), []
    for child in clause.children:
        if is_token(child):
            waiting.append(child)
            continue
        if waiting:
            deepest = child
            while isinstance(deepest.first(), Node):
                deepest = deepest.first()
            deepest.children[:0] = waiting
            waiting = []
        out.children.append(child)
    out.children += waiting
    return out


def segment(sentence: list[dict]) -> Node:
    """The segments of a sentence of tokens (idx, form, lemma, pos, feat, phead, pdeprel)."""
    return Folder().fold(clause_tree(sentence))


def rows(sentence: list[dict]) -> list[dict]:
    """segment() as nodes in pre-order: parent, label, type, embedded, first and last token, depth."""
    found: list[dict] = []

    def visit(node: Node, parent: int, depth: int) -> None:
        number = len(found)
        places = [t["idx"] for t in node.tokens()]
        found.append(
            {"node": number, "parent": parent, "depth": depth, "label": node.label, "type": node.feats.get("type"), "embedded": bool(node.feats.get("embedded")),
             "first": min(places, default=0), "last": max(places, default=0), "n_tokens": len(places), "tokens": [t["form"] for t in node.tokens()]}
        )
        for child in node.children:
            if isinstance(child, Node):
                visit(child, number, depth + 1)

    visit(segment(sentence), -1, 0)
    return found
