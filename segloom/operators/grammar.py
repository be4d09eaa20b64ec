"""The rules that find chunks, verb groups and clauses in German sentences with STTS tags."""

from __future__ import annotations

from functools import cache

from ..functions.morphology import feature_bits, unifies
from ..sources import lexicon
from .cascade import Cascade, Match, Node, Rule

MONTHS = frozenset("Januar Februar März Maerz April Mai Juni Juli August September Oktober November Dezember".split())
_FINITE = lexicon.finite_verbs()

MACROS = {
    "VFIN": "VAFIN VMFIN VVFIN",
    "VINF": "VAINF VAPP VMINF VMPP VVINF VVIZU VVPP",
    "VG": "FVG IVG",
    "PUNCT": "$, $( $.",
    "EOS": "$. $,",
    "DASH": "EMDASH ENDASH FIGUREDASH BAR",
    "CLAUSE": "RelCl InfCl IntCl SntSubCl InfSubCl MainCl",
    "REL": "PRELS PRELAT",
    "PW": "PWS PWAT PWAV",
    "N0": "!{@PUNCT KON @VG}",
    # ( N0 (KON? N0)? )*, written so that there is one way only to read a stretch; else a failing search is exponential
    "BC": "( @N0 ( KON @N0 )? )*",
    # ( N0 ( {$, KON} N0 | CLAUSE $, )? )* by its deterministic automaton, for the same reason; PLAIN is an N0 that is no clause
    "PLAIN": "!{@PUNCT KON @VG @CLAUSE}",
    "ON": "@N0 ( @PLAIN | {@CLAUSE}+ ( @PLAIN | $, @N0 ) )*",
    "C": "( @ON ( {$, KON} @N0 | {@CLAUSE}+ KON @N0 ) )* ( @ON ( {@CLAUSE}+ $,? )? )?",
    "TR": "{APPR APPRART KOKOM} @N0+ | PC",
    "END": "@TR? {@EOS}?",
    "X": "!{@VG KON @CLAUSE @DASH @PUNCT PTKVZ}",
    "Y": "!{@VG @CLAUSE @DASH @PUNCT}",
}


def _months(m: Match) -> bool:
    return m["V"][0]["lemma"] in ("Anfang", "Mitte", "Ende") and m["T"][0]["lemma"] in MONTHS


def _genitive(m: Match) -> bool:
    """The last noun chunk is an article and a noun that can be genitive."""
    chunk = m["T"][0]
    article, noun = chunk.first(), chunk.last()
    if isinstance(article, Node) or isinstance(noun, Node) or article["pos"] != "ART" or noun["pos"] != "NN":
        return False
    return unifies(feature_bits(article["feat"]), feature_bits({"case": "gen"}))


def chunk_rules() -> list[Rule]:
    det, adjectives = "{CARD PDAT PDS PIAT PPOSAT}", "( ADJA ADJA? ( $, ADJA ADJA? )* )?"
    return [
        Rule(1, "NC", "PPER"),
        Rule(1, "NC", "( ^ | !{ART CARD PDAT PDS PIAT PPOSAT} ) [[ V( NN ) T( NN ) ]]", constraint=_months),
        Rule(1, "NC", f"( ART PIAT? | {det} )? {adjectives} {{NE NN}}"),
        Rule(2, "PC", "APPR NC? PDS"),
        Rule(2, "PC", "{APPR APRRART} NC ( KON NC )* T( NC ) ( PDS | {APZR PROAV} )?", constraint=_genitive),
        Rule(2, "PC", "{APPR APPRART} APPR? ( ADV ( KON ADV )? | CARD ( KON CARD )? | NC ( KON NC )? ) {APZR PROAV}?"),
        Rule(3, "AC", "ADV* PTKNEG? ADJD+"),
        Rule(3, "AC", "PTKA? ADV+"),
        Rule(3, "AC", "PROAV"),
        Rule(3, "NC", f"( ART PIAT? | {det} ) PC NC"),
    ]


def _group_verb(nodes: list) -> dict | None:
    """The last full verb, else the last modal, else the last auxiliary."""
    for kind in ("VV", "VM", "VA"):
        for token in reversed(nodes):
            if token["pos"].startswith(kind):
                return token
    return None


def _verb_of(nodes: list) -> dict | None:
    return nodes[0].feats.get("verb") if nodes and isinstance(nodes[0], Node) else None


def _own(m: Match) -> dict:
    return {"verb": _group_verb(m["core"] or m.all())}


def _inherited(m: Match) -> dict:
    return {"verb": _verb_of(m["V"])}


def _shared(m: Match) -> dict:
    return m["T"][0].feats


def _verbless(m: Match) -> dict:
    return {"makeVerbLess": True}


def _complex_that(m: Match) -> bool:
    """The clause begins with Dadurch, Dafür, Aufgrund dessen or Auf Grund dessen (which may be cut short by the chunk's end)."""
    forms = [t["form"] for n in m["T"] for t in (n.tokens() if isinstance(n, Node) else [n])]
    begins = lambda *words: all(f in w for f, w in zip(forms, words))
    return begins(("Dadurch", "Dafür", "Dafuer")) or begins(("Aufgrund",), ("dessen",)) or begins(("Auf",), ("Grund",), ("dessen",))


def _main_verb(m: Match) -> dict:
    fin = _verb_of(m["V"])
    if fin is not None and fin["pos"].startswith("VV"):
        return {"verb": fin, "verb_part": m["P"][0]["lemma"] if m["P"] else None}
    inf = _verb_of(m["I"])
    return {"verb": inf if inf is not None and inf["pos"].startswith(("VM", "VV")) else fin}


def _never(m: Match) -> bool:
    return False


def clause_rules() -> list[Rule]:
    r, rules = Rule, []
    for begin, end in lexicon.OPENERS:
        rules.append(r(0, "Paren", f"{lexicon.DELIMITERS[begin]} !{{{lexicon.DELIMITERS[end]}}}+ {lexicon.DELIMITERS[end]}"))
    verb = _inherited
    rules += [
        r(5, "FVG", "[[ PTKZU? {@VINF}+ {@VFIN} | VVINF VVINF ]] ( !{NC PC} | $ )", _own),
        r(5, "FVG", "VVPP VAINF {@VFIN} | {@VFIN} VVPP VAINF | {@VFIN} {@VINF}*", _own),
        r(5, "IVG", "{@VINF}* PTKZU? {@VINF}+", _own),
        r(6, "RelCl", "APPR? {@REL} @BC V( {@VG} ) @END", verb),
        # the constraint looks at the verb group and never holds
        r(7, "SntSubCl", "^ {AC PC} $, KOUS @BC V( {@VG} ) @END", verb, _never),
        r(7, "SntSubCl", "( ^ | $( )? {AC APPR}? KOUS @BC V( {@VG} ) @END", verb),
        r(7, "InfSubCl", "{AC APPR}? KOUI @BC V( IVG ) @END", verb),
        r(7, "RelCl", "KON [[ APPR? {@REL} @BC V( {@VG} ) @END ]]", verb),
        r(7, "RelCl", "RelCl KON [[ @BC V( {@VG} ) @END ]]", verb),
        r(7, "IntCl", "{@PW} @BC V( {@VG} ) @END", verb),
        r(8, "SntSubCl", "KON [[ APPR? KOUS @BC V( {@VG} ) @END ]]", verb),
        r(8, "InfSubCl", "InfSubCl KON [[ @BC V( IVG ) @END ]]", verb),
        r(8, "InfSubCl", "KON [[ KOUI @BC V( IVG ) @END ]]", verb),
        r(8, "IntCl", "IntCl KON [[ @BC V( {@VG} ) @END ]]", verb),
        r(9, "IntCl", "IntCl RelCl"),
        r(10, "InfSubCl", "InfSubCl ( KON InfSubCl )+"),
        r(10, "RelCl", "RelCl SntSubCl"),
        r(10, "RelCl", "RelCl InfSubCl"),
        r(10, "RelCl", "RelCl Paren"),
        r(10, "IntCl", "IntCl ( KON? IntCl )+"),
        r(11, "SntSubCl", "SntSubCl RelCl"),
        r(11, "SntSubCl", "SntSubCl IntCl"),
        r(11, "SntSubCl", "SntSubCl InfSubCl"),
        r(11, "SntSubCl", "SntSubCl ( KON SntSubCl )+"),
        r(11, "InfSubCl", "InfSubCl RelCl"),
        r(11, "InfSubCl", "InfSubCl IntCl"),
        r(11, "InfSubCl", "InfSubCl ( KON InfSubCl )+"),
        r(11, "RelCl", "RelCl ( KON? RelCl )+"),
        r(12, "SntSubCl", "^ T( {AC PC} ) $, KOUS @BC {@VG} @END", lambda m: {"verb": None}, _complex_that),
        r(12, "SntSubCl", "^ [[ FVG @C IVG? $, ]] AC? FVG"),
        r(12, "SntSubCl", "{AC APPR}? KOUS @C V( {@VG} | PTKVZ ) @END", verb),
        r(12, "InfSubCl", "{AC APPR}? KOUI @C V( IVG ) @END", verb),
        r(12, "InfCl", "[[ ( ^ | $, | KON ) ( !{@REL KOUS KOUI FVG} @C {NC PC} @C )? V( IVG ) @TR? {@EOS @PUNCT}? ]]", verb),
        r(12, "RelCl", "$, APPR? {@REL} @C V( {@VG} ) @END", verb),
        r(12, "IntCl", "KON? {@PW} @C {@VG} @END", lambda m: {"verb": None}),
        r(13, "SntSubCl", "KON [[ {AC APPR}? KOUS @C V( {@VG} ) @END ]]", verb),
        r(13, "SntSubCl", "SntSubCl KON [[ @C V( {@VG} ) ( {$, KON} @C {@VG} {$, @EOS} )* @END ]]", verb),
        r(13, "InfSubCl", "KON [[ {AC APPR}? KOUI @C V( IVG ) @END ]]", verb),
        r(13, "InfSubCl", "InfSubCl KON [[ @C V( IVG ) @END ]]", verb),
        r(13, "InfCl", "InfCl KON [[ @C V( IVG ) @END ]]", verb),
        r(13, "RelCl", "KON [[ APPR? {@REL} @C V( {@VG} ) @END ]]", verb),
        r(13, "RelCl", "RelCl KON [[ @C V( {@VG} ) @END ]]", verb),
        r(13, "IntCl", "KON [[ {@PW} @C V( {@VG} ) @END ]]", verb),
        r(13, "IntCl", "IntCl KON [[ @C V( {@VG} ) @END ]]", verb),
        r(14, "SntSubCl", "SntSubCl KON [[ @BC V( {@VG} ) @TR? {@EOS} ]]", verb),
        r(14, "InfCl", "InfCl RelCl"),
        r(14, "IntCl", "IntCl RelCl"),
        r(15, "InfCl", "InfCl ( KON? InfCl )+"),
        r(15, "RelCl", "RelCl SntSubCl"),
        r(15, "RelCl", "RelCl InfSubCl"),
        r(15, "RelCl", "RelCl InfCl"),
        r(15, "IntCl", "IntCl ( KON? IntCl )+"),
        r(16, "SntSubCl", "SntSubCl RelCl"),
        r(16, "SntSubCl", "SntSubCl IntCl"),
        r(16, "SntSubCl", "SntSubCl InfSubCl"),
        r(16, "SntSubCl", "SntSubCl ( KON SntSubCl )+"),
        r(16, "InfSubCl", "InfSubCl RelCl"),
        r(16, "InfSubCl", "InfSubCl IntCl"),
        r(16, "RelCl", "RelCl ( KON? RelCl )+"),
        r(17, "MainCl", "^ @Y* ( {@VG @CLAUSE} @Y* )? {@EOS}"),
        r(17, "MainCl", "$, KON T( SntSubCl ) {@CLAUSE}* {@EOS}?", _shared),
        # ( Z+ (KON? Z+)? )* of nodes Z that aren't conjunctions is the same as ( Z (KON? Z)? )*, without its exponential search
        r(17, "MainCl", "[[ $, KON ( !{KON MainCl FVG} ( KON !{KON MainCl FVG} )? )* FVG @X* ( {@CLAUSE} ( $, {@CLAUSE} )* @X* )* PTKVZ? IVG? @TR? ( {@CLAUSE} ( $, {@CLAUSE} )* )? ]] $,"),
        r(17, "MainCl", "[[ ( ^ KON )? ( !{KON MainCl IVG} ( KON !{KON MainCl IVG} )? )* IVG @X* ( {@CLAUSE} $, @X* )* PTKVZ? {@PUNCT} ]] AC"),
        r(17, "MainCl", "^ ( NE+ ( $, | $( )? )? T( SntSubCl ) {@CLAUSE}+ $.?", _shared),
        r(
            18, "MainCl",
            "( ^ KON )? ( !{KON MainCl FVG @DASH @PUNCT} ( KON !{KON MainCl FVG} )? )* V( FVG ) @X* ( {@CLAUSE} {@PUNCT}? )* @X* "
            "P( PTKVZ )? I( IVG | FVG {@PUNCT} )? ( {@DASH @PUNCT} ( !{@VG @DASH @PUNCT}+ ( $ | {@DASH @PUNCT} ) )? )? {@EOS}?",
            _main_verb,
        ),
        r(19, "MainCl", "T( MainCl ) ( {KON $,} MainCl )+", _shared),
        r(20, "MainCl", "MainCl [[ ( @Y | @Y $, )+ {@EOS} ]]", _verbless),
        r(21, "ANY", "!{MainCl SntSubCl}+"),
    ]
    return rules


def category(token: dict) -> str:
    """A delimiter's name, else the tag."""
    return lexicon.DELIMITERS.get(token["form"], token["pos"])


@cache
def chunker() -> Cascade:
    return Cascade(chunk_rules(), MACROS)


@cache
def clauses() -> Cascade:
    return Cascade(clause_rules(), MACROS, category)


def retag(token: dict) -> dict:
    """Forms of the closed list of finite verbs get a finite verb's tag, whatever the tagger said."""
    kind = _FINITE.get(token["form"])
    return token if kind is None else token | {"pos": f"V{kind}FIN"}


def _splice(node: Node, labels: frozenset) -> None:
    flat = []
    for child in node.children:
        if isinstance(child, Node):
            _splice(child, labels)
        flat += child.children if isinstance(child, Node) and child.label in labels else [child]
    node.children = flat


def clause_tree(sentence: list[dict]) -> Node:
    """Clauses of a sentence; noun and adverb chunks and verb groups are opened again."""
    chunks = chunker().parse([retag(t) for t in sentence])
    tree = clauses().parse(chunks.children)
    _splice(tree, frozenset(("AC", "NC", "FVG", "IVG")))
    return tree
