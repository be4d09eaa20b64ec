"""Morphological features as maps and as bits that unify."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE, NUMBER, GENDER = ("nom", "acc", "dat", "gen"), ("sg", "pl"), ("masc", "fem", "neut")
#: Closed sets of values that stand without their feature's name.
VALUES = {
    **dict.fromkeys(CASE, "case"), **dict.fromkeys(GENDER, "gender"), **dict.fromkeys(NUMBER, "num"),
    **dict.fromkeys("123", "pers"), **dict.fromkeys(("ind", "subj", "imp"), "mood"), **dict.fromkeys(("pres", "past"), "tense"),
}
_BITS = {v: 1 << k for k, v in enumerate((*CASE, *NUMBER, *GENDER))}
CASE_MASK, NUMBER_MASK, GENDER_MASK = 0b1111, 0b11 << 4, 0b111 << 6


def parse_features(text: str | None) -> dict[str, str]:
    """Features of value|value (lower-cased) or name=value|name=value; "_" has none; unknown values are their own name."""
    found = {}
    for part in (text or "_").split("|"):
        part = part.strip(" ")
        if not part or part == "_":
            continue
        name, sep, value = part.partition("=")
        if sep:
            found[name] = value
        else:
            part = part.lower()
            found[VALUES.get(part, part)] = part if part in VALUES else "True"
    return found


def feature_bits(feats: dict[str, str] | None) -> int:
    """Four bits of case, two of number, three of gender; a feature that isn't given allows all of its values."""
    feats = feats or {}
    bits = sum({_BITS[v] for v in (feats.get("case"), feats.get("num"), feats.get("gender")) if v in _BITS})
    for mask in (CASE_MASK, NUMBER_MASK, GENDER_MASK):
        bits |= 0 if bits & mask else mask
    return bits


def unifies(a: int, b: int) -> bool:
    return all(a & b & m for m in (CASE_MASK, NUMBER_MASK, GENDER_MASK))


def _by_text(text: pa.Array, kind: pa.DataType, made: Callable[[str], object]) -> pa.Array:
    """made of each different text once; a null one is as "_"."""
    one = pc.dictionary_encode(pc.fill_null(text, "_"))
    return pa.array([made(t) for t in one.dictionary.to_pylist()], kind).take(one.indices)


def features_column(text: Column) -> Column:
    """parse_features() as a map column; of a repeated name the last value counts."""

    def run(texts: pa.Array) -> pa.Array:
        return _by_text(texts, pa.map_(pa.string(), pa.string()), lambda t: list(parse_features(t).items()))

    return F.arrow_udf(run, "map<string,string>")(text)


def text_bits(text: Column) -> Column:
    """feature_bits() of features that stand as text."""

    def run(texts: pa.Array) -> pa.Array:
        return _by_text(texts, pa.int32(), lambda t: feature_bits(parse_features(t)))

    return F.arrow_udf(run, "int")(text)


def once(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, the column computed once for all that is made of it: the optimizer merges projections, but not into explode()."""
    return rows.withColumn(name, F.explode(F.array(name)))


def bits_column(feats: Column) -> Column:
    """feature_bits() of a map column."""
    bits = F.create_map(*(F.lit(x) for kv in _BITS.items() for x in kv))
    groups = [("case", CASE, CASE_MASK), ("num", NUMBER, NUMBER_MASK), ("gender", GENDER, GENDER_MASK)]
    parts = []
    for name, values, mask in groups:
        value = F.try_element_at(feats, F.lit(name))
        parts.append(F.when(value.isin(*values), F.try_element_at(bits, value)).otherwise(mask))
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def unifies_column(a: Column, b: Column) -> Column:
    both = a.bitwiseAND(b)
    return (both.bitwiseAND(CASE_MASK) != 0) & (both.bitwiseAND(NUMBER_MASK) != 0) & (both.bitwiseAND(GENDER_MASK) != 0)
