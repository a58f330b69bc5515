"""Scalar helpers over columns: safe division, keyed draws, state encodings, sequence composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a, b) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), F.col(b).cast("double") if isinstance(b, str) else b.cast("double"))


def has_flag(column: str, mask: int) -> Column:
    return F.col(column).cast("long").bitwiseAND(F.lit(mask)) != 0


def draw(*key) -> Column:
    """A 32-bit number from SHA-256 of the key parts joined by '|': the same in any engine."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def draw_order(*key) -> Column:
    """The whole digest, for random orders without ties."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.sha2(F.concat_ws("|", *parts), 256)


def call_state(p_one: str, p_two: str, least: float = 0.8) -> Column:
    """0, 1 or 2 for the largest of (rest, one, two), ties to the lower; null below ``least``."""
    rest = F.greatest(F.lit(0.0), 1.0 - F.col(p_one) - F.col(p_two))
    best = F.greatest(rest, F.col(p_one), F.col(p_two))
    state = F.when(rest >= best, 0).when(F.col(p_one) >= best, 1).otherwise(2)
    return F.when(best >= least, state)


def encode(state: str, kind: str) -> Column:
    """Binary encoding of a state: 'two' (== 2), 'one' (== 1) or 'any' (> 0); a missing state stays missing."""
    value = {"two": F.col(state) == 2, "one": F.col(state) == 1, "any": F.col(state) > 0}[kind]
    return F.when(F.col(state).isNull() | (F.col(state) < 0), None).otherwise(value.cast("int"))


def fraction_of(sequence: str, letters: str = "GC") -> Column:
    """Share of ``letters`` in a sequence, ignoring case; null for an empty one."""
    kept = F.regexp_replace(F.upper(sequence), f"[^{letters}]", "")
    return safe_divide(F.length(kept), F.length(sequence))


def marker_allowed(sequence: str, place: str, flank: int = 5, run: int = 4) -> Column:
    """Base in ACGT, not in a CG, and no run of ``run`` equal bases within ``flank`` (place is 0-based)."""
    s, i = F.upper(F.col(sequence)), F.col(place)
    base = s.substr(i + 1, F.lit(1))
    after = s.substr(i + 2, F.lit(1))
    before = F.when(i > 0, s.substr(i, F.lit(1))).otherwise(F.lit(""))
    around = s.substr(F.greatest(i - flank, F.lit(0)) + 1, i + flank + 1 - F.greatest(i - flank, F.lit(0)))
    runs = "|".join(x * run for x in "ACGT")
    in_pair = ((base == "C") & (after == "G")) | ((base == "G") & (before == "C"))
    return base.isin(*"ACGT") & ~in_pair & ~around.rlike(runs)


def flank_bin(upstream: str, downstream: str) -> Column:
    """0, 1 or 2 for 0-1, 2 and 3-4 G or C among the two bases on each side of a site."""
    n = F.length(F.regexp_replace(F.upper(F.concat(upstream, downstream)), "[^GC]", ""))
    return F.when(n <= 1, 0).when(n == 2, 1).otherwise(2)


def parse_missing(column: str, spellings: tuple[str, ...] = ("", "None", "NA", "nan", "NaN", "null")) -> Column:
    """Text with every spelling of a missing value as null."""
    return F.when(F.trim(column).isin(*spellings), None).otherwise(F.col(column))


def parse_flag(column: str) -> Column:
    """'True' / 'False' text to boolean, anything else null."""
    return F.when(F.col(column) == "True", True).when(F.col(column) == "False", False)


def age_from_linear(eta: Column, adult: float = 20.0) -> Column:
    """Years from a linear score: exponential below 0, linear above."""
    return F.when(eta < 0, (adult + 1) * F.exp(eta) - 1).otherwise((adult + 1) * eta + adult)
