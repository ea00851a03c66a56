"""Quantities recorded in different units: stated amounts in base units, and units inferred where none is stated.

Amounts are read by a small grammar (numbers, unit spellings, sums, ranges, containers) in Arrow-batched
Python, as no built-in can express it; factors come from a unit table. Where a number has no unit,
``infer_units`` fits, per subject, a mixture on the log scale whose components are offset by the known
conversion factors, and assigns units by posterior, flagging what stays uncertain.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.words import marks, unescape
from larder.session import Scratch

#: Largest unit table that is sent to the tasks; a larger one is an error, not a slow path.
MAX_UNITS = 10_000

# Number words.
NUMBER_WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8,
    "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13, "quatorze": 14, "catorze": 14, "quinze": 15,
    "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30, "quarenta": 40,
    "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100,
    "duzentos": 200, "duzentas": 200, "trezentos": 300, "trezentas": 300, "quatrocentos": 400, "quatrocentas": 400,
    "quinhentos": 500, "quinhentas": 500,
}
# Fractions of one character.
FRACTIONS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5",
             "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
# Spellings of units (folded text), by unit code.
_OPEN, _OF = r"[\s./]*\(?\s*(?:das?|de)?\s*", r"\s*\)?"
SPELLINGS = {
    "mg": r"mgs?|miligramas?|mgr", "kg": r"kgs?|quilogramas?|kilogramas?|quilos?|kilos?|kgr", "g": r"grs?|gramas?|gms?|g",
    "oz": r"ozs?|oncas?", "lb": r"lbs?|libras?",
    "ml": r"mls?|mililitros?", "dl": r"dls?|decilitros?", "cl": r"cls?|centilitros?", "l": r"lts?|litros?|l",
    "coffee_cup": rf"(?:xicaras?|xics?|chavenas?){_OPEN}cafe{_OF}", "cup": rf"(?:xicaras?|xics?|chavenas?)(?:{_OPEN}cha{_OF})?",
    "tbsp": rf"(?:colher(?:es)?|cols?|c){_OPEN}(?:sopa|sp){_OF}|cs(?![a-z])", "dsp": rf"(?:colher(?:es)?|cols?|c){_OPEN}(?:sobremesa|sob){_OF}",
    "tsp": rf"(?:colher(?:es)?|colherinhas?|cols?|c){_OPEN}cha{_OF}", "coffee_sp": rf"(?:colher(?:es)?|colherinhas?|cols?|c){_OPEN}cafe{_OF}",
    "glass": rf"copos?(?:{_OPEN}americanos?{_OF})?",
    "s": r"segundos?|segs?|s", "min": r"minutos?|mins?|m|'", "h": r"horas?|hrs?|hs?", "d": r"dias?|d",
}
KITCHEN = ("mg", "kg", "g", "oz", "lb", "ml", "dl", "cl", "coffee_cup", "cup", "tbsp", "dsp", "tsp", "coffee_sp", "glass", "l")
TIME = ("s", "min", "h", "d")

_WORD = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_DIGITS = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?(?!\d)|\d+[.,]\d+|\d+"
_NUMBER = rf"(?:\d+\s*(?:e\s+)?\d+/\d+(?!\d)|\d+/\d+|(?:{_DIGITS})|mei[ao](?![a-z])|(?:{_WORD})(?:\s+e\s+(?:{_WORD}))*(?![a-z]))"


def _unit(codes: tuple[str, ...]) -> str:
    return "(?:" + "|".join(f"(?P<{{p}}{c}>{SPELLINGS[c]})" for c in codes) + r")(?![a-z0-9])\.?"


def _value(text: str) -> Fraction:
    """The exact value of one number as matched by ``_NUMBER``."""
    text = text.strip()
    if m := re.fullmatch(r"(?:(\d+)\s*(?:e\s+)?\s)?(\d+)/(\d+)", text) or re.fullmatch(r"(\d+)\s*(?:e\s+)?(\d+)/(\d+)", text):
        whole, top, bottom = m.groups()
        return Fraction(int(whole or 0)) + (Fraction(int(top), int(bottom)) if int(bottom) else 0)
    if text in ("meia", "meio"):
        return Fraction(1, 2)
    if text[0].isdigit():
        if re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?", text):
            text = text.replace(".", "")
        return Fraction(text.replace(",", "."))
    return Fraction(sum(NUMBER_WORDS[w] for w in re.findall(r"[a-z]+", text) if w != "e"))


def fold_amounts(text: str | None) -> str:
    """Lower case without accents, entities decoded, fractions as ``a/b``, dashes as ``-``, single spaces."""
    text = unescape(text or "")
    for sign, plain in FRACTIONS.items():
        if sign in text:
            text = text.replace(sign, f" {plain} ")
    text = unicodedata.normalize("NFKD", text.casefold())
    if not text.isascii():
        text = marks().sub("", text).replace("⁄", "/")
        text = re.sub("[‐-―−]", "-", text).replace("×", "x").replace("​", "").replace("﻿", "")
    text = re.sub(r"(?<=\d)\s*/\s*(?=\d)", "/", text)
    return " ".join(text.split())


_JOIN = r"\s*(?:-|a|ate|ou|e|/)\s*"
_ABOUT = r"(?:(?:aprox(?:\.|imadamente)?|cerca\s+de|mais\s+ou\s+menos|uns|umas|quase|por\s+volta\s+de|ate|\+/?-|±|~|c\.\s*de)\s*)*"
_kitchen = re.compile(
    rf"(?<![\w.,/°-])(?:(?P<times>{_NUMBER})\s*(?:x|vezes)\s*)?(?P<n>{_NUMBER})(?:\s*(?:-|a|ate|ou)\s*(?P<hi>{_NUMBER}))?\s*(?:de\s+)?{_unit(KITCHEN).replace('{p}', 'u_')}(?P<half>\s+e\s+mei[ao](?![a-z]))?")
_PACK = (r"(?:latas?|latinhas?|pacotes?|pacotinhos?|caixas?|caixinhas?|garrafas?|garrafinhas?|potes?|potinhos?|vidros?|saquinhos?|sacos?|saches?|"
         r"envelopes?|tabletes?|barras?|bisnagas?|embalagens|embalagem|frascos?|copinhos?|bandejas?|unidades?|cubos?|pedacos?|files?|postas?|bifes?|tubos?|pecas?|porcoes|porcao|fatias?|macos?)")
_pack = re.compile(rf"(?<![\w.,/])(?P<k>{_NUMBER})(?:\s*(?:-|a|ate|ou)\s*{_NUMBER})?\s+(?P<what>[a-z]+)\s*(?P<link>\(|de|com|c/|-|:|,|contendo)?\s*(?:de\s+|com\s+)?{_ABOUT}$")
_each = re.compile(r"^\s*\)?\s*(?:cada|por\s+unidade|/\s*un|each)")
_then = re.compile(rf"^\s*(?:\+|e|mais|,\s*mais)\s+{_ABOUT}")
_HALF = Fraction(1, 2)


def _which(m: re.Match, prefix: str, codes: tuple[str, ...]) -> str:
    return next(c for c in codes if m.group(prefix + c))


def _rounded(x: Fraction) -> int:
    return math.floor(x + _HALF)


def kitchen_amount(text: str | None, factors: dict[str, tuple[str, Fraction]]) -> tuple[str, int] | None:
    """The mass or volume a line states, as (base unit, whole number), or None.

    The first stated measure counts; measures of the same dimension added to it ("3 kg e 400 g") are
    summed; of a range the lower end counts; "k containers of n" and "k x n" count in total.
    """
    line = fold_amounts(text)
    m = _kitchen.search(line)
    while m and _no_amount(line, m):
        m = _kitchen.search(line, m.end())
    if not m:
        return None
    base, total = _measure(m, factors)
    if base is None:
        return None
    if m.group("times"):
        total *= _value(m.group("times"))
    elif (k := _pack.search(line[: m.start()])) and re.fullmatch(_PACK, k.group("what")):
        total *= _value(k.group("k"))
    elif _each.match(line[m.end():]) and (k := re.match(rf"\D*?(?P<k>{_NUMBER})\s", line[: m.start()])):
        total *= _value(k.group("k"))
    end = m.end()
    while more := _then.match(line[end:]):
        nxt = _kitchen.match(line, end + more.end())
        if not nxt:
            break
        base2, amount = _measure(nxt, factors)
        if base2 != base:
            break
        total, end = total + amount, nxt.end()
    return base, _rounded(total)


def _no_amount(line: str, m: re.Match) -> bool:
    """A match that is not a measure: a temperature, or part of a longer token."""
    return bool(re.match(r"\s*[°º%]", line[m.end("n"):])) or line[: m.start()].endswith(("tipo ", "n ", "no ", "numero "))


def _measure(m: re.Match, factors: dict[str, tuple[str, Fraction]]) -> tuple[str | None, Fraction]:
    code = _which(m, "u_", KITCHEN)
    if code not in factors:
        return None, Fraction(0)
    base, factor = factors[code]
    n = _value(m.group("n"))
    if m.group("hi"):
        n = min(n, _value(m.group("hi")))
    if m.group("half"):
        n += _HALF
    return base, n * factor


_iso = re.compile(r"\s*p(?:(\d+)d)?(?:t(?:(\d+(?:[.,]\d+)?)h)?(?:(\d+(?:[.,]\d+)?)m)?(?:(\d+(?:[.,]\d+)?)s)?)?\s*")
_clock = re.compile(r"(?<![\d:])(\d{1,3}):([0-5]\d)(?::([0-5]\d))?(?![\d:])")
_time = re.compile(rf"(?<![\w.,/])(?P<n>{_NUMBER})(?:\s*(?P<u1>{SPELLINGS['h']}|{SPELLINGS['min']}|{SPELLINGS['d']})?\.?\s*(?:-|a|ate|ou)\s*(?P<hi>{_NUMBER}))?\s*(?:de\s+)?{_unit(TIME).replace('{p}', 'u_')}(?P<half>\s*e\s+mei[ao](?![a-z]))?")
_hm = re.compile(r"(?<![\w.,/])(\d+)\s*h\s*(?:e\s*)?(\d{1,2})(?![\d.,/]|\s*(?:h|s|d|seg))(?:\s*(?:minutos?|mins?|m)(?![a-z]))?")


def duration_amount(text: str | None, factors: dict[str, tuple[str, Fraction]]) -> tuple[str, int] | None:
    """The duration a text states, as (base unit, whole number), or None."""
    line = fold_amounts(text)
    unit = lambda code: factors[code][1] if code in factors else Fraction(0)
    base = next((factors[c][0] for c in TIME if c in factors), None)
    if not line or base is None:
        return None
    if (m := _iso.fullmatch(line)) and any(m.groups()):
        parts = [Fraction(x.replace(",", ".")) if x else Fraction(0) for x in m.groups()]
        return base, _rounded(sum((p * unit(c) for p, c in zip(parts, ("d", "h", "min", "s"))), Fraction(0)))
    if m := _clock.search(line):
        h, mi, s = (int(x or 0) for x in m.groups())
        return base, _rounded(h * unit("h") + mi * unit("min") + s * unit("s"))
    if (m := _hm.search(line)) and not re.search(rf"{_NUMBER}\s*d", line[: m.start()]):
        return base, _rounded(int(m.group(1)) * unit("h") + int(m.group(2)) * unit("min"))
    m = _time.search(line)
    if not m:
        return None
    total, last, end = Fraction(0), None, 0
    while m:
        code = _which(m, "u_", TIME)
        if last is not None and TIME.index(code) >= TIME.index(last):
            break
        n = _value(m.group("n"))
        if m.group("hi") and not m.group("u1"):
            n = min(n, _value(m.group("hi")))
        elif m.group("u1"):
            code = next(c for c in TIME if re.fullmatch(SPELLINGS[c], m.group("u1")))
        total += (n + (_HALF if m.group("half") else 0)) * unit(code)
        last, end = code, m.end()
        more = re.match(r"\s*(?:,|e|\+|mais)?\s*", line[end:])
        m = _time.match(line, end + more.end()) if more else None
    return base, _rounded(total)


def unit_factors(units: DataFrame) -> dict[str, tuple[str, Fraction]]:
    """unit_code -> (base unit, exact factor) of a unit table of at most ``MAX_UNITS`` rows."""
    rows = units.select("unit_code", "base_unit", "factor_to_base").where("unit_code IS NOT NULL AND factor_to_base IS NOT NULL").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units")
    return {r.unit_code: (r.base_unit, Fraction(repr(r.factor_to_base))) for r in rows}


def stated_amounts(texts: DataFrame, text: str, units: DataFrame, kind: str) -> DataFrame:
    """The rows of ``texts`` that state an amount, with ``base_unit`` and ``amount``; columns of these names are replaced.

    ``kind`` is ``kitchen`` (masses and volumes) or ``duration``. Null, empty and unitless texts have no
    row. Amounts beyond the range of a long have none either.
    """
    if kind not in ("kitchen", "duration"):
        raise ValueError(kind)
    factors = unit_factors(units)
    read = kitchen_amount if kind == "kitchen" else duration_amount

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=50_000)(lambda x: read(x, factors))
        for batch in batches:
            got = [cached(x) if isinstance(x, str) else None for x in batch]
            got = [g if g and g[1] < 2**63 else (None, None) for g in got]
            yield pd.DataFrame({"base_unit": [g[0] for g in got], "amount": pd.array([g[1] for g in got], dtype="Int64")})

    udf = F.pandas_udf(parse, "base_unit string, amount long")
    rest = [c for c in texts.columns if c not in ("base_unit", "amount")]
    out = texts.select(*rest, udf(F.col(text)).alias("_parsed"))
    return out.where(F.col("_parsed.amount").isNotNull()).select(*rest, "_parsed.base_unit", "_parsed.amount")


_bare = re.compile(rf"[^a-z0-9]*{_ABOUT}(?P<n>{_NUMBER})(?:\s*(?:-|a|ate|ou)\s*(?P<hi>{_NUMBER}))?(?![\w,./])\s*(?P<rest>.*)")
_other = re.compile(r"(?:cm|mm|m|metros?|graus?|c|f|min|mins|minutos?|horas?|hs?|dias?|segundos?|seg|x|vezes)(?![a-z])|[%°º:/]")
_noun = re.compile(r"(?<![a-z])(?!(?:das?|dos?|com|sem|para|por|uma|uns|umas|mais|que)(?![a-z]))[a-z][a-z\-]{2,}")


def _subject(*texts: str) -> str | None:
    """The first word of the texts that can name a thing, without a plural's s."""
    m = next((m for t in texts if (m := _noun.search(t))), None)
    return m.group().rstrip("s") if m else None


def bare_number(text: str | None) -> tuple[float, str | None] | None:
    """The number a line or duration begins with that has no unit, and the thing it counts or measures; of a range the lower end."""
    line = fold_amounts(text)
    m = _bare.match(line)
    if not m or _other.match(m.group("rest")):
        return None
    n = _value(m.group("n"))
    return float(min(n, _value(m.group("hi"))) if m.group("hi") else n), _subject(m.group("rest"))


def measured_thing(text: str | None) -> tuple[str, str | None] | None:
    """The unit code of the first stated measure and the thing measured."""
    line = fold_amounts(text)
    m = _kitchen.search(line)
    while m and _no_amount(line, m):
        m = _kitchen.search(line, m.end())
    return (_which(m, "u_", KITCHEN), _subject(line[m.end():], line[: m.start()])) if m else None


def duration_unit(text: str | None) -> str | None:
    """The unit code of the first stated part of a duration, null where it is written as a clock's or in the ISO form."""
    m = _time.search(fold_amounts(text))
    return _which(m, "u_", TIME) if m else None


def amounts_and_numbers(texts: DataFrame, text: str, units: DataFrame, kind: str) -> DataFrame:
    """The rows of ``texts`` that state an amount or begin with a number without a unit.

    Columns added (those of these names are replaced): ``subject``, ``unit``, ``base_unit`` and ``amount``
    where a unit is stated, else ``number``. ``kind`` is ``kitchen`` or ``duration``; durations have the
    subject ``duration``.
    """
    if kind not in ("kitchen", "duration"):
        raise ValueError(kind)
    factors = unit_factors(units)

    def read(x: str) -> tuple:
        got = kitchen_amount(x, factors) if kind == "kitchen" else duration_amount(x, factors)
        if got:
            unit, thing = measured_thing(x) or (None, None) if kind == "kitchen" else (duration_unit(x), "duration")
            return thing, unit, got[0], float(got[1]), None
        number = bare_number(x)
        return (number[1] if kind == "kitchen" else "duration", None, None, None, number[0]) if number else (None,) * 5

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=50_000)(read)
        for batch in batches:
            got = [cached(x) if isinstance(x, str) else (None,) * 5 for x in batch]
            yield pd.DataFrame(got, columns=["subject", "unit", "base_unit", "amount", "number"]).astype({"amount": "float64", "number": "float64"})

    names = ["subject", "unit", "base_unit", "amount", "number"]
    udf = F.pandas_udf(parse, "subject string, unit string, base_unit string, amount double, number double")
    rest = [c for c in texts.columns if c not in names]
    out = texts.select(*rest, udf(F.col(text)).alias("_parsed")).select(*rest, "_parsed.*")
    number, amount = (F.when(~F.isnan(c), F.col(c)) for c in ("number", "amount"))
    return out.withColumns({"number": number, "amount": amount}).where("number IS NOT NULL OR amount IS NOT NULL")


#: Pseudo-observations a subject's own shares and centres are shrunk by.
SHRINK = 5.0
#: Least share of measures whose unit is left out.
DROPPED = 1e-3


def infer_units(values: DataFrame, subject: str, value: str, stated: DataFrame, candidates: dict[str, float | tuple[str, float]], *, counts: bool = False, rounds: int = 6,
                sure: float = 0.9, min_sigma: float = 0.25) -> DataFrame:
    """Units of numbers that have none: ``(…values columns, unit, posterior, base_unit, base_amount, uncertain)``.

    ``candidates`` gives each possible unit's factor to its base, or (base, factor) where there are several
    bases. ``stated`` has ``(subject, base_amount)`` of amounts whose unit is known, and may have
    ``base_unit`` and ``unit``. On the log scale the amounts of a subject and base are normal around their
    own centre, so a bare number v is a mixture of normals at centre - log(factor), one per unit. With
    ``counts`` one more component is no measure at all: a number of pieces, normal around a centre of its
    own that no factor shifts; its unit is ``count``, its base null.

    Weights: a base's as often as it is stated for the subject, a unit's as often as it is stated for its
    base, counts' as often as the subject is counted rather than measured (all shrunk to the collection's);
    a measure lacks its unit with one probability everywhere, ``DROPPED`` at least. Expectation
    maximisation fits the counts' centre, spread and shares, that probability and the subjects' centres; each
    round is a join with one row per subject and a partially combined aggregation. A row gets its most
    probable component (ties: count, then the smaller factor) and is ``uncertain`` below ``sure`` or
    without a subject. Values that are null or not positive give a null unit, posterior 0, uncertain
    true. Without any stated amount of a base its centre comes from the bare numbers.
    """
    scratch = Scratch(values.sparkSession)
    added = ("unit", "posterior", "base_unit", "base_amount", "uncertain")
    own = [c for c in values.columns if c not in (*added, "_row")]
    pairs = {u: f if isinstance(f, tuple) else ("", float(f)) for u, f in candidates.items()}
    names = sorted(pairs, key=lambda u: (pairs[u][1], u))
    bases = sorted({b for b, _ in pairs.values()})
    at = {b: i for i, b in enumerate(bases)}
    bare = scratch.save(values.select(*own).withColumn("_row", F.monotonically_increasing_id()))
    x = bare.where(F.col(value) > 0).select("_row", F.coalesce(F.col(subject), F.lit("")).alias("s"), F.log(F.col(value).cast("double")).alias("x"))
    base_of = F.col("base_unit") if "base_unit" in stated.columns else F.lit(bases[0])
    unit_of = F.col("unit") if "unit" in stated.columns else F.lit(None).cast("string")
    said = stated.where(F.col("base_amount") > 0).select(F.coalesce(F.col(subject), F.lit("")).alias("s"), base_of.alias("b"), unit_of.alias("u"), F.log(F.col("base_amount").cast("double")).alias("y"))
    said = scratch.save(said.where(F.col("b").isin(bases)).groupBy("s", "b", "u").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")))
    per = said.groupBy("s", "b").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    known = scratch.save(per)
    whole = {r.b: r for r in known.groupBy("b").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")).alias("within")).collect()}
    used = {r.u: r.n for r in said.where(F.col("u").isin(names)).groupBy("u").agg(F.sum("n").alias("n")).collect()}
    mean_x = float(x.agg(F.avg("x")).first()[0] or 0.0)
    mu, sigma, share, total = {}, {}, {}, sum(r.n for r in whole.values())
    for b in bases:
        mine = [u for u in names if pairs[u][0] == b]
        r = whole.get(b)
        mu[b] = r.sy / r.n if r else mean_x + math.log(pairs[mine[len(mine) // 2]][1])
        sigma[b] = max(min_sigma, math.sqrt(max(0.0, r.within / r.n))) if r and r.n > 1 else 1.0
        share[b] = ((r.n if r else 0) + 1) / (total + len(bases))
    weight = {u: (used.get(u, 0) + 1) / (sum(used.get(v, 0) + 1 for v in names if pairs[v][0] == pairs[u][0])) for u in names}
    pieces, spread, portion, dropped = math.log(2.0), 1.0, 0.5 if counts else 0.0, 0.05
    about = known.groupBy("s").agg(*[F.sum(F.when(F.col("b") == b, F.col(c)).otherwise(0.0)).alias(f"{c}{i}") for b, i in at.items() for c in ("n", "sy")])
    about = scratch.save(about.withColumns({f"m{i}": F.col(f"n{i}") for i in at.values()} | {"pieces": F.lit(0.0), "bare": F.lit(0.0)}))

    def components() -> tuple[DataFrame, list[Column]]:
        """Rows with what is known of their subject, and the log weight and density of each component, counts' first."""
        rows = x.join(about, "s", "left").fillna(0.0)
        measured = sum((F.col(f"m{i}") for i in at.values()), F.lit(0.0))
        counted = (F.col("pieces") + SHRINK * portion) / (F.col("pieces") + measured + SHRINK)
        of_pieces = counted / (counted + (1 - counted) * dropped)
        logs = [F.log(of_pieces) - math.log(spread) - F.pow((F.col("x") - pieces) / spread, 2) / 2] if counts else []
        for u in names:
            b, f = pairs[u]
            i = at[b]
            centre = (F.col(f"sy{i}") + mu[b]) / (F.col(f"n{i}") + 1.0)
            of_base = (F.col(f"m{i}") + SHRINK * share[b]) / (measured + SHRINK)
            logs.append(F.log((1 - of_pieces if counts else F.lit(1.0)) * of_base * weight[u]) - math.log(sigma[b]) - F.pow((F.col("x") + math.log(f) - centre) / sigma[b], 2) / 2)
        return rows, logs

    for _ in range(rounds):
        rows, logs = components()
        rows = rows.select("s", "x", F.array(*logs).alias("logs")).withColumn("peak", F.array_max("logs"))
        rows = rows.select("s", "x", F.transform("logs", lambda v: F.exp(v - F.col("peak"))).alias("e"))
        z = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
        rows = rows.select("s", "x", F.transform("e", lambda v: v / z).alias("r"))
        resp = lambda j: F.get("r", F.lit(j))
        first = 1 if counts else 0
        sums = [F.count("*").cast("double").alias("bare")]
        for b, i in at.items():
            mine = [(j + first, math.log(pairs[u][1])) for j, u in enumerate(names) if pairs[u][0] == b]
            sums.append(F.sum(sum((resp(j) for j, _ in mine), F.lit(0.0))).alias(f"rn{i}"))
            sums.append(F.sum(sum((resp(j) * (F.col("x") + f) for j, f in mine), F.lit(0.0))).alias(f"ry{i}"))
        piece = resp(0) if counts else F.lit(0.0)
        sums += [F.sum(piece).alias("pieces"), F.sum(piece * F.col("x")).alias("px"), F.sum(piece * F.col("x") * F.col("x")).alias("pxx")]
        each = scratch.save(rows.groupBy("s").agg(*sums))
        tot = each.agg(*[F.sum(c) for c in ("bare", "pieces", "px", "pxx")]).first()
        if not tot[0]:
            break
        if counts:
            portion = min(1 - 1e-6, max(1e-6, tot[1] / (tot[0] + total)))
            dropped = min(0.5, max(DROPPED, (tot[0] - tot[1]) / (tot[0] - tot[1] + total))) if total else 0.5
            if tot[1] > 1:
                pieces = tot[2] / tot[1]
                spread = max(0.3, math.sqrt(max(0.0, tot[3] / tot[1] - pieces * pieces)))
        stated_of = known.groupBy("s").agg(*[F.sum(F.when(F.col("b") == b, F.col(c)).otherwise(0.0)).alias(f"k{c}{i}") for b, i in at.items() for c in ("n", "sy")])
        both = stated_of.join(each, "s", "full").fillna(0.0)
        about = scratch.save(both.select("s", "pieces", "bare", *[c for i in at.values() for c in (
            F.col(f"kn{i}").alias(f"m{i}"), (F.col(f"kn{i}") + F.col(f"rn{i}")).alias(f"n{i}"), (F.col(f"ksy{i}") + F.col(f"ry{i}")).alias(f"sy{i}"))]))
    rows, logs = components()
    labels = (["count"] if counts else []) + names
    best = F.array_max(F.array(*[F.struct(l.alias("l"), F.lit(-j).alias("j")) for j, l in enumerate(logs)]))
    rows = rows.withColumns({"logs": F.array(*logs), "best": best})
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("best.l")))
    pick = lambda vals, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in vals]), -F.col("best.j"))
    base_names = ([None] if counts else []) + [pairs[u][0] or None for u in names]
    named = rows.select("_row", pick(labels, "string").alias("unit"), posterior.alias("posterior"), pick(base_names, "string").alias("base_unit"),
                        pick(([None] if counts else []) + [pairs[u][1] for u in names], "double").alias("_f"))
    out = bare.join(named, "_row", "left")
    p = F.coalesce("posterior", F.lit(0.0))
    return out.select(*own, "unit", F.round(p, 6).alias("posterior"), "base_unit", (F.col(value) * F.col("_f")).alias("base_amount"), ((p < sure) | F.col(subject).isNull()).alias("uncertain"))
