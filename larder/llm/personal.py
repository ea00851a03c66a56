"""Personal information in free text: bootstrapped contextual extraction.

1. Every text is read once. E-mail addresses are told by their shape. Numbers of 8 to 14 digits, phrases that
   end (English: begin) in a house number and sequences of words of one case are candidates, each with
   the up to three tokens before it: its lexical patterns. Some candidates are seeds: numbers written as
   telephones or document numbers, streets with an unmistakable street word, listed given names.
2. Spark scores the graph of patterns and instances iteratively: a pattern is as good as its distinct
   instances, an instance that is no seed as the patterns it occurs in. Distinct instances are counted,
   so copies of a text are harmless; a pattern no seed ever follows scores 0 and lends nothing.
3. A candidate is what its longest well-supported pattern says. So names in no list, numbers in no
   telling shape and places without a street word are found behind confident patterns, and seeds in a
   place that many different instances show to be another one's ("Receita nº") are left out.

A name ends at words the corpus mostly uses in ordinary places. Work is linear in the length of a text,
and no group of unknown size is gathered.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.words import fold
from larder.session import Scratch

#: Largest list of given names that is sent to the tasks; a larger one is an error.
MAX_SEEDS = 100_000
#: Characters before a candidate its patterns are taken from.
REACH = 160
KINDS = ("PHONE", "ID", "ADDRESS")

# Words of street names, unmistakable and others, and titles inside street names.
STREETS = (r"rua|av\.|avenida|avda\.?|travessa|trav\.|tv\.|alameda|praça|praca|pça\.?|pca\.?|rodovia|rod\.|estrada|estr\.|largo|ladeira|beco|"
           r"calle|plaza|pza\.?|paseo|carretera|ctra\.?|glorieta|travesía|travesia")
STREETS_WEAK = r"r\.|av|al\.|rod|lgo\.|via|viela|quadra|c/|cl\.|pº|camino|carrera|ronda|bulevar"
STREETS_LAST = r"street|road|lane|avenue|st\.|st|rd\.|rd|ln\.|ln|ave\.|ave|blvd\.?"
STREETS_LAST_WEAK = r"drive|close|court|place|way|square|terrace|crescent|gardens|grove|boulevard|hill|row|mews|park|dr\.|ct\.|sq\."
TITLES = r"doutora?|dra?\.?|prof\.?ª?|professora?|cel\.?|coronel|padre|pe\.|frei|dom|dona|gen\.?|general|cap\.?|capitão|capitao|eng\.?|sta\.?|sto\.?|santa|santo|são|sao|sr\.?|sra\.?|alm\.?|mal\.?|ten\.?|sgto\.?|pres\.?|presidente|vereador|san"
TITLE_WORDS = frozenset(("dona", "dom", "seu", "chef", "sr", "sra", "srta", "doutor", "doutora", "dr", "dra", "prof", "professor", "professora", "padre", "frei", "tia", "tio",
                         "vovo", "mr", "mrs", "ms", "miss", "don", "senor", "senora", "senhor", "senhora", "cel", "coronel", "eng"))
PARTICLES = frozenset(("de", "da", "do", "das", "dos", "del", "la", "las", "los", "e", "y", "di", "du", "van", "von"))

_upper = [c for c in range(sys.maxunicode + 1) if chr(c).isupper()]
_runs = [(a, b) for a, b in zip([c for i, c in enumerate(_upper) if not i or _upper[i - 1] != c - 1], [c for i, c in enumerate(_upper) if i + 1 == len(_upper) or _upper[i + 1] != c + 1])]
_CAPITAL = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in _runs)
_ACCENT = r"(?:acute|grave|circ|tilde|uml|cedil);"
_LETTERS = rf"(?:[^\W\d_]++|[̀-ͯ]++|&[A-Za-z]{_ACCENT})++"
_WORD = rf"(?:{_LETTERS}(?:['’\-]{_LETTERS})*+)"
_GAP = r"[    \t]{1,3}"
_SMALL = rf"(?i:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}){_GAP}"

_EMAIL = re.compile(
    r"[\w](?:[\w.+\-]*[\w])?"
    r"(?:@|＠|&#0*64;|&#x0*40;|&commat;|\s?[\[({<]\s?(?:at|arroba|em|en|@)\s?[\])}>]\s?|\sarroba\s|[    \t]@[    \t]|\sat\s(?=[\w\-]+\sdot\s))"
    r"[\w\-]+(?:(?:\.|&#0*46;|&period;|\s?[\[({]\s?(?:dot|ponto|punto|\.)\s?[\])}]\s?|\s(?:dot|ponto|punto)\s)[\w\-]+)+", re.I)
_AT = re.compile(r"[@＠&\[({<aA](?:(?<=[@＠])|(?<=&)(?i:#0*64|#x0*40|commat);|(?<=[\[({<])\s?(?i:at|em|en)\s?[\])}>]|(?i:(?<=a)rroba)|(?i:(?<=\sa)t\s))")
_STREET = re.compile(
    rf"(?<![\w@./\-])(?:(?P<strong>{STREETS})|{STREETS_WEAK})(?:(?<=[./])|(?=[    \t]))[    \t]{{0,2}}(?:\d{{1,2}}{_GAP}d[eao]s?{_GAP})?(?:(?:{TITLES}|{_WORD}){_GAP}){{0,7}}?{_WORD},?[    \t]{{0,2}}"
    rf"(?:(?:n\.?[ºo°]?|nº|n°|núm\.?|num\.?|número|numero|nro\.?|no\.)[    \t]{{0,2}})?(?P<house>\d{{1,5}})(?!\d|[.,:]\d|/\d)(?:[    \t]?-?[A-Za-z](?!\w|\.\w|[̀-ͯ]))?", re.I)
_STREET_EN = re.compile(rf"\d{{1,5}}(?:-?[A-Za-z](?!\w))?{_GAP}(?:{_WORD}{_GAP}){{1,3}}?(?:(?P<strong>{STREETS_LAST})|{STREETS_LAST_WEAK})(?!\w)", re.I)
_PLACE = re.compile(rf"(?<!\w)[{_CAPITAL}](?:{_LETTERS})?(?:{_GAP}(?:{_SMALL})?[{_CAPITAL}](?:{_LETTERS})?)+,?[    \t]{{0,2}}(?:n(?:\.|\.?[º°])[    \t]{{0,2}})?(?P<house>\d{{1,5}})(?![\d%°]|[ .,:/\-]\d)(?:-?[A-Za-z](?!\w))?")
_URL = re.compile(r"(?<![\w@.])(?:https?://|www\.)\S+", re.I)
_DATE = re.compile(r"(?<![\d.\-/])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2}))(?![\d\-/]|\.\d)")
_NUMBER = re.compile(r"(?<![\w.,/+\-(])(?:\+|\(\+?)?\d(?:[  .\-]?\(?\d|\)[  \-.]{0,2}\d|[    \t]\(\d)*(?:-?[A-Za-z](?![\w]))?(?![\w/]|[.,]\d)")
_CODED = re.compile(r"(?<![\w.\-/])(?:[A-Za-z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-Da-d]|[XYZxyz]-?\d{7}-?[A-Za-z]|\d{3}-\d{2}-\d{4})(?![\w\-])")
_ID_SEED = re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{1,2}\.\d{3}\.\d{3}-[\dXx]|\d{8}-?[A-Za-z]|\d{2}\.\d{3}\.\d{3}-?[A-Za-z]")
_PHONE_SEED = re.compile(r"\+[\d (].*|\(\d{2,5}\).*|\d{2,3}[ .]\d{4,5}-\d{4}|9\d{4}-\d{4}|\d{3}-\d{3}-\d{4}|0034\d{9}")
_HANDLE = re.compile(r"@(?<!\w.)[\w.]*\w")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(rf"{_WORD}|\d+|\n|[^\w\s]")
_PLAIN = re.compile(r"[^\W\d_]+")
_OPENING = re.compile(r"[.!?…\n]\s*([^\W\d_]+)")
_HEAD = re.compile(rf"[{_CAPITAL}&](?<!\w.)(?:(?<=&)[A-Z]{_ACCENT})?(?:{_LETTERS})?(?:['’\-]{_LETTERS})*+(?=\.?,?{_GAP}(?:{_SMALL}){{0,2}}[{_CAPITAL}&])")
_STEP = re.compile(rf"(?P<comma>,?){_GAP}(?P<small>(?:{_SMALL}){{0,2}})(?:[{_CAPITAL}](?:\.{_GAP}?|{_GAP})){{0,2}}(?P<word>{_WORD})")
_ENDS = frozenset(".!?\n…")
_folds: dict[str, str] = {}


def _folded(word: str) -> str:
    """``fold`` of one word, remembered; ordinals ("nº") stay apart from the words they would become."""
    got = _folds.get(word)
    if got is None:
        if len(_folds) > 500_000:
            _folds.clear()
        got = _folds[word] = word.lower() if "º" in word or "ª" in word else fold(word)
    return got


def _case(word: str) -> str:
    """``T`` first letter capital, ``U`` all capital, ``l`` lower."""
    bare = re.sub(r"&([A-Za-z])[a-z]+;", r"\1", word) if "&" in word else word
    if bare.isupper() and len(bare) > 1:
        return "U"
    return "T" if bare[:1].isupper() else "l"


class _Taken:
    """Disjoint intervals in order of their starts."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []

    def add(self, kind: str, a: int, b: int) -> bool:
        """Takes the interval unless it overlaps one."""
        i = bisect_right(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        self.kinds.insert(i, kind)
        return True

    def free(self, a: int) -> bool:
        i = bisect_right(self.starts, a)
        return not i or self.ends[i - 1] <= a


def _emails(text: str, taken: _Taken) -> None:
    for at in _AT.finditer(text):
        p = at.start()
        i = p
        while i and p - i < 3 and (text[i - 1].isspace() or text[i - 1] in "[({<"):
            i -= 1
        j = i
        while j and (text[j - 1].isalnum() or text[j - 1] in "_.+-"):
            j -= 1
        while j < i and text[j] in ".+-":
            j += 1
        if j < i and (m := _EMAIL.match(text, j)) and m.end() > p:
            taken.add("EMAIL", j, m.end())


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Seeds as (kind, start, end), and undecided candidates: ``NUMBER``, ``STREET`` (street word that may be another), ``PLACE`` (words and a house number)."""
    taken = marked(text)
    every = list(zip(taken.kinds, taken.starts, taken.ends))
    return [x for x in every if x[0] in ("EMAIL", *KINDS)], [x for x in every if x[0] in ("NUMBER", "STREET", "PLACE")]


def marked(text: str) -> _Taken:
    """Places of seeds and undecided candidates, and under no kind those of URLs, account handles and dates."""
    taken = _Taken()
    if "://" in text or "www." in text or "WWW." in text:
        for m in _URL.finditer(text):
            taken.add("", *m.span())
    _emails(text, taken)
    if "@" in text:
        for m in _HANDLE.finditer(text):
            taken.add("", *m.span())
    runs = [m.span() for m in _DIGITS.finditer(text)]
    before = [0, 0]  # ends of the last two runs of digits
    for a, b in runs:
        if b - a <= 5 and taken.free(a):
            _house(text, a, b, before, taken)
        before = [before[1], b]
    done = 0
    for a, b in runs:
        if a < done or not taken.free(a):
            continue
        if a and (text[a - 1].isalpha() or text[a - 1] in " -" and text[a - 2 : a - 1].isalpha()) or b - a == 3:
            coded = next((m for s in range(max(0, a - 3), a + 1) if (m := _CODED.match(text, s))), None)
            if coded and taken.add("ID", *coded.span()):
                done = coded.end()
                continue
        if text[b : b + 1] in ("-", "/", ".") and (m := _DATE.match(text, a)):
            taken.add("", *m.span())
            done = m.end()
            continue
        s = a
        while s and a - s < 2 and text[s - 1] in "+(":
            s -= 1
        m = _NUMBER.match(text, s)
        if not m:
            continue
        done, value = m.end(), m.group()
        if not 8 <= sum(c.isdigit() for c in value) <= 14:
            continue
        if _ID_SEED.fullmatch(value):
            taken.add("ID", *m.span())
        elif not value[-1:].isalpha():
            taken.add("PHONE" if _PHONE_SEED.fullmatch(value) else "NUMBER", *m.span())
    low = 0
    for a, b in runs:
        if b - a <= 5 and taken.free(a):
            _place(text, a, b, low, taken)
        low = b
    return taken


_STREET_WORDS = frozenset("rua r av avenida avda travessa trav tv alameda al praça praca pça pca rodovia rod estrada estr largo lgo ladeira beco via viela quadra "
                          "calle c cl plaza pza paseo pº camino carrera carretera ctra ronda bulevar glorieta travesía travesia".split())
_PIECE = re.compile(r"[^\W\d_]+")


def _house(text: str, a: int, b: int, before: list[int], taken: _Taken) -> None:
    """The address whose house number is at ``a``: the words before it in its line, since the last number or, if that is part of a street's name, the one before."""
    after = text[b : b + 1]
    if after in (" ", "\t", "\xa0", "-") or after.isalpha():
        m = _STREET_EN.match(text, a)
        if m and (not a or not (text[a - 1].isalnum() or text[a - 1] in "_.,/-")):
            names = _PLAIN.findall(m.group())
            if any(w[:1].isupper() for w in names if len(w) > 1) or len(names) == 2 and m.group("strong"):
                taken.add("ADDRESS" if m.group("strong") else "STREET", *m.span())
                return
    line = text.rfind("\n", before[0], a) + 1
    start, end = a, min(len(text), b + 3)
    for lo in (max(before[1], line), max(before[0], line)):
        for _ in range(14):  # a street has at most eleven words before its number
            start = text.rfind(" ", lo, start)
            if start < 0:
                start = lo
                break
        pieces = _PIECE.findall(text[start:a])
        if len(pieces) < 2:
            start = a
            continue
        if any(w.lower() in _STREET_WORDS for w in pieces):
            m, weak = _STREET.search(text, start, end), None
            # Of several beginnings the first with an unmistakable street word, else the first.
            while m and (m.start("house") != a or not m.group("strong")):
                weak = weak or (m if m.start("house") == a else None)
                m = _STREET.search(text, m.start() + 1, end)
            m = m or weak
            if m and any(len(w) > 2 and w.lower() not in PARTICLES for w in _PLAIN.findall(m.group())[1:]):
                taken.add("ADDRESS" if m.group("strong") else "STREET", *m.span())
                return
        start = a


def _place(text: str, a: int, b: int, low: int, taken: _Taken) -> None:
    """Capitalised words and the house number at ``a``: an address if its patterns say so."""
    start = max(low, text.rfind("\n", low, a) + 1)
    at = a
    for _ in range(8):
        at = text.rfind(" ", start, at)
        if at < 0:
            at = start
            break
    pieces = _PIECE.findall(text[at:a])[-2:]
    if len(pieces) == 2 and any(w[0].isupper() for w in pieces) and (m := _PLACE.search(text, at, min(len(text), b + 3))) and m.start("house") == a:
        taken.add("PLACE", *m.span())


def _runs_of_words(text: str, given: frozenset[str], taken: _Taken, small: list[str]) -> Iterator[tuple]:
    """(words, case, seps, starts, ends, heads) of the maximal sequences of words of one case outside ``taken``.

    ``seps`` has a sign for each gap: space, ``,``, ``p`` particle, ``e`` conjunction. ``heads`` are the
    places a name may begin: any word, of words in lower case those in ``given`` (``small`` are those that occur).
    """
    low = re.compile(rf"(?<![\w'’\-])(?:{'|'.join(map(re.escape, sorted(small, key=len, reverse=True)))})(?![\w'’\-])") if small else None
    at = 0
    for a, b in [*zip(taken.starts, taken.ends), (len(text), len(text))]:
        for head in (_HEAD, low):
            done = at
            for m in head.finditer(text, at, a) if head else ():
                if m.start() < done or (head is _HEAD and m.start() and text[m.start() - 1] in "&;"):
                    continue
                words, seps, starts, ends = [_folded(m.group())], "", [m.start()], [m.end()]
                case = _case(m.group())
                while step := _STEP.match(text, ends[-1], a):
                    word = step.group("word")
                    if _case(word) != case or step.group("comma") and step.group("small"):
                        break
                    key = _folded(word)
                    if key in PARTICLES:
                        break
                    small_words = step.group("small").lower().split()
                    seps += "," if step.group("comma") else "e" if small_words[-1:] in (["e"], ["y"]) else "p" if small_words else " "
                    words.append(key)
                    starts.append(step.start("word"))
                    ends.append(step.end("word"))
                done = ends[-1]
                if len(words) < 2:
                    continue
                heads = [i for i, w in enumerate(words[:-1]) if len(w) > 1 and w not in PARTICLES and w not in TITLE_WORDS and (case != "l" or w in given)]
                if heads:
                    yield words, case, seps, starts, ends, heads
        at = b


def _left(text: str, a: int, taken: _Taken) -> tuple[str, str, str]:
    """The last one, two and three tokens before ``a``: words folded, digits as 0, entities as ``<kind>``, beginnings of sentences as ``<s>``."""
    left: list[str] = []
    pos = a
    while len(left) < 3:
        i = bisect_left(taken.starts, pos) - 1
        lo = taken.ends[i] if i >= 0 else 0
        cut = max(lo, pos - REACH)
        tokens = _TOKEN.findall(text[cut:pos])[-4:]
        for k in range(len(tokens) - 1, -1, -1):
            raw = tokens[k]
            if raw in _ENDS and not (raw == "." and k and (len(tokens[k - 1]) == 1 and tokens[k - 1].isupper() or _folded(tokens[k - 1]) in TITLE_WORDS)):
                left.append("<s>")
                break
            left.append("0" if raw.isdigit() else _folded(raw) if raw[0].isalpha() or len(raw) > 1 else raw)
            if len(left) == 3:
                break
        if left[-1:] == ["<s>"] or len(left) >= 3 or cut > lo:
            break
        if i < 0:
            left.append("<s>")
            break
        left.append(f"<{taken.kinds[i].lower()}>" if taken.kinds[i] in ("EMAIL", *KINDS) else "<number>" if taken.kinds[i] == "NUMBER" else "<other>")
        pos = taken.starts[i]
    left = left[::-1] or ["<s>"]
    return left[-1], " ".join(left[-2:]), " ".join(left)


def candidates(text: str, given: frozenset[str]) -> tuple[list[tuple], list[tuple], list[str]]:
    """Rows (kind, sure, start, end, value, g1, g2, g3) of entities and candidates, runs of words with their heads' patterns, and words in ordinary places."""
    every = marked(text)
    taken = _Taken()
    for kind, a, b in zip(every.kinds, every.starts, every.ends):
        if kind not in ("STREET", "PLACE"):  # these may turn out to be none: names are sought in them too
            taken.add(kind, a, b)
    rows = []
    for kind, a, b in zip(every.kinds, every.starts, every.ends):
        if not kind:
            continue
        value = re.sub(r"\D", "", text[a:b]) if kind in ("PHONE", "ID", "NUMBER") else text[a:b].lower()
        rows.append((kind, kind in KINDS or kind == "EMAIL", a, b, value, *_left(text, a, taken)))
    outside = " ".join(text[a:b] for a, b in zip([0, *taken.ends], [*taken.starts, len(text)]))
    words = set(_PLAIN.findall(outside))
    ordinary = {w for w in words if not w[0].isupper()}
    small = [w for w in ordinary if _folded(w) in given]
    first = _PLAIN.search(outside)
    ordinary.update(_OPENING.findall(outside), [first.group()] if first else [])
    runs = [(*run[:-1], [(i, *_left(text, run[3][i], taken)) for i in run[-1]]) for run in _runs_of_words(text, given, taken, small)]
    return rows, runs, list({_folded(w) for w in ordinary})


_TYPE = pa.schema([("doc", pa.string()), ("copy", pa.int64()), ("kind", pa.string()), ("sure", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
                   ("g1", pa.string()), ("g2", pa.string()), ("g3", pa.string()), ("words", pa.list_(pa.string())), ("case", pa.string()), ("seps", pa.string()),
                   ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                   ("heads", pa.list_(pa.struct([("i", pa.int32()), ("g1", pa.string()), ("g2", pa.string()), ("g3", pa.string())]))), ("uses", pa.int64()), ("bits", pa.int64())])
SCHEMA = ("doc string, copy long, kind string, sure boolean, start int, `end` int, value string, g1 string, g2 string, g3 string, words array<string>, `case` string, seps string, "
          "starts array<int>, ends array<int>, heads array<struct<i: int, g1: string, g2: string, g3: string>>, uses long, bits long")


def read_texts(documents: DataFrame, doc: str, text: str, given: frozenset[str]) -> DataFrame:
    """One pass over the texts: rows of entities and candidates, of kind ``NAME`` for runs of words, and per batch one row ``USE`` per ordinary word.

    ``uses`` counts the texts that hold the word in an ordinary place; ``bits`` has one bit of 64 on for
    each of them, chosen by the text's hash, so that copies set one bit only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _TYPE.names
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            uses: dict[str, list[int]] = {}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is None or value is None or not value.strip():
                    continue
                entities, runs, ordinary = candidates(value, given)
                copy = zlib.crc32(value.encode("utf-8", "replace"))
                bit = 1 << copy % 64
                for w in ordinary:
                    got = uses.get(w)
                    if got is None:
                        uses[w] = [1, bit]
                    else:
                        got[0] += 1
                        got[1] |= bit
                for kind, sure, a, b, v, g1, g2, g3 in entities:
                    for n, x in zip(names, (key, copy, kind, sure, a, b, v, g1, g2, g3, None, None, None, None, None, None, None, None)):
                        out[n].append(x)
                for words, case, seps, starts, ends, heads in runs:
                    heads = [{"i": i, "g1": g1, "g2": g2, "g3": g3} for i, g1, g2, g3 in heads]
                    for n, x in zip(names, (key, copy, "NAME", False, starts[0], ends[-1], None, None, None, None, words, case, seps, starts, ends, heads, None, None)):
                        out[n].append(x)
            for n in names:
                if n not in ("kind", "value", "uses", "bits"):
                    out[n] += [None] * len(uses)
            out["kind"] += ["USE"] * len(uses)
            out["value"] += list(uses)
            out["uses"] += [x[0] for x in uses.values()]
            out["bits"] += [x[1] - (1 << 64) if x[1] >> 63 else x[1] for x in uses.values()]
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in _TYPE], schema=_TYPE)

    return documents.select(F.col(doc).cast("string").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _longest(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` with ``best``, the columns of the longest of their patterns that is in ``patterns``; null if none is."""
    said = [c for c in patterns.columns if c != "pattern"]
    for g in ("g3", "g2", "g1"):
        rows = rows.join(patterns.select(F.col("pattern").alias(g), F.struct(*said).alias(f"_{g}")), g, "left")
    return rows.withColumn("best", F.coalesce("_g3", "_g2", "_g1")).drop("_g1", "_g2", "_g3")


def _patterns() -> Column:
    return F.explode(F.array_distinct(F.array("g1", "g2", "g3"))).alias("pattern")


def name_patterns(heads: DataFrame, seeds: DataFrame, rounds: int = 3, varied: int = 6) -> tuple[DataFrame, DataFrame]:
    """Scores of the patterns ``(pattern, score)`` and of first words ``(first, trust)`` by mutual reinforcement.

    ``heads`` are places a name may begin. A pattern's score is the mean trust of its distinct (first,
    second) words; patterns with fewer than ``varied`` distinct first or second words score 0 if they are
    in at least twice as many different texts, else they have no score. The trust of a listed given name
    is 1, that of another word the mean score of the distinct patterns it follows.
    """
    scratch = Scratch(heads.sparkSession)
    # A comma after the first word: the given name may stand second.
    turned = F.col("sep") == ","
    pairs = heads.select("copy", _patterns(), F.when(turned, F.col("second")).otherwise(F.col("first")).alias("first"), F.when(turned, F.col("first")).otherwise(F.col("second")).alias("second"))
    # One short word or sign alone ("a", ":") says too little to stand for a context, and so does a beginning.
    seen = pairs.where((F.length("pattern") >= 3) & (F.col("pattern") != "<s>"))
    edges = scratch.save(seen.groupBy("pattern", "first", "second").agg(F.min("copy").alias("copy"), F.max("copy").alias("other")))
    wide = edges.groupBy("pattern").agg(F.approx_count_distinct("first", 0.02).alias("a"), F.approx_count_distinct("second", 0.02).alias("b"))
    wide = scratch.save(wide.withColumn("varied", (F.col("a") >= varied) & (F.col("b") >= varied)))
    fixed = seen.join(wide.where("NOT varied").select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.approx_count_distinct("copy", 0.02).alias("texts"))
    fixed = fixed.where(F.col("texts") >= 2 * varied).select("pattern", F.lit(0.0).alias("score"))
    edges = scratch.save(edges.join(wide.where("varied").select("pattern"), "pattern", "left_semi").select("pattern", "first", "second"))
    listed = seeds.select(F.col("given").alias("first"), F.lit(1.0).alias("trust"))
    trust = listed
    scores = None
    for _ in range(rounds):
        scores = scratch.save(edges.join(trust, "first", "left").groupBy("pattern").agg(F.avg(F.coalesce("trust", F.lit(0.0))).alias("score")))
        met = edges.select("first", "pattern").distinct().join(scores, "pattern").groupBy("first").agg(F.avg("score").alias("met"))
        trust = scratch.save(met.join(listed, "first", "full").select("first", F.coalesce("trust", "met").alias("trust")))
    # Fixed phrases stay in the table with score 0, lest a shorter pattern decide for them.
    return scratch.save(scores.unionByName(fixed)), trust


def entity_patterns(rows: DataFrame, rounds: int = 3, least: int = 3, lends: float = 0.2) -> DataFrame:
    """``(pattern, n, PHONE, ID, ADDRESS)`` of the patterns before at least ``least`` distinct values: their number and each kind's score.

    A pattern's score is the mean trust of its distinct values. A seed's trust is 1 for its kind; that of
    an undecided value starts at 0 and is the mean score of the patterns it occurs behind, where that
    reaches ``lends``: a few seeds behind a pattern that is none of theirs don't feed themselves.
    """
    scratch = Scratch(rows.sparkSession)
    seed = F.when(F.col("sure"), F.col("kind"))
    edges = rows.select(F.xxhash64("value").alias("value"), seed.alias("seed"), _patterns()).where(F.col("pattern") != "<s>")
    edges = scratch.save(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    learned, scores = None, None
    for _ in range(rounds):
        met = edges if learned is None else edges.join(learned, "value", "left")
        trust = lambda k: F.when(F.col("seed").isNotNull(), (F.col("seed") == k).cast("double")).otherwise(F.coalesce(f"l{k}", F.lit(0.0)) if learned is not None else F.lit(0.0))  # noqa: E731, B023
        scores = scratch.save(met.groupBy("pattern").agg(F.count("*").alias("n"), *[F.avg(trust(k)).alias(k) for k in KINDS]).where(F.col("n") >= least))
        open_ = edges.where("seed IS NULL").join(scores, "pattern")
        learned = scratch.save(open_.groupBy("value").agg(*[F.when(F.avg(k) >= lends, F.avg(k)).alias(f"l{k}") for k in KINDS]))
    return scores


def decided(rows: DataFrame, scores: DataFrame, *, confident: float = 0.5, place: float = 0.8, refuted: float = 0.05, many: int = 20) -> DataFrame:
    """``(doc, kind, start, end)``: what the longest scored pattern of each candidate says of it.

    An undecided number is of the kind that scores at least ``confident``, words and a house number an
    address at ``place``. A seed stays what it is unless its pattern has at least ``many`` distinct
    values nearly none of which (``refuted``) are of its kind; it then takes the confident kind, if any.
    """
    best = _longest(rows, scores)
    of = lambda k: F.coalesce(F.col("best")[k], F.lit(0.0))
    number = F.when(F.greatest(of("PHONE"), of("ID")) >= confident, F.when(of("PHONE") >= of("ID"), "PHONE").otherwise("ID"))
    own = F.when(F.col("kind") == "PHONE", of("PHONE")).when(F.col("kind") == "ID", of("ID")).otherwise(of("ADDRESS"))
    doubtful = (F.coalesce(F.col("best.n"), F.lit(0)) >= many) & (own < refuted)
    kind = (F.when(F.col("kind") == "NUMBER", number)
            .when(F.col("kind") == "STREET", F.when(of("ADDRESS") >= confident, F.lit("ADDRESS")))
            .when(F.col("kind") == "PLACE", F.when(of("ADDRESS") >= place, F.lit("ADDRESS")))
            .when(~doubtful, F.col("kind")).when(F.col("kind").isin("PHONE", "ID"), number))
    return best.select("doc", kind.alias("kind"), "start", "end").where("kind IS NOT NULL")


def resolve_name(seps: str, common: list[bool], trusted: list[bool], i: int = 0) -> int | None:
    """Where the name that begins with word ``i`` ends; None if there is none.

    Ordinary words end it, and a conjunction before a given name does. A name is a given name and
    surnames, or surnames, a comma and a given name; one word alone is none.
    """
    if common[i] and not trusted[i]:
        return None
    j = i + 1
    while j < len(common) and seps[j - 1] != "," and not common[j] and not (seps[j - 1] == "e" and j - i > 1 and trusted[j]):
        j += 1
    if j < len(common) and seps[j - 1] == "," and not (common[j] and not trusted[j]) and (trusted[j] if j - i > 1 or trusted[i] else True) and not (j - i > 1 and trusted[i]):
        return j + 1
    return j if j - i > 1 else None


def found(documents: DataFrame, doc: str, text: str, given_names: DataFrame, given: str, *, confident: float = 0.5, ordinary: int = 3) -> DataFrame:
    """``(doc, kind, start_char, end_char)`` of every e-mail address, telephone, document number, street address and name.

    Offsets count code points of the text as stored. Null ids and null, empty and blank texts have no
    rows; repeated rows of a document count once; entities of copies under other ids are all given. A
    word is ordinary if at least ``ordinary`` different texts hold it in lower case or first in a
    sentence, and more texts do so than hold it in a likely name (of one in lower case, its first two words).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    rows = given_names.select(given).where(F.col(given).isNotNull()).limit(MAX_SEEDS + 1).collect()
    if len(rows) > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} given names")
    seeds = frozenset(w for r in rows for w in [fold(r[0]).strip()] if w)
    listed = spark.createDataFrame([(w,) for w in sorted(seeds)], "given string")
    raw = scratch.save(read_texts(documents, doc, text, seeds))
    shaped = raw.where("kind = 'EMAIL'").select("doc", "kind", "start", "end")
    others = raw.where("kind IN ('PHONE', 'ID', 'ADDRESS', 'NUMBER', 'STREET', 'PLACE')").select("doc", "kind", "sure", "start", "end", "value", "g1", "g2", "g3")
    kinds = decided(others, entity_patterns(others), confident=confident)

    runs = raw.where("kind = 'NAME'").select("doc", "copy", "start", "words", "case", "seps", "starts", "ends", F.explode("heads").alias("h"))
    heads = runs.select("doc", "copy", "start", "words", "case", "seps", "starts", "ends", "h.i", "h.g1", "h.g2", "h.g3")
    scores, trust = name_patterns(heads.select("copy", "g1", "g2", "g3", F.get("words", F.col("i")).alias("first"), F.get("words", F.col("i") + 1).alias("second"), F.expr("substr(seps, i + 1, 1)").alias("sep")), listed)
    behind = _longest(heads, scores).where(F.col("best.score") >= confident)
    behind = scratch.save(behind.select("doc", "copy", "start", "words", "case", "seps", "starts", "ends", "i"))
    # Ordinary uses of a word beside those as the beginning of likely names; names in lower case count as both, so they are taken off.
    begin = F.expr("slice(words, i + 1, IF(`case` = 'l', 2, size(words)))")
    inside = behind.select("copy", "case", F.explode(begin).alias("word")).distinct()
    inside = inside.groupBy("word").agg(F.count("*").alias("inside"), F.count(F.when(F.col("case") == "l", 1)).alias("lower"))
    usual = raw.where("kind = 'USE'").groupBy(F.col("value").alias("word")).agg(F.sum("uses").alias("uses"), F.bit_count(F.bit_or("bits")).alias("texts"))
    outside = F.col("uses") - F.coalesce("lower", F.lit(0))
    common = usual.where(F.col("texts") >= ordinary).join(inside, "word", "left").where((outside >= ordinary) & (outside > F.coalesce("inside", F.lit(0)))).select("word", F.lit(True).alias("common"))
    trusted = trust.where(F.col("trust") >= confident).select(F.col("first").alias("word"), F.lit(True).alias("trusted"))
    each = behind.select("doc", "start", "i", F.posexplode("words").alias("at", "word")).where("at >= i").select("doc", "start", "at", "word").distinct()
    flags = each.join(common, "word", "left").join(trusted, "word", "left").groupBy("doc", "start").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("common", F.lit(False)).alias("common"), F.coalesce("trusted", F.lit(False)).alias("trusted")))).alias("flags"))
    whole = behind.groupBy("doc", "start").agg(F.array_sort(F.collect_set("i")).alias("heads"), F.first("seps").alias("seps"), F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    ready = whole.join(flags, ["doc", "start"]).select("doc", "heads", "seps", "starts", "ends", "flags.at", "flags.common", "flags.trusted")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                first = int(r.at[0])
                done, seps = 0, r.seps[first:]
                for i in r.heads:
                    end = resolve_name(seps, r.common, r.trusted, i - first) if i >= done else None
                    while end:
                        done = end + first
                        out.append((r.doc, "NAME", int(r.starts[i]), int(r.ends[done - 1])))
                        # "A and B": the second name needs no pattern of its own.
                        i = done
                        end = resolve_name(seps, r.common, r.trusted, end) if end < len(seps) and seps[end - 1] == "e" and r.trusted[end] else None
            yield pd.DataFrame(out, columns=["doc", "kind", "start", "end"])

    named = ready.mapInPandas(resolve, "doc string, kind string, start int, `end` int")
    kept = _outermost(shaped.unionByName(kinds).unionByName(named).distinct())
    key_type = dict(documents.dtypes)[doc]
    return kept.select(F.col("doc").cast(key_type).alias("doc"), "kind", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def _outermost(entities: DataFrame) -> DataFrame:
    """Entities that do not begin inside an earlier one of the same text."""
    before = Window.partitionBy("doc").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return entities.withColumn("reached", F.max("end").over(before)).where(F.col("reached").isNull() | (F.col("start") >= F.col("reached"))).drop("reached")


def redact(documents: DataFrame, doc: str, text: str, entities: DataFrame) -> DataFrame:
    """``(doc, redacted, n_entities)``: each text with its entities replaced by ``[KIND]``; null stays null.

    ``entities`` is a result of ``found``. Spans that overlap an earlier one are skipped.
    """
    per = entities.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "kind"))).alias("spans"))

    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            done = []
            for value, marks in zip(texts, lists):
                if not isinstance(value, str) or marks is None:
                    done.append(value)
                    continue
                out, at = [], 0
                for m in marks:
                    a, b, kind = (m["start_char"], m["end_char"], m["kind"]) if isinstance(m, dict) else m
                    if a >= at:
                        out += [value[at:a], f"[{kind}]"]
                        at = b
                done.append("".join([*out, value[at:]]))
            yield pd.Series(done, dtype=object)

    joined = documents.select(F.col(doc).alias("doc"), F.col(text).alias("_text")).join(per, "doc", "left")
    return joined.select("doc", F.pandas_udf(cut, "string")("_text", "spans").alias("redacted"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_entities"))
