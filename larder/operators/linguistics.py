"""Rule-based annotations: shallow dependencies, lexicon sentiment, domain entities, relations."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import lexicons as L
from larder.functions import text as T
from larder.functions.words import fold


def verb_lemma(word: str) -> str:
    return L.VERB_FORMS.get(word) or T.lemma_word(word)


#: Names of the relations.
RELATIONS = ("root", "det", "case", "nsubj", "obj", "nmod")
_DEPENDENCY = "array<struct<token_index: int, token: string, lemma: string, head_index: int, relation: string>>"


def _parsed(words: pa.Array, verbs: frozenset[str], determiners: frozenset[str], prepositions: frozenset[str]) -> pa.Array:
    """Dependencies of a column of token lists, on flat arrays: a word is looked up once a batch, roots and objects are minima by row."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    codes = words.flatten().dictionary_encode()
    known, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    lemmas = [verb_lemma(w) if w is not None else None for w in known]
    verb, det, case = (np.array([x in group for x in items], dtype=bool) for items, group in ((lemmas, verbs), (known, determiners), (known, prepositions)))
    starts = np.r_[0, np.cumsum(lengths)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(starts[-1]) - starts[row]
    none = np.iinfo(np.int64).max

    def first(chosen: np.ndarray) -> np.ndarray:
        least = np.full(len(lengths), none)
        np.minimum.at(least, row[chosen], place[chosen])
        return least

    verb, det, case = verb[at], det[at], case[at]
    root = first(verb)
    root = np.where(root == none, 0, root)[row]
    small = det | case
    obj = first((place > root) & ~small)[row]
    is_root = place == root
    kind = np.select([is_root, det, case, place < root, place == obj], [0, 1, 2, 3, 4], 5)
    head = np.where(small, np.minimum(place + 1, lengths[row] - 1), root)
    fields = [pa.array(place, pa.int32()), codes.dictionary.take(codes.indices), pa.array(lemmas, pa.string()).take(codes.indices), pa.array(head, pa.int32(), mask=is_root), pa.array(RELATIONS).take(pa.array(kind))]
    items = pa.StructArray.from_arrays(fields, names=["token_index", "token", "lemma", "head_index", "relation"])
    offsets = pa.array(starts, pa.int32(), mask=np.r_[words.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, items)


def dependencies(rows: DataFrame, words: str, verbs: Sequence[str] = L.VERBS, determiners: Sequence[str] = L.DETERMINERS, prepositions: Sequence[str] = L.PREPOSITIONS) -> DataFrame:
    """``rows`` with ``d``: an array of (token_index, token, lemma, head_index, relation) of the token array ``words``.

    The root is the first token whose lemma is a verb, else the first token. Determiners and
    prepositions attach to the next token, tokens before the root are subjects, the first remaining
    one after it the object, the others modifiers. A null array gives null. Whole Arrow batches are
    handled as flat arrays: nested array functions would be interpreted once a token.
    """
    rest = [c for c in rows.columns if c != "d"]
    groups = frozenset(verbs), frozenset(determiners), frozenset(prepositions)
    i = rest.index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _parsed(batch.column(i), *groups)], names=[*rest, "d"])

    own = rows.select(*rest)
    return own.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + f", d {_DEPENDENCY}")


def sentiment(words: Column, polarity: Mapping[str, float] = L.POLARITY, negations: Sequence[str] = L.NEGATIONS, intensifiers: Mapping[str, float] = L.INTENSIFIERS) -> Column:
    """Struct (polarity, score, subjectivity, evidence) of a token array.

    A lexicon word counts its value, times the greatest intensity among the three tokens before it,
    negated if one of those negates; the sum over max(1, 1.5 n) is clamped to [-1, 1].
    """
    values, strong = T.literal_map(polarity), T.literal_map(intensifiers)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i).isin(*polarity))

    def one(i: Column) -> Column:
        before = F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        negated = F.exists(before, lambda w: w.isin(*negations))
        force = F.aggregate(before, F.lit(None).cast("double"), lambda m, w: F.greatest(m, F.when(w.isin(*intensifiers), F.element_at(strong, w)).otherwise(F.lit(1.0))))
        base = F.element_at(values, F.get(words, i))
        force = F.coalesce(force, F.lit(1.0))
        return F.struct(F.get(words, i).alias("token"), base.alias("base"), negated.alias("negated"), force.alias("intensity"), (base * force * F.when(negated, -1.0).otherwise(1.0)).alias("contribution"))

    evidence = F.transform(at, one)
    n = F.size(evidence)
    total = F.aggregate(evidence, F.lit(0.0), lambda s, e: s + e["contribution"])
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.greatest(F.lit(1.0), n * 1.5)))
    name = F.when(score > 0.1, "positivo").when(score < -0.1, "negativo").otherwise("neutro")
    subjectivity = F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.size(words)) * 4)
    return F.struct(name.alias("polarity"), score.alias("score"), subjectivity.alias("subjectivity"), evidence.alias("evidence"))


def aspects(words: Column, terms: Mapping[str, Sequence[str]] = L.ASPECTS) -> Column:
    """The aspects a token array mentions, in the order of ``terms``."""
    named = F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in t])), F.lit(a)) for a, t in terms.items()])
    return F.filter(named, lambda a: a.isNotNull())


def entity_texts(text: Column, kind: str) -> Column:
    """All matches of one kind of entity, JVM-side, without offsets."""
    return F.regexp_extract_all(text, F.lit("(?iU)" + L.ENTITY_PATTERNS[kind] if kind != "TEMPERATURE" else "(?U)" + L.ENTITY_PATTERNS[kind]), F.lit(0))


# Words of an ingredient line that aren't part of its name.
FUNCTION_WORDS = r"\b(?:de|da|do|a|gosto|picad[oa]s?|fatiad[oa]s?)\b"


def ingredient_name(text: Column) -> Column:
    """An ingredient line without quantities, units and function words; the trimmed line if nothing remains."""
    rest = text
    for pattern in (L.ENTITY_PATTERNS["QUANTITY"], L.ENTITY_PATTERNS["UNIT"], FUNCTION_WORDS):
        rest = F.regexp_replace(rest, "(?iU)" + pattern, " ")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")
    return F.when(rest != "", rest).otherwise(F.trim(text))


STRUCTURED = {"ingredient": "INGREDIENT", "utensil": "UTENSIL", "related_category": "CATEGORY"}
_PATTERNS = {k: re.compile(p, 0 if k == "TEMPERATURE" else re.I) for k, p in L.ENTITY_PATTERNS.items()}
_NAME_CUT = re.compile(FUNCTION_WORDS, re.I)


def find_entities(field: str, text: str) -> list[tuple[int, int, str, str, str, str, str]]:
    """(start, end, text, type, normalised value, BIO tag, method) of a text, sorted; overlaps are kept."""
    out = [(m.start(), m.end(), m.group(), k, T.folded_clean(m.group()), f"B-{k}", "domain_regex") for k, p in _PATTERNS.items() for m in p.finditer(text)]
    bare = text.strip()
    if field in STRUCTURED and bare:
        kind, value = STRUCTURED[field], bare
        if field == "ingredient":
            value = _NAME_CUT.sub(" ", _PATTERNS["UNIT"].sub(" ", _PATTERNS["QUANTITY"].sub(" ", text)))
            value = re.sub(r"\s+", " ", value).strip(" ,.-") or bare
        start = text.find(bare)
        out.append((start, start + len(bare), bare, kind, T.folded_clean(value), f"B-{kind}", "structured_field"))
    return sorted(out, key=lambda e: (e[0], e[1], e[3]))


ENTITY = "struct<start_char: int, end_char: int, text: string, entity_type: string, normalized_value: string, bio_tag: string, method: string>"


def entities(units: DataFrame) -> DataFrame:
    """One row per entity of text units (recipe_id, field_name, position, raw_text), offsets in code points."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for fields, texts in parts:
            yield pd.Series([find_entities(f, t) if isinstance(t, str) else [] for f, t in zip(fields, texts)])

    udf = F.pandas_udf(run, f"array<{ENTITY}>")
    return units.select("recipe_id", "field_name", "position", F.explode(udf("field_name", "raw_text")).alias("e")).select("recipe_id", "field_name", "position", "e.*")


def relations(units: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct triples ``(recipe_id, subject, relation, object, field_name, position, confidence, method)``.

    Ingredients, utensils and categories belong to the recipe's title; in a step the root governs its object.
    """
    kinds = {"ingredient": "tem_ingrediente", "utensil": "usa_utensilio", "related_category": "pertence_categoria"}
    named = units.where(F.col("field_name").isin(*kinds) & (F.trim("raw_text") != "")).join(titles.select("recipe_id", "title"), "recipe_id")
    value = F.when(F.col("field_name") == "ingredient", ingredient_name(F.col("raw_text"))).otherwise(F.trim("raw_text"))
    own = named.select("recipe_id", F.col("title").alias("subject"), F.element_at(T.literal_map(kinds), F.col("field_name")).alias("relation"),
                       T.normalize_text(value).alias("object"), "field_name", "position", F.lit(1.0).alias("confidence"), F.lit("structured_field").alias("method"))
    parsed = parsed_steps(units)
    pick = lambda r: F.get(F.filter("d", lambda x: x["relation"] == r), F.lit(0))
    acts = parsed.select("recipe_id", pick("root")["lemma"].alias("subject"), F.lit("obj").alias("relation"), pick("obj")["lemma"].alias("object"),
                         "field_name", "position", F.lit(0.65).alias("confidence"), F.lit("shallow_dependency").alias("method")).where("object IS NOT NULL")
    return own.unionByName(acts).dropDuplicates(["recipe_id", "subject", "relation", "object", "field_name", "position"])


def parsed_steps(units: DataFrame) -> DataFrame:
    """``(recipe_id, field_name, position, d)``: dependencies of every preparation step."""
    steps = units.where("field_name = 'preparation_step'").select("recipe_id", "field_name", "position", T.normalize_lexical(F.col("raw_text")).alias("n"))
    return dependencies(steps.select("recipe_id", "field_name", "position", T.tokens(F.col("n")).alias("w")), "w").drop("w")
