"""Best representative of each duplicate group, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.components import components

# Statements that nothing is known, folded to lower case without accents.
UNKNOWN = ("", "n/d", "nd", "n/a", "na", "s/d", "s/i", "null", "none", "nan", "nil", "nao informado", "nao informada",
           "nao disponivel", "nao consta", "nao sei", "nao se aplica", "sem informacao", "sem informacoes",
           "sem descricao", "sem dados", "sem dado", "sem valor", "indisponivel", "indefinido", "indefinida", "desconhecido",
           "desconhecida", "ignorado", "vazio", "unknown", "undefined", "not available", "not informed", "no data",
           "no information", "sin informacion", "sin datos", "sin descripcion", "desconocido", "no informado",
           "no disponible", "a definir", "tbd")


def plain(column: Column) -> Column:
    """Lower case without accents, spaces collapsed, named spaces decoded."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(column), "&nbsp;|&#160;|&#xa0;", " "), "(?U)[\\s\\u200b\\ufeff]+", " ")
    return F.trim(F.translate(spaced, "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"))


def known(column: Column) -> Column:
    """True where a text says something: not null, blank, mere punctuation or a statement that nothing is known."""
    folded = plain(column)
    bare = F.regexp_replace(folded, "^[\\p{P}\\p{S}\\s]+|[\\p{P}\\p{S}\\s]+$", "")
    return column.isNotNull() & (bare != "") & ~folded.isin(*UNKNOWN) & ~bare.isin(*UNKNOWN)


def instant(column: Column) -> Column:
    """Microseconds since 1970 of an instant in any of the written forms, null where none is readable.

    Forms: ISO 8601 with T or a space, fraction and offset (Z, +hh:mm, +hhmm) optional; compact
    yyyymmddThhmmssZ; dd/mm/yyyy hh:mm[:ss]; bare digits as Unix seconds (up to 11) or milliseconds.
    Without an offset it is UTC.
    """
    text = F.trim(F.regexp_replace(column, "(?U)\\s+", " "))
    iso = "^(\\d{4})-(\\d{2})-(\\d{2})[T ](\\d{2}):(\\d{2})(?::(\\d{2})(\\.\\d+)?)? ?(Z|[+-]\\d{2}:?\\d{2})?$"
    compact = "^(\\d{4})(\\d{2})(\\d{2})T?(\\d{2})(\\d{2})(\\d{2})(\\.\\d+)? ?(Z|[+-]\\d{2}:?\\d{2})?$"
    local = "^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})[T ,]+(\\d{2}):(\\d{2})(?::(\\d{2})(\\.\\d+)?)? ?(Z|[+-]\\d{2}:?\\d{2})?$"

    def part(pattern: str, group: int, empty: str = "0") -> Column:
        got = F.regexp_extract(text, pattern, group)
        return F.when(got == "", F.lit(empty)).otherwise(got)

    def parsed(pattern: str, year: int, month: int, day: int) -> Column:
        date = F.concat_ws("-", part(pattern, year), F.lpad(part(pattern, month), 2, "0"), F.lpad(part(pattern, day), 2, "0"))
        days = F.unix_date(F.try_to_date(date, "yyyy-MM-dd"))
        seconds = part(pattern, 4).cast("long") * 3600 + part(pattern, 5).cast("long") * 60 + part(pattern, 6).cast("long")
        zone = F.regexp_replace(F.regexp_replace(part(pattern, 8, "Z"), "Z", "+0000"), ":", "")
        offset = F.substring(zone, 2, 2).cast("long") * 3600 + F.substring(zone, 4, 2).cast("long") * 60
        sign = F.when(F.startswith(zone, F.lit("-")), 1).otherwise(-1)
        micros = F.round(part(pattern, 7).cast("double") * 1e6).cast("long")
        return (days.cast("long") * 86400 + seconds + sign * offset) * 1_000_000 + micros

    day_only = F.unix_date(F.try_to_date(text, "yyyy-MM-dd")).cast("long") * 86_400_000_000
    return (
        F.when(text.rlike(iso), parsed(iso, 1, 2, 3))
        .when(text.rlike("^\\d{1,11}$"), text.try_cast("long") * 1_000_000)
        .when(text.rlike("^\\d{12,14}$") & ~text.rlike("^(19|20)\\d{12}$"), text.try_cast("long") * 1000)
        .when(text.rlike("^\\d{15,16}$"), text.try_cast("long"))
        .when(text.rlike(compact), parsed(compact, 1, 2, 3))
        .when(text.rlike(local), parsed(local, 3, 2, 1))
        .when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), day_only)
    )


def duplicate_groups(records: DataFrame, record: str, pointer: str) -> DataFrame:
    """``(record, group)`` of the records tied together by a pointer, in either direction and through others.

    Stray spaces around the pointer are removed; pointers that are blank, name their own record or one
    that doesn't exist link nothing. Only groups of two or more have rows; the group is its smallest id.
    """
    ids = records.where(F.col(record).isNotNull()).select(F.col(record).alias("id"))
    links = records.select(F.col(record).alias("a"), F.regexp_replace(F.col(pointer), "(?U)^\\s+|\\s+$", "").alias("b"))
    links = links.where("a IS NOT NULL AND b <> '' AND a <> b")
    found = links.join(ids.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    return components(found, "a", "b").select(F.col("node").alias("record"), F.col("component").alias("group"))


def survivors(records: DataFrame, groups: DataFrame, record: str, fields: Mapping[str, tuple[Column, Sequence[Column]]]) -> DataFrame:
    """One row per group and one struct ``(value, source)`` per field: whose value survives.

    ``fields`` gives, for each field, whether a record has a value and the priorities by which the
    greatest wins, most important first (a null priority loses to all others). Remaining ties go to
    the smaller id. One aggregation takes, per field, the maximum of (non-null, priorities, tie-break)
    with the value carried along, combined before the shuffle, so a group of any size costs one row
    per task. A field no member has a value for is null.
    """
    member = records.join(groups.select(F.col("record").alias(record), F.col("group")), record)
    best = []
    for name, (has, priorities) in fields.items():
        # Negated priorities make the least struct the winner, so that ties fall to the smaller id.
        rank = [F.coalesce(-p.cast("double"), F.lit(float("inf"))).alias(f"p{i}") for i, p in enumerate(priorities)]
        entry = F.struct(*rank, F.col(record).alias("source"), F.col(name).alias("value"))
        best.append(F.min(F.when(has, entry)).alias(name))
    won = member.groupBy("group").agg(*best)
    return won.select("group", *[F.when(F.col(n).isNotNull(), F.struct(F.col(n)["value"].alias("value"), F.col(n)["source"].alias("source"))).alias(n) for n in fields])
