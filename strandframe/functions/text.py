"""Names, lineages and identifiers as string columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_words(col: Column, n: int) -> Column:
    """The first n words, joined by one space; null has none."""
    return F.array_join(F.slice(F.split(F.trim(F.coalesce(col, F.lit(""))), r"\s+"), 1, n), " ")


def last_taxon(lineage: Column, sep: str = ";") -> Column:
    return F.trim(F.element_at(F.split(lineage, sep), -1))


def in_domain(lineage: Column, domain: str, sep: str = ";") -> Column:
    return F.array_contains(F.transform(F.split(lineage, sep), F.trim), domain)


class Rule(NamedTuple):
    """An identifier type: its pattern, and the form to write it in ($1 is the pattern's first group)."""

    name: str
    pattern: str
    form: str


def classify(df: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """df with id_type (of the first rule that matches) and id_form; both null if none does."""
    kind, form = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        hit = F.col(id_col).rlike(r.pattern)
        kind, form = F.when(hit, r.name).otherwise(kind), F.when(hit, F.regexp_replace(id_col, r.pattern, r.form)).otherwise(form)
    return df.withColumns({"id_type": kind, "id_form": form})
