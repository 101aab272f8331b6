"""Joins of rows with facts about their keys, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with one in HOT of the rows, so at most HOT keys are.
HOT = 1000


def joined_by_count(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which have a row a key and count, the number of the key's rows; keys must
    not be null. Hot keys' facts are broadcast, at most HOT of them whatever the size of the input; the other keys, of which
    none holds more than one in HOT of the rows, are joined by a shuffle. facts are read three times, rows twice: both
    should be tables or cheap."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT >= total
    hot = F.broadcast(facts.where(is_hot))
    few = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(~is_hot), keys, how)
    return few.unionByName(rest).drop(count)
