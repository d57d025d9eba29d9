"""Joins with a stated cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A side of a validated join repeats a key."""


def repeats_key(df: DataFrame, key: str) -> bool:
    """Whether a key (null is one) occurs more than once; stops at the first."""
    return not df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


def validated_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", validate: str = "many_to_one", check: bool = True) -> DataFrame:
    """A join that raises if a side which must be unique isn't.

    check=False leaves the test to the caller, for sides that are unique by their making (a groupBy on the key).
    """
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,), "many_to_many": ()}[validate]
    if check:
        for side in sides:
            if repeats_key(side, key):
                raise CardinalityError(f"{key} repeats in a {validate} join")
    return left.join(right, key, how)


def completed_domain(domain: DataFrame, measured: DataFrame, key: str, zeros: list[str]) -> DataFrame:
    """A row for every key of the domain; measures that are missing are 0. Keys outside the domain go."""
    return domain.join(measured, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(measured.schema[c].dataType)) for c in zeros})
