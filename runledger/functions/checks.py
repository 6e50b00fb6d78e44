"""Ordered checks and strict JSON typing.

A record is judged by a list of checks in order; the first one that is not
*true* names the outcome. An unknown (null) check counts as not passed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import SPACE


def holds(predicate: Column) -> Column:
    """Null-proof predicate: unknown is false."""
    return F.coalesce(predicate, F.lit(False))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Code of the first check that does not hold, or null when all hold."""
    return F.coalesce(*[F.when(~holds(p), F.lit(code)) for p, code in checks], F.lit(None).cast("string"))


def all_hold(*predicates: Column) -> Column:
    result = F.lit(True)
    for predicate in predicates:
        result = result & holds(predicate)
    return result


def nonblank(text: Column) -> Column:
    """True when the text has at least one non-space character."""
    return holds(text.rlike(rf"(?U)[^{SPACE}]"))


def nonblank_all(items: Column) -> Column:
    return holds(F.forall(items, nonblank))


def between_0_and_1(value: Column) -> Column:
    return holds(value.between(0.0, 1.0) & ~F.isnan(value))


# --- JSON -----------------------------------------------------------------

def json_value(text: Column) -> Column:
    return F.try_parse_json(text)


def fields(value: Column) -> Column:
    """Top-level fields of a JSON object as ``map<string,variant>``; null if not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return holds(kind(value) == "STRING")


def is_absent_or_null(value: Column) -> Column:
    return value.isNull() | holds(kind(value) == "VOID")


def is_integer(value: Column) -> Column:
    return holds(kind(value) == "BIGINT")


def is_number(value: Column) -> Column:
    return holds(kind(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"))


def is_boolean(value: Column) -> Column:
    return holds(kind(value) == "BOOLEAN")


def is_text_list(value: Column) -> Column:
    """A JSON array holding only strings (possibly none)."""
    return holds(kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>")) & holds(
        F.forall(as_type(value, "array<string>"), lambda x: x.isNotNull()))


def as_type(value: Column, type_name: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, type_name)


def text_of(value: Column) -> Column:
    """The string held by a JSON value; null for every other JSON type."""
    return F.when(is_text(value), as_type(value, "string"))


def bool_of(value: Column) -> Column:
    return F.when(is_boolean(value), as_type(value, "boolean"))


def int_of(value: Column) -> Column:
    return F.when(is_integer(value), as_type(value, "bigint"))


def number_of(value: Column) -> Column:
    return F.when(is_number(value), as_type(value, "double"))


def has_exact_fields(obj: Column, names: Iterable[str], optional: Iterable[str] = ()) -> Column:
    """The object's key set equals ``names``, not counting ``optional`` keys."""
    keys, skip = F.map_keys(obj), list(optional)
    if skip:
        keys = F.filter(keys, lambda k: ~k.isin(skip))
    return holds(F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)]))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once.

    Later filters on a plain column would be rewritten in terms of its inputs,
    copying long expressions (and their work) into every place that uses them.
    The partition test is always true; it only tells the optimizer to leave the
    column where it is.
    """
    return df.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


def split_valid(classified: DataFrame, reason: str, keep_on_reject: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a quarantine holding ids and a reason code only.

    Rejected text is never carried into the quarantine.
    """
    valid = classified.where(F.col(reason).isNull()).drop(reason)
    quarantine = classified.where(F.col(reason).isNotNull()).select(*keep_on_reject, reason)
    return valid, quarantine
