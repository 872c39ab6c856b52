"""Set operations over cases, codes, steps and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uncovered(cases: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows of cases whose key no row of groups has. A null key is covered by nothing; repeated rows stay."""
    return cases.join(groups.select(key).distinct(), key, "left_anti").select(cases.columns)


def unhandled_codes(rows: DataFrame, by: str, codes: str, handled: Column) -> DataFrame:
    """(by, code): codes that rows of a group name and none of its handled rows does. Codes are made distinct before
    they are shuffled; null lists and null codes name nothing."""
    flat = rows.select(by, F.coalesce(handled, F.lit(False)).alias("handled"), F.explode(codes).alias("code")).where("code is not null")
    return flat.groupBy(by, "code").agg(F.max("handled").alias("handled")).where(~F.col("handled")).select(by, "code")


def merged_steps(base: Column, more: Column, prefix: str) -> Column:
    """base, then each step of more that is not blank and not in base as it stands, with a prefix; null lists are empty."""
    none = F.array().cast("array<string>")
    base, more = F.coalesce(base, none), F.transform(F.coalesce(more, none), lambda s: F.trim(s))
    fresh = F.filter(more, lambda s: s.isNotNull() & (s != "") & ~F.coalesce(F.array_contains(base, s), F.lit(False)))
    return F.concat(base, F.transform(fresh, lambda s: F.concat(F.lit(prefix), s)))


def deduped_actions(actions: DataFrame, by: list[str], name: str, order: str, source: str) -> DataFrame:
    """by, name, source of the first row of each name by order, and further_sources: those of its other rows in order.

    Rows without a name give none. A group is the actions of one case, which are few; of each only order and source are
    held.
    """
    held = actions.where((F.col(name) != "") & F.col(name).isNotNull())
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(source).alias("source"))))
    first = held.groupBy(*by, name).agg(rows.alias("rows"))
    others = F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: r["source"])
    return first.select(*by, name, F.get("rows", F.lit(0))["source"].alias("source"), others.alias("further_sources"))
