"""Declared constraints: rows that break them, as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column], *keys: str) -> DataFrame:
    """rule and keys of each row for which a rule is false or null."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def require_none(broken: DataFrame, what: str) -> None:
    if rows := broken.limit(3).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def observation_rules() -> dict[str, Column]:
    """Clocks are whole, not negative and in order; a value is missing exactly if a reason is given."""
    e, a, c = (F.col(x) for x in ("event_us", "available_us", "committed_us"))
    return {"identity": F.col("observation_id").isNotNull(), "clocks": (e >= 0) & (e <= a) & (a <= c), "unknown_has_reason": F.col("value").isNull() == F.col("unknown_reason").isNotNull()}


def box_rules(width: float, height: float) -> dict[str, Column]:
    from tempora.functions import geometry as g

    return {"box": g.valid(g.box(), width, height), "score": (F.col("score") >= 0) & (F.col("score") <= 1)}


def in_several(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that have more than one owner, with how many: a group, lineage or content in two splits leaks."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.count(F.lit(1)).alias("n")).where("owners > 1")


def population_difference(left: DataFrame, right: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys that one side lacks or whose content differs; nulls are equal to each other."""
    a = left.select(*keys, F.struct(*content).alias("_l"), F.lit(True).alias("_in_l"))
    b = right.select(*keys, F.struct(*content).alias("_r"), F.lit(True).alias("_in_r"))
    status = F.when(F.col("_in_l").isNull(), "only_right").when(F.col("_in_r").isNull(), "only_left").when(~F.col("_l").eqNullSafe(F.col("_r")), "differs")
    return a.join(b, keys, "full").select(*keys, status.alias("status")).where("status is not null")


def require_columns(df: DataFrame, allowed: set[str]) -> DataFrame:
    """df, if its columns are exactly these: no label may slip into what a model reads."""
    if set(df.columns) != allowed:
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ allowed)}")
    return df


def setting_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Settings (key, value) that two configurations don't share alike."""
    a, b = left.select("key", F.col("value").alias("left")), right.select("key", F.col("value").alias("right"))
    return a.join(b, "key", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def matched_batch(entries: DataFrame, fixed: list[str], most: int = 128) -> DataFrame:
    """One row: whether all entries agree on what a batch must hold fixed and need few enough samples."""
    return entries.agg((F.count_distinct(F.struct(*fixed)) == 1).alias("matched"), (F.sum("samples") <= most).alias("within_budget"))


#: What a rule of each kind must name besides its id.
RULE_FIELDS = {"state_at_event": ("trigger", "expected"), "before": ("trigger", "second"), "no_event_in": ("trigger", "end_us")}


def rule_table_rules() -> dict[str, Column]:
    """A closed set of kinds, each with its own fields and no others. Columns: rule_id, kind and all fields."""
    fields = sorted({f for v in RULE_FIELDS.values() for f in v})
    own = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, v))) for k, v in RULE_FIELDS.items()])
    given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    return {"identity": F.col("rule_id").rlike("^[A-Za-z0-9_-]+$"), "kind": F.col("kind").isin(*RULE_FIELDS), "fields": F.array_sort(given) == F.array_sort(own)}


def range_rules(bounds: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    """Each column within its bounds, both included; null and not-a-number aren't."""
    return {f"{c}_range": F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & F.col(c).between(low, high) for c, (low, high) in bounds.items()}


def workload_rules(factors: list[str], most: float) -> dict[str, Column]:
    """All factors above zero, and their product bounded."""
    product = F.lit(1.0)
    for f in factors:
        product = product * F.col(f).cast("double")
    return {f"{f}_positive": F.col(f) > 0 for f in factors} | {"workload": product <= most}
