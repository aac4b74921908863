"""Recorded programs and scenes: plans, action exports, fixed windows, placements and endpoint rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions import identity
from tempora.operators.checks import require_none

#: The action whose time fixes a family's window.
WINDOW_ACTIONS = {"door": ["OPEN"], "pickup": ["GRAB"], "posture": ["SIT"], "switch": ["SWITCHON", "SWITCHOFF"]}


def planned(groups: DataFrame, families: DataFrame, variants: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Every group with every family and variant, under an id of its own content: dimension tables of a configuration's size."""
    rows = groups.crossJoin(F.broadcast(families)).crossJoin(F.broadcast(variants))
    key = identity.prefixed_id(F.lit("ep"), name=F.lit(name), group=F.col("group"), family=F.col("family"), variant=F.col("variant"))
    plan = rows.select(key.alias("episode_id"), "group", "family", "variant")
    if most is not None:
        require_none(plan.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "too many episodes")
    return plan


def action_rows(export: DataFrame) -> DataFrame:
    """program_index, action, raw_start, raw_end of each line "index ACTION start end" (episode_id, line_no, line); blank lines are skipped."""
    lines = export.withColumn("_f", F.split(F.trim("line"), r"\s+")).where(F.trim("line") != "")
    require_none(lines.where((F.size("_f") != 4) | ~F.element_at("_f", 1).rlike(r"^\d+$")), "malformed action rows")
    number = lambda i: F.element_at("_f", i).cast("long")
    return lines.select("episode_id", "line_no", number(1).alias("program_index"), F.upper(F.element_at("_f", 2)).alias("action"), number(3).alias("raw_start"), number(4).alias("raw_end"))


def action_interiors(rows: DataFrame, episodes: DataFrame, guard: int) -> DataFrame:
    """Rows with the frames that surely belong to them: their span less a guard at both ends, null where nothing is left.

    episodes: episode_id, frames, fps, steps. Rows out of range or out of order and interiors that overlap raise.
    """
    at = W.partitionBy("episode_id").orderBy("line_no")
    r = rows.join(episodes, "episode_id")
    in_range = (F.col("program_index") < F.col("steps")) & (F.col("raw_start") >= 0) & (F.col("raw_start") <= F.col("raw_end")) & (F.col("raw_end") <= F.col("frames"))
    require_none(r.where(~in_range), "action rows out of range")
    require_none(r.withColumn("_before", F.lag("raw_start").over(at)).where("raw_start < _before"), "action rows out of order")
    lo, hi = F.col("raw_start") + guard, F.least("frames", F.col("raw_end") - guard)
    inner = r.withColumns({"lo": F.when(hi > lo, lo), "hi": F.when(hi > lo, hi)})
    order = W.partitionBy("episode_id").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    require_none(inner.where("lo is not null").withColumn("_reach", F.max("hi").over(order)).where("lo < _reach"), "overlapping interiors")
    us = lambda c: F.floor(F.col(c) * 1_000_000 / F.col("fps")).cast("long")
    return inner.select(*rows.columns, F.col("lo").alias("start_frame"), F.col("hi").alias("end_frame"), us("lo").alias("start_us"), us("hi").alias("end_us"))


def fixed_windows(episodes: DataFrame, actions: DataFrame, count: int = 20) -> DataFrame:
    """The window of `count` frames of each episode (episode_id, frames, family, condition): its last frames where the interaction is absent, else about its action, or up to the action's end for a posture."""
    require_none(episodes.where(F.col("frames") < count), "sources shorter than a window")
    wanted = F.create_map(*[x for k, names in WINDOW_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    first = episodes.join(actions, "episode_id").where(F.array_contains(F.element_at(wanted, F.col("family")), F.col("action"))).groupBy("episode_id").agg(F.min_by(F.struct("action", "raw_start", "raw_end"), "line_no").alias("a"))
    rows = episodes.join(first, "episode_id", "left")
    absent = F.col("condition") == "approach_only"
    require_none(rows.where(~absent & F.col("a").isNull()), "no action to place a window by")
    middle = F.floor((F.col("a.raw_start") + F.col("a.raw_end")) / 2) - count // 2
    start = F.when(absent, F.col("frames") - count).when(F.col("family") == "posture", F.col("a.raw_end") - count).otherwise(middle)
    start = F.greatest(F.lit(0), F.least(F.col("frames") - count, start)).cast("long")
    return rows.select("episode_id", start.alias("start_frame"), (start + count).alias("end_frame"), F.when(absent, "target_interaction_absent").otherwise(F.col("a.action")).alias("reason"))


def openable_inside(nodes: DataFrame, edges: DataFrame, room_class: str, class_name: str) -> DataFrame:
    """Of each scene, the openable object of a class inside a room, of several the one of the lowest id: scene_id, id, states."""
    room = nodes.where((F.col("category") == "Rooms") & (F.col("class_name") == room_class)).select("scene_id", F.col("id").alias("to_id"))
    inside = edges.where("relation_type = 'INSIDE'").join(room, ["scene_id", "to_id"]).select("scene_id", F.col("from_id").alias("id"))
    match = nodes.where((F.col("class_name") == class_name) & F.array_contains("properties", "CAN_OPEN")).join(inside, ["scene_id", "id"], "left_semi")
    return match.groupBy("scene_id").agg(F.min_by(F.struct("id", "states"), "id").alias("m")).select("scene_id", "m.id", "m.states")


def endpoint_verdicts(episodes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PASS where the target is closed at an episode's end, VIOLATION where it is open. episodes: scene_id, actor_id, target_id, destination_id, expected_closed.

    An actor that didn't arrive, a door neither or both open and closed, and an end other than expected raise.
    """
    target = nodes.select("scene_id", F.col("id").alias("target_id"), "states")
    arrived = edges.where("relation_type = 'INSIDE'").select("scene_id", F.col("from_id").alias("actor_id"), F.col("to_id").alias("destination_id"), F.lit(True).alias("arrived")).distinct()
    rows = episodes.join(target, ["scene_id", "target_id"], "left").join(arrived, ["scene_id", "actor_id", "destination_id"], "left")
    closed, opened = F.coalesce(F.array_contains("states", "CLOSED"), F.lit(False)), F.coalesce(F.array_contains("states", "OPEN"), F.lit(False))
    require_none(rows.where("arrived is null"), "the actor didn't reach its destination")
    require_none(rows.where(closed == opened), "an ambiguous door")
    require_none(rows.where(closed != F.col("expected_closed")), "an end other than was meant")
    return rows.select("scene_id", F.when(closed, "PASS").otherwise("VIOLATION").alias("verdict"))


def rotation(position: list[Column], look_at: list[Column]) -> list[Column]:
    """Pitch and yaw in degrees of a camera that looks from one point to another; it doesn't roll."""
    dx, dy, dz = [b - a for a, b in zip(position, look_at, strict=True)]
    return [F.degrees(F.atan2(-dy, F.hypot(dx, dz))), F.degrees(F.atan2(dx, dz)), F.lit(0.0)]


def reversed_frames(frames: Column) -> Column:
    """An intervention that keeps the slots' times: the frames the other way round."""
    return F.reverse(frames)


def repeated_first(frames: Column) -> Column:
    """An intervention: the first frame in every slot."""
    return F.array_repeat(F.element_at(frames, 1), F.size(frames))


def relative_positions(n: Column, shares: tuple[float, ...]) -> Column:
    """Places from 0 at shares of the way through n items; halves go to the even place."""
    return F.array_distinct(F.array(*[F.bround((n - 1) * s).cast("long") for s in shares]))
