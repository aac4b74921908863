"""Sequence operators over rows in order: runs, transitions and automata, each as windows over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(order):
    return order.rowsBetween(W.unboundedPreceding, 0)


def numbered_runs(df: DataFrame, starts_new: Column, keys: list[str], order: str, run: str = "run") -> DataFrame:
    """Adds the number of the run that a row is in, counted from where starts_new holds."""
    at = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_new", starts_new.cast("int")).withColumn(run, F.sum("_new").over(running(at))).drop("_new")


def valid_runs(cells: DataFrame, valid: Column, order: str = "frame_index") -> DataFrame:
    """Unbroken stretches of valid rows: episode_id, first, last, length."""
    at = W.partitionBy("episode_id").orderBy(order)
    place = cells.withColumn("_valid", valid).withColumn("_island", F.row_number().over(at) - F.sum(F.col("_valid").cast("int")).over(running(at)))
    return place.where("_valid").groupBy("episode_id", "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def state_runs(cells: DataFrame, label: str, order: str = "frame_index") -> DataFrame:
    """Runs of one label in adjacent rows: episode_id, label, first, last, start_us, end_us."""
    at = W.partitionBy("episode_id").orderBy(order)
    new = F.lag(label).over(at).isNull() | (F.lag(label).over(at) != F.col(label))
    runs = numbered_runs(cells, F.coalesce(new, F.lit(True)), ["episode_id"], order)
    return runs.groupBy("episode_id", "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("pts_us").alias("start_us"), F.max("pts_us").alias("end_us")).drop("run")


def transitions(cells: DataFrame, label: str, max_gap_us: int, order: str = "frame_index") -> DataFrame:
    """Changes from one known label to the next row's, if that is known too and near enough; unknown rows break."""
    at = W.partitionBy("episode_id").orderBy(order)
    before, since = F.lag(label).over(at), F.lag("pts_us").over(at)
    seen = cells.select("episode_id", since.alias("from_us"), F.col("pts_us").alias("to_us"), before.alias("before"), F.col(label).alias("after"))
    return seen.where((F.col("before") != F.col("after")) & (F.col("to_us") - F.col("from_us") <= max_gap_us))


def departures(cells: DataFrame, present: Column, arm: int = 3, absent: int = 3) -> DataFrame:
    """Events where something seen for `arm` rows is then gone for `absent`: episode_id, event_us, available_us, first, confirmation.

    The event is at the first row without it and is known at the one that confirms. After an event it must be seen for `arm`
    rows again. Runs of presence and absence are islands; an absence fires if a long enough presence came since the last one
    that was long enough to fire.
    """
    at = W.partitionBy("episode_id").orderBy("frame_index")
    rows = cells.select("episode_id", "frame_index", "pts_us", present.alias("present"))
    changed = F.coalesce(F.lag("present").over(at) != F.col("present"), F.lit(True))
    runs = numbered_runs(rows, changed, ["episode_id"], "frame_index")
    place = W.partitionBy("episode_id", "run").orderBy("frame_index")
    runs = runs.withColumn("_rn", F.row_number().over(place))
    confirm = lambda c: F.max(F.when(F.col("_rn") == absent, F.col(c)))
    islands = runs.groupBy("episode_id", "run", "present").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("first"), F.min("pts_us").alias("event_us"), confirm("frame_index").alias("confirmation"), confirm("pts_us").alias("available_us"))
    order = W.partitionBy("episode_id").orderBy("run")
    armed = islands.withColumn("armed", F.sum((F.col("present") & (F.col("n") >= arm)).cast("int")).over(running(order)))
    lasting = armed.where(~F.col("present") & (F.col("n") >= absent))
    fires = lasting.withColumn("_before", F.lag("armed", 1, 0).over(order)).where(F.col("armed") > F.col("_before"))
    return fires.select("episode_id", "event_us", "available_us", "first", "confirmation")


def with_resets(cells: DataFrame, max_gap_us: int, order: str = "frame_index") -> DataFrame:
    """Adds `segment`, which changes wherever the time between rows is too long."""
    at = W.partitionBy("episode_id").orderBy(order)
    return numbered_runs(cells, F.coalesce(F.col("pts_us") - F.lag("pts_us").over(at) > max_gap_us, F.lit(False)), ["episode_id"], order, "segment")


def hysteresis(cells: DataFrame, label: str, persistence_us: int, max_gap_us: int, order: str = "frame_index") -> DataFrame:
    """Adds `state`: the label that has last held for persistence_us, or -1.

    A missing label or too long a gap forgets everything before; the start needs persistence too.
    """
    at = W.partitionBy("episode_id").orderBy(order)
    reset = F.col(label).isNull() | F.lag(label).over(at).isNull() | (F.col("pts_us") - F.lag("pts_us").over(at) > max_gap_us)
    rows = numbered_runs(cells, F.coalesce(reset, F.lit(True)), ["episode_id"], order, "_segment")
    inside = W.partitionBy("episode_id", "_segment").orderBy(order)
    rows = numbered_runs(rows, F.coalesce(F.lag(label).over(inside) != F.col(label), F.lit(True)), ["episode_id", "_segment"], order, "_island")
    since = F.min("pts_us").over(W.partitionBy("episode_id", "_segment", "_island"))
    confirmed = rows.withColumn("_confirmed", F.when(F.col("pts_us") - since >= persistence_us, F.col(label)))
    state = F.coalesce(F.last("_confirmed", ignorenulls=True).over(running(inside)), F.lit(-1))
    return confirmed.withColumn("state", F.when(F.col(label).isNull(), -1).otherwise(state)).drop("_segment", "_island", "_confirmed")


def causal_dependencies(cells: DataFrame, valid: Column, evidence: str, available: str, order: str = "frame_index") -> DataFrame:
    """For each valid row: when a prefix decoder may publish it, when an offline one may, and the evidence each depends on."""
    at = W.partitionBy("episode_id").orderBy(order)
    rows = cells.withColumn("_valid", valid)
    rows = numbered_runs(rows, F.coalesce(F.lag("_valid").over(at) != F.col("_valid"), F.lit(True)), ["episode_id"], order).where("_valid")
    run = W.partitionBy("episode_id", "run")
    prefix = running(run.orderBy(order))
    return rows.select("episode_id", order, F.max(available).over(prefix).alias("prefix_available_us"), F.max(available).over(run).alias("offline_available_us"), F.count(evidence).over(prefix).alias("prefix_evidence"), F.count(evidence).over(run).alias("run_evidence"))


def transition_prior(cells: DataFrame, label: str, classes: DataFrame, order: str = "frame_index") -> DataFrame:
    """Log probabilities of one known label after another in adjacent rows, over all pairs of classes, each counted once more."""
    at = W.partitionBy("episode_id").orderBy(order)
    counted = cells.select(F.lag(label).over(at).alias("before"), F.col(label).alias("after")).where("before is not null and after is not null").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    grid = classes.select(F.col("class").alias("before")).crossJoin(F.broadcast(classes.select(F.col("class").alias("after"))))  # classes squared
    full = grid.join(F.broadcast(counted), ["before", "after"], "left").select("before", "after", (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("n"))
    return full.select("before", "after", F.ln(F.col("n") / F.sum("n").over(W.partitionBy("before"))).alias("log_p"))


def edit_score(prediction: Column, truth: Column) -> Column:
    """1 - edit distance / longer length, of labels written one character each."""
    longer = F.greatest(F.length(prediction), F.length(truth), F.lit(1))
    return 1 - F.levenshtein(prediction, truth) / longer


def out_of_order(steps: DataFrame, prerequisites: dict[str, list[str]], step: str, keys: list[str], order: str, gap: Column | None = None) -> DataFrame:
    """Rows whose step came before one that it needs: with `missing`, the needed steps not seen so far, and status.

    The status is wrong_order; where gap (what came before a row may not have been observed) has held in the row or before it,
    only uncertain. Each needed step is one running maximum, whatever a group's length.
    """
    so_far = running(W.partitionBy(*keys).orderBy(order))
    needed = sorted({n for v in prerequisites.values() for n in v})
    seen = {n: f"_seen_{i}" for i, n in enumerate(needed)}
    marked = steps.withColumns({c: F.max((F.col(step) == n).cast("int")).over(so_far) for n, c in seen.items()} | {"_gap": F.max((F.lit(False) if gap is None else gap).cast("int")).over(so_far)})
    wanted = F.coalesce(*[F.when(F.col(step) == k, F.array(*[F.when(F.col(seen[n]) == 0, F.lit(n)) for n in sorted(v)])) for k, v in prerequisites.items()])
    found = marked.withColumn("missing", F.array_compact(wanted)).where(F.size("missing") > 0)
    return found.withColumn("status", F.when(F.col("_gap") == 1, "uncertain").otherwise("wrong_order")).drop("_gap", *seen.values())


def persistence_gate(cells: DataFrame, score: str, high: float, low: float, hold_us: int, order: str = "pts_us") -> DataFrame:
    """normal, possible or incident for each row: an incident is declared once a score stays high for hold_us, and ends below low."""
    at = W.partitionBy("episode_id").orderBy(order)
    mark = F.when(F.col(score) >= high, "high").when(F.col(score) < low, "low")
    held = cells.withColumn("_mark", F.last(mark, ignorenulls=True).over(running(at)))
    runs = numbered_runs(held, F.coalesce(F.lag("_mark").over(at) != F.col("_mark"), F.lit(True)), ["episode_id"], order, "_run")
    inside = W.partitionBy("episode_id", "_run").orderBy(order)
    dip = F.sum((F.col(score) < high).cast("int")).over(running(inside))
    runs = runs.withColumn("_stretch", dip)
    since = F.min(F.when(F.col(score) >= high, F.col(order))).over(W.partitionBy("episode_id", "_run", "_stretch"))
    long = F.max(((F.col(score) >= high) & (F.col(order) - since >= hold_us)).cast("int")).over(running(inside))
    state = F.when(F.coalesce(F.col("_mark"), F.lit("low")) == "low", "normal").when(long == 1, "incident").otherwise("possible")
    return runs.withColumn("state", state).drop("_mark", "_run", "_stretch")
