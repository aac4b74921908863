"""What a bounded queue would hold when a job is offered, as facts from windows: no queue is run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def admission_facts(jobs: DataFrame, run: str, budget_us: int, max_jobs: int, max_bytes: int) -> DataFrame:
    """run, job_id, open_jobs and open_bytes (of jobs offered in the last budget_us, whose deadline is still to come), the same of
    mandatory ones, and verdict: admitted within both bounds; by_eviction for a mandatory job that fits beside the mandatory ones
    alone; else refused.

    jobs: run, job_id, offered_us, input_bytes, mandatory. A job whose deadline is the moment of an offer is closed by then; jobs
    offered at the same moment count for each other. When open jobs end early isn't known here, so these are upper bounds.
    """
    recent = W.partitionBy(run).orderBy("offered_us").rangeBetween(1 - budget_us, 0)
    must = F.col("mandatory").cast("long")
    facts = jobs.withColumns({
        "open_jobs": F.count(F.lit(1)).over(recent) - 1,
        "open_bytes": F.sum("input_bytes").over(recent) - F.col("input_bytes"),
        "mandatory_jobs": F.sum(must).over(recent) - must,
        "mandatory_bytes": F.sum(F.col("input_bytes") * must).over(recent) - F.col("input_bytes") * must,
    })
    fits = lambda kind: (F.col(f"{kind}_jobs") < max_jobs) & (F.col(f"{kind}_bytes") + F.col("input_bytes") <= max_bytes)
    verdict = F.when(fits("open"), "admitted").when(F.col("mandatory") & fits("mandatory"), "by_eviction").otherwise("refused")
    return facts.select(run, "job_id", "open_jobs", "open_bytes", "mandatory_jobs", "mandatory_bytes", verdict.alias("verdict"))
