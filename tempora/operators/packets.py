"""Evidence packets and the requests, answers and reviews about them, as tables of what breaks their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.text import cited
from tempora.operators.checks import violations

MOST_EXPLANATION = 2000
VISIBLE = ("visible", "partly_visible")


def packet_violations(packets: DataFrame, evidence: DataFrame, as_of_us: int) -> DataFrame:
    """packet_id and rule of packets that cite what is unknown, foreign, in the future or out of their interval, or too much.

    packets: packet_id, episode_id, start_us, end_us, available_us, evidence_ids, max_images, max_pixels; evidence: evidence_id,
    episode_id, pts_us, available_us, width, height.
    """
    own = packets.select("*", F.explode_outer("evidence_ids").alias("evidence_id"))
    e = evidence.select("evidence_id", F.col("episode_id").alias("e_episode"), F.col("pts_us").alias("e_us"), F.col("available_us").alias("e_available"), (F.col("width") * F.col("height")).alias("e_pixels"))
    cite = own.join(e, "evidence_id", "left")
    known = F.col("evidence_id").isNull() | F.col("e_episode").isNotNull()
    in_time = (F.col("e_us") >= F.col("start_us")) & (F.col("e_us") < F.col("end_us")) & (F.col("e_us") <= as_of_us) & (F.col("e_available") <= as_of_us)
    facts = cite.groupBy("packet_id").agg(F.bool_and(known).alias("known"), F.bool_and(F.coalesce(F.col("e_episode") == F.col("episode_id"), F.lit(True))).alias("own"), F.bool_and(F.coalesce(in_time, F.lit(True))).alias("timely"), F.coalesce(F.sum("e_pixels"), F.lit(0)).alias("pixels"))
    rows = packets.join(facts, "packet_id")
    rules = {
        "interval": (F.col("start_us") >= 0) & (F.col("start_us") < F.col("end_us")) & (F.col("available_us") <= as_of_us),
        "image_budget": F.size("evidence_ids") <= F.col("max_images"),
        "unknown_citation": F.col("known"),
        "foreign_source": F.col("own"),
        "future_or_outside": F.col("timely"),
        "pixel_budget": F.col("pixels") <= F.col("max_pixels"),
    }
    return violations(rows, rules, "packet_id")


def response_violations(responses: DataFrame, packets: DataFrame) -> DataFrame:
    """Answers (packet_id, value, citations, explanation) that cite nothing or more than their packet holds, or explain at length."""
    rows = responses.join(packets.select("packet_id", "evidence_ids"), "packet_id", "left")
    rules = {"citations": (F.size("citations") > 0) & cited(F.col("citations"), F.col("evidence_ids")), "explanation": F.length("explanation") <= MOST_EXPLANATION}
    return violations(rows, rules, "packet_id")


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews (sample_id, visibility, rectangle) that have a rectangle without the object being visible, or the other way round."""
    return violations(reviews, {"rectangle": F.col("visibility").isin(*VISIBLE) == F.col("rectangle").isNotNull()}, "sample_id")


def crop_evidence(boxes: DataFrame, producer: str) -> DataFrame:
    """Boxes (frame_id, x1..y2) with the id of the crop they make and its smaller side."""
    from tempora.functions import identity

    key = identity.short_id(frame_id=F.col("frame_id"), x1=F.col("x1"), y1=F.col("y1"), x2=F.col("x2"), y2=F.col("y2"), producer=F.lit(producer))
    return boxes.withColumns({"evidence_id": key, "min_extent": F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))})


def released(evidence: DataFrame, horizon_us: int) -> DataFrame:
    """Evidence that may be shown: its moment lies within what it depends on, and it was available by the horizon."""
    return evidence.where((F.col("pts_us") <= F.col("dependency_end_us")) & (F.col("dependency_end_us") <= F.col("available_us")) & (F.col("offset_us") + F.col("available_us") <= horizon_us))
