"""Belief store: outcomes, calibration, dormancy, folds, supersession. Mutations are set-oriented folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.constants import CONTRADICTIONS_TO_DORMANT, DORMANT_BELOW, DORMANT_DAYS, OUTCOMES
from loomstone.functions import text as T


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.where(F.col("event").isin(*OUTCOMES))
    return rows.groupBy("belief_id").agg(*(F.count_if(F.col("event") == e).alias(e) for e in OUTCOMES), F.count("*").alias("total"))


def with_counts(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Beliefs with their outcome counts, 0 where there are none."""
    rows = beliefs.join(outcome_counts(outcomes).withColumnRenamed("belief_id", "id"), "id", "left")
    return rows.fillna(0, subset=[*OUTCOMES, "total"])


def calibrated(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    rows = with_counts(beliefs, outcomes)
    return rows.withColumn("posterior", T.posterior(F.col("confidence"), F.col("confirmed"), F.col("contradicted")))


def calibration_curve(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per rounded confidence: beliefs, outcomes, and the share of confirmed ones (null without outcomes)."""
    rows = with_counts(beliefs, outcomes).groupBy(F.round("confidence", 1).alias("bucket")).agg(
        F.countDistinct("id").alias("n_beliefs"), *(F.sum(e).alias(e) for e in OUTCOMES)
    )
    total = F.col("confirmed") + F.col("contradicted") + F.col("stale")
    return rows.withColumn("precision", F.when(total > 0, F.col("confirmed").cast("double") / total))


def contradicted_dormant(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status after outcomes: enough contradictions put an active belief to sleep; other statuses stay."""
    rows = with_counts(beliefs, outcomes)
    sleeps = (F.col("status") == "active") & (F.col("contradicted") >= CONTRADICTIONS_TO_DORMANT)
    return rows.withColumn("new_status", F.when(sleeps, "dormant").otherwise(F.col("status")))


def dormant_sweep(beliefs: DataFrame, now: str) -> DataFrame:
    """Active beliefs short of certain that nobody referred to for DORMANT_DAYS (real timestamps, not text)."""
    last = F.to_timestamp_ntz(F.coalesce("last_referenced", "updated"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    limit = F.expr(f"to_timestamp_ntz('{now}', \"yyyy-MM-dd'T'HH:mm:ss'Z'\") - interval {DORMANT_DAYS} days")
    return beliefs.where((F.col("status") == "active") & (F.col("confidence") < DORMANT_BELOW) & (last < limit))


def fold_exact(beliefs: DataFrame) -> DataFrame:
    """Insert or reinforce: per (subject, claim without case) the first id stays, confidence is the greatest, the rest is evidence."""
    return beliefs.groupBy("subject", T.ascii_lower(F.col("claim")).alias("claim_key")).agg(
        F.min("id").alias("id"), F.max("confidence").alias("confidence"), (F.count("*") - 1).alias("n_reinforced")
    )


def survivors(beliefs: DataFrame) -> DataFrame:
    """(old, new) of superseded beliefs whose survivor exists and isn't the belief itself."""
    old = beliefs.where("superseded_by is not null and superseded_by <> id").select(F.col("id").alias("old"), F.col("superseded_by").alias("new"))
    return old.join(beliefs.select(F.col("id").alias("new")), "new", "left_semi").select("old", "new")


def supersede(beliefs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence per belief after that of superseded ones has moved to their survivors."""
    moved = evidence.join(survivors(beliefs), F.col("belief_id") == F.col("old"), "left").withColumn("belief_id", F.coalesce("new", "belief_id"))
    return moved.groupBy("belief_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("session_id").alias("n_sessions"))


def provenance(via: str = "via", writer: str = "writer"):
    return F.when(F.col(via) == "approved", "approved").when(F.col(via).isin("derived", "dream"), F.col(via)).otherwise(F.coalesce(writer, F.lit("unknown")))
