"""Operation log: order, idempotence, admission, last writer, deferral, conflicts.

A store is a function of its log: every operator here is a plain aggregate or window over (accepted) operations, so the
order of delivery and repeated deliveries change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def canonical(prefix: str = "") -> Column:
    """The total order of operations: logical clock, machine, machine sequence; never the wall clock."""
    return F.struct(*(F.col(prefix + c) for c in ("lamport", "machine_id", "machine_seq")))


def first_delivery(ops: DataFrame) -> DataFrame:
    """One row per op_id, the first delivered. Struct minimum: pre-aggregated before the shuffle."""
    rest = [c for c in ops.columns if c != "op_id"]
    return ops.groupBy("op_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("op_id", "r.*").select(*ops.columns)


def last_writer(ops: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """The values of the last operation of each key in canonical order."""
    return ops.groupBy(*key).agg(F.max_by(F.struct(*value), canonical()).alias("v")).select(*key, "v.*")


def first_writer(ops: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    return ops.groupBy(*key).agg(F.min_by(F.struct(*value), canonical()).alias("v")).select(*key, "v.*")


def admission(ops: DataFrame, classes: list[str]) -> DataFrame:
    """state of each delivery: duplicate, unknown class (3), unverified (2), quarantined (5) or applied (1), in this order."""
    again = F.row_number().over(Window.partitionBy("op_id").orderBy("seq")) > 1
    state = F.when(again, "duplicate").when(~F.col("class").isin(classes), "unknown").when(~F.col("verified"), "unverified").when(F.col("k").isNull(), "quarantined").otherwise("applied")
    return ops.withColumn("state", state)


def slots(ops: DataFrame) -> DataFrame:
    """Per (machine, seq): operations and accepted operations; more than one accepted would be a fork."""
    return ops.groupBy("machine_id", "machine_seq").agg(F.countDistinct("op_id").alias("n_ops"), F.count_if("verified").alias("n_accepted"))


def gaps(ops: DataFrame) -> DataFrame:
    """Missing ranges of machine sequences."""
    w = Window.partitionBy("machine_id").orderBy("machine_seq")
    rows = ops.select("machine_id", "machine_seq").distinct().withColumn("before", F.coalesce(F.lag("machine_seq").over(w), F.lit(0).cast("long")))
    return rows.where("machine_seq > before + 1").selectExpr("machine_id", "before + 1 first_missing", "machine_seq - 1 last_missing")


def contiguous_prefix(chunks: DataFrame) -> DataFrame:
    """Lines held per session: chunks (session_id, from_line, to_line) apply while they touch what is held already."""
    w = Window.partitionBy("session_id").orderBy("from_line", "to_line")
    rows = chunks.withColumn("held", F.coalesce(F.max("to_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    rows = rows.withColumn("broken", F.max((F.col("from_line") > F.col("held") + 1).cast("int")).over(w))
    return rows.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(F.col("broken") == 0, F.col("to_line"))), F.lit(0).cast("long")).alias("lines_held"), F.sum("broken").cast("long").alias("chunks_waiting")
    )


def replace_conflicts(ops: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one machine replaced at the same logical time: both texts survive, a conflict is noted."""
    return ops.groupBy(*key, "lamport").agg(F.countDistinct("machine_id").alias("n_machines"), F.min("payload").alias("a_text"), F.max("payload").alias("b_text")).where("n_machines > 1")


def deferred(ops: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """Operations that still wait when no more can be applied: one is applied when its ``ref`` is known, and makes its ``uid`` known.

    Each round joins with what the round before made known; null refs wait for ever."""
    waiting, front = cut(ops), known.select(F.col("uid").alias("ref")).distinct()
    for _ in range(most):
        ready = cut(waiting.join(front, "ref", "left_semi").select("uid"))
        if ready.isEmpty():
            return waiting
        waiting = cut(waiting.join(front, "ref", "left_anti").select(*ops.columns))
        front = ready.select(F.col("uid").alias("ref")).distinct()
    raise RuntimeError(f"operations did not settle in {most} rounds")


def append(log: DataFrame, new: DataFrame, machine: str) -> DataFrame:
    """New local operations (n, op_id, class, op, project_key, payload) with the next sequence numbers and clock values.

    The log's greatest values are one row; places inside the batch come from its own order n, so a batch of any size
    costs one aggregate. Payloads are scrubbed before they are signed or stored."""
    from loomstone.functions.scrub import scrub

    top = log.agg(F.coalesce(F.max(F.when(F.col("machine_id") == machine, F.col("machine_seq"))), F.lit(0)).alias("s"), F.coalesce(F.max("lamport"), F.lit(0)).alias("l"))
    rows = new.crossJoin(F.broadcast(top))
    return rows.select("op_id", F.lit(machine).alias("machine_id"), (F.col("s") + F.col("n")).alias("machine_seq"), (F.col("l") + F.col("n")).alias("lamport"), "class", "op", "project_key", scrub(F.col("payload")).alias("payload"))


def put_or_remove(ops: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Last put of each key, unless a removal comes after it."""
    last = last_writer(ops, key, ["op", *value])
    return last.where("op = 'put'").drop("op")
