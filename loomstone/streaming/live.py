"""Streaming forms: live transcript index, operation log, rate limits.

Progress is a position (line count, sequence number), never event time: there is no watermark, because one would forget
old operation ids and break idempotence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.oplog import first_delivery


def advance(lines: DataFrame, files: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of the live index: (new lines, new cursors).

    lines: path, rowid (from 1), line; files: path, stamp, n_lines, complete (the last line ends in a newline);
    cursors: path, stamp, lines_indexed. An incomplete last line isn't read yet. A shorter file, or a new stamp at the same
    length, starts again; an unchanged stamp is skipped; a null cursor takes the file over from the start.
    """
    known = cursors.select("path", F.col("stamp").alias("old_stamp"), "lines_indexed")
    usable = F.col("n_lines") - F.when(F.col("complete"), 0).otherwise(1)
    plan = files.join(known, "path", "left").withColumn("usable", usable)
    again = F.col("lines_indexed").isNull() | (F.col("usable") < F.col("lines_indexed")) | ((F.col("usable") == F.col("lines_indexed")) & (F.col("stamp") != F.col("old_stamp")) & F.col("complete"))
    plan = plan.withColumn("start", F.when(again, 0).otherwise(F.col("lines_indexed")))
    fresh = plan.where("old_stamp is null or stamp <> old_stamp or lines_indexed is null")
    new = lines.join(fresh.select("path", "start", "usable"), "path").where("rowid > start and rowid <= usable").select("path", "rowid", "line", (F.col("start") == 0).alias("replaces"))
    moved = plan.select("path", "stamp", F.col("usable").cast("long").alias("lines_indexed"))
    return new, moved.unionByName(cursors.join(files, "path", "left_anti").select("path", "stamp", "lines_indexed"))


def run_log(spark: SparkSession, stream: DataFrame, log_dir: str, checkpoint: str):
    """Append each batch to the log, operations that are there already excepted. Delivery twice changes nothing:
    within a batch by the first delivery, across batches by an anti-join with the whole log; a retried batch
    overwrites its own folder."""

    def apply(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        fresh = first_delivery(batch)
        path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(log_dir)
        fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            held = s.read.option("recursiveFileLookup", "false").parquet(log_dir).where(F.col("epoch") != epoch).select("op_id")
            fresh = fresh.join(held, "op_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{log_dir}/epoch={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def act_at_most_every(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Which events act: the first sighting of a key only records, later ones act when the interval since the last act
    (or the record) has passed. Greedy, so a fold per key in order of time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "n"])
        last, acts = None, []
        for t in pdf["t"]:
            act = last is not None and t - last >= seconds
            if last is None or act:
                last = t
            acts.append(act)
        return pdf.assign(acts=acts)[["k", "t", "n", "acts"]]

    rows = events.select(F.col(key).cast("string").alias("k"), F.expr(f"unix_seconds(cast({ts} as timestamp))").alias("t"), F.col("n"))
    return rows.groupBy("k").applyInPandas(fold, "k string, t long, n long, acts boolean")


def act_at_most_every_stream(events: DataFrame, seconds: int) -> DataFrame:
    """The same rule on a stream (k string, t long): the last act of each key is kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        for pdf in batches:
            out = []
            for t in sorted(pdf["t"]):
                act = last is not None and t - last >= seconds
                if last is None or act:
                    last = t
                out.append((key[0], t, act))
            yield pd.DataFrame(out, columns=["k", "t", "acts"])
        state.update((last,))

    return events.groupBy("k").applyInPandasWithState(step, "k string, t long, acts boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def batches_of(ops: DataFrame, most_ops: int, most_bytes: int) -> DataFrame:
    """Push batches of each machine: a new one starts when the next operation would pass either bound (greedy)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("machine_seq")
        batch, n, size, out = 0, 0, 0, []
        for b in pdf["bytes"]:
            if n and (n >= most_ops or size + b > most_bytes):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + b
            out.append(batch)
        return pdf.assign(batch=out)[["machine_id", "machine_seq", "batch"]]

    rows = ops.select("machine_id", "machine_seq", F.octet_length(F.to_json(F.struct(*ops.columns))).cast("long").alias("bytes"))
    return rows.groupBy("machine_id").applyInPandas(fold, "machine_id string, machine_seq long, batch long")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
