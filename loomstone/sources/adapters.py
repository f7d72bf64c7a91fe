"""Store-shaped views over the test tables: messages, sessions, beliefs, evidence, outcomes, edges, operations.

All are lazy; every view reads whole tables and only the columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
START = "timestamp_ntz'2024-01-01 00:00:00'"


def iso(expr: str) -> str:
    return f'date_format({expr}, "{ISO}")'


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def msg(self) -> DataFrame:
        minutes = f"timestampadd(MINUTE, cast(conv_id * 60 + turn as int), {START})"
        return self.table("conversations").selectExpr("concat('s', conv_id) session_id", "turn rowid", "concat('p', conv_id % 4) project", "role", "coalesce(text, '') content", f"{iso(minutes)} ts")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.msg.groupBy("session_id").agg(
            F.min("project").alias("project"), F.substring(F.min_by("content", "rowid"), 1, 80).alias("title"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("messages")
        )

    @cached_property
    def reviewed(self) -> DataFrame:
        return self.sessions.where("cast(substring(session_id, 2) as bigint) % 3 = 0").select("session_id")

    @cached_property
    def beliefs(self) -> DataFrame:
        made = f"timestampadd(MINUTE, cast(doc_id % 40000 as int), {START})"
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.expr("case doc_id % 5 when 0 then 'user' when 1 then 'user-model' else concat('project:', lang) end").alias("subject"),
            F.substring(T.one_line(F.coalesce("text", F.lit(""))), 1, 300).alias("claim"),
            F.expr("cast((doc_id * 37) % 100 as double) / 100").alias("confidence"),
            F.expr("case doc_id % 10 when 7 then 'retracted' when 8 then 'dormant' when 9 then 'superseded' else 'active' end").alias("status"),
            F.expr("case when doc_id % 10 = 9 then doc_id - 9 end").alias("superseded_by"),
            F.expr(iso(made)).alias("created"),
            F.expr(iso(f"timestampadd(DAY, cast(doc_id % 30 as int), {made})")).alias("updated"),
            F.expr(f"case when doc_id % 3 <> 0 then {iso(f'timestampadd(DAY, cast(doc_id % 50 as int), {START})')} end").alias("last_referenced"),
            F.expr("case doc_id % 4 when 0 then 'agent' when 1 then 'user' end").alias("writer"),
            F.expr("case doc_id % 5 when 0 then 'approved' when 1 then 'derived' when 2 then 'dream' end").alias("via"),
            F.expr("sha2(concat('b', doc_id), 256)").alias("uid"),
        )

    @cached_property
    def active(self) -> DataFrame:
        return self.beliefs.where("status = 'active'")

    @cached_property
    def _events(self) -> DataFrame:
        # A count from the file footers, put into the plan as a literal.
        n = max(self.table("documents").count(), 1)
        rows = self.table("events").withColumn("belief_id", F.expr(f"(event_id * 7919 + user_id * 104729) % {n}L"))
        return rows.withColumn("session_id", F.expr("concat('u', user_id, '-', date_format(ts, 'yyyy-MM-dd'))"))

    @cached_property
    def evidence(self) -> DataFrame:
        return self._events.selectExpr("belief_id", "session_id", "concat('p', user_id % 4) project", "event_type note", f"{iso('ts')} created", "event_id")

    @cached_property
    def outcomes(self) -> DataFrame:
        rows = self._events.where("event_type in ('view', 'purchase', 'error')")
        return rows.selectExpr("event_id id", "belief_id", "case event_type when 'view' then 'stale' when 'purchase' then 'confirmed' else 'contradicted' end event", "session_id", f"{iso('ts')} created")

    @cached_property
    def assertions(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        rows = self._events.withColumn("from", F.lag("belief_id").over(w)).where("from <> belief_id")
        rel = "case event_type when 'view' then 'depends_on' when 'signup' then 'specializes' when 'error' then 'explains' when 'click' then 'contradicts' else 'applies_when' end"
        rows = rows.selectExpr("from src", "belief_id dst", f"{rel} rel", "session_id", f"{iso('ts')} created")
        return symmetric_first(rows).groupBy("src", "dst", "rel", "session_id").agg(F.min("created").alias("created"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.assertions.groupBy("src", "dst", "rel").agg(F.min("session_id").alias("session_id"), F.min("created").alias("created"))

    @cached_property
    def ops(self) -> DataFrame:
        kind = "case event_type when 'view' then 'session' when 'click' then 'memory' when 'error' then 'skill' else 'belief' end"
        verb = "case event_type when 'view' then 'upsert' when 'click' then 'replace' when 'error' then 'put' when 'signup' then 'insert' else 'supersede' end"
        rows = self.table("events").withColumn("machine_id", F.expr("concat('m', user_id % 5)"))
        rows = rows.withColumn("machine_seq", F.row_number().over(Window.partitionBy("machine_id").orderBy("event_id")).cast("long"))
        rows = rows.withColumn("delivery", F.explode(F.expr("case when event_id % 20 = 0 then array(0, 1) else array(0) end")))
        return rows.selectExpr(
            "event_id", "delivery", "concat('op', event_id) op_id", "machine_id", "machine_seq", "event_id div 3 + 1 lamport", f"{kind} class", f"{verb} op", "concat('k', user_id % 3) project_key",
            "props payload", "cast(get_json_object(props, '$.k') as bigint) k", f"{iso('ts')} created", "event_id % 11 <> 0 verified",
            # Arrival order: one number for each delivery, without a global window.
            "event_id + 1 + (event_id + 19) div 20 + delivery seq",
        )

    @cached_property
    def log(self) -> DataFrame:
        from loomstone.operators.oplog import first_delivery

        return first_delivery(self.ops)

    @cached_property
    def accepted(self) -> DataFrame:
        return self.log.where("verified")

    @cached_property
    def entries(self) -> DataFrame:
        lines = self.table("documents").select(F.col("source").alias("bucket"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        return lines.select("bucket", "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.trim("line").alias("entry")).where("entry <> ''")

    @cached_property
    def usage(self) -> DataFrame:
        rows = self.table("events").selectExpr("event_type name", "concat('m', user_id % 5) origin", "cast((day(ts) - 1) div 10 as bigint) generation", "value")
        return rows.groupBy("name", "origin", "generation").agg(F.count("*").alias("uses"), F.count_if(F.col("value") > 20).alias("ok"), F.count_if(F.col("value") <= 20).alias("fail"))


def symmetric_first(edges: DataFrame) -> DataFrame:
    """Symmetric relations with the lower id first."""
    swap = F.expr("rel in ('contradicts', 'co_derived') and src > dst")
    return edges.withColumns({"src": F.when(swap, F.col("dst")).otherwise(F.col("src")), "dst": F.when(swap, F.col("src")).otherwise(F.col("dst"))})
