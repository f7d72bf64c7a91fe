"""Queries that depend on order or state: live index, log stream, rate limits, batches, model output, drawing."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.operators import graph as G
from loomstone.operators import similarity as M
from loomstone.operators import signing as K
from loomstone.sources import transcripts as S
from loomstone.streaming import live as L

from .registry import query
from .retrieval import claims


@query("index_live", "SELECT session_id AS path, rowid + 1 AS rowid FROM msg m WHERE rowid + 1 > CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END")
def index_live(v):
    """Every second file has its first line indexed already; its stamp has changed since."""
    lines = S.as_transcript(v.msg).select(F.col("session_id").alias("path"), (F.col("rowid") + 1).alias("rowid"), "line")
    files = lines.groupBy("path").agg(F.max("rowid").alias("n_lines")).select("path", F.lit("2").alias("stamp"), "n_lines", F.lit(True).alias("complete"))
    cursors = files.where("cast(substring(path, 2) as bigint) % 2 = 0 and n_lines > 1").select("path", F.lit("1").alias("stamp"), F.lit(1).cast("long").alias("lines_indexed"))
    cursors = cursors.unionByName(files.where("cast(substring(path, 2) as bigint) % 2 = 0 and n_lines = 1").select("path", F.lit("2").alias("stamp"), F.lit(1).cast("long").alias("lines_indexed")))
    return L.advance(lines, files, cursors)[0].select("path", "rowid")


@query("op_stream", "SELECT 'op' || event_id AS op_id FROM events")
def op_stream(v):
    """Operations read as a stream and appended to a log exactly once."""
    spark = v.spark
    base = f"{G.shared_dir(spark)}/loomstone-stream-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    stream = spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    ops = stream.withColumn("delivery", F.explode(F.expr("case when event_id % 20 = 0 then array(0, 1) else array(0) end")))
    ops = ops.selectExpr("concat('op', event_id) op_id", "event_id * 2 + delivery seq", "event_type class", "props payload")
    L.run_log(spark, ops, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/log").select("op_id")


@query("rate_limit")
def rate_limit(v):
    return L.act_at_most_every(v.table("events").withColumn("n", F.col("event_id")), "user_id", "ts", 3600)


@query("push_batches")
def push_batches(v):
    return L.batches_of(v.log.select("machine_id", "machine_seq", "op_id", "payload"), 100, 16_384)


@query("resign_classes", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'unsigned' WHEN event_id % 7 = 0 THEN 'other_key' WHEN payload IS NULL THEN 'malformed' ELSE 'current' END AS state FROM log) GROUP BY 1""")
def resign_classes(v):
    """Signatures by state: absent, of the current key, of another key."""
    mine, other = K.signed(v.log, b"key"), K.signed(v.log, b"old").select("op_id", F.col("mac").alias("old_mac"))
    rows = mine.join(other, "op_id").withColumn("mac", F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.col("old_mac")).otherwise(F.col("mac")))
    rows = K.verified(rows, b"key")
    state = F.when(F.col("mac").isNull(), "unsigned").when(F.col("valid"), "current").when(F.col("payload").isNull(), "malformed").otherwise("other_key")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        try:
            got, _ = json.JSONDecoder().raw_decode(text, at)
            return json.dumps(got, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@query("extract_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def extract_json(v):
    """An object inside prose, braces in it that open nothing."""

    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    text = F.concat(F.lit("the answer {is: "), "props", F.lit(" } and more {}"))
    return v.table("events").select("event_id", F.get_json_object(pick(text), "$.k").cast("long").alias("k"))


@query("dream_resolution")
def dream_resolution(v):
    """Candidate pairs resolved best first; a row that was merged or superseded is not touched again.

    Of rows with equal tokens only the least takes part: the others are merged with it, or with what it is merged with at a score of
    1, before any of them has its turn. Pairs to be kept come last, so they are those of rows that are left by then."""
    sets = M.classes(claims(v))
    pairs = G.cut(M.overlapping_classes(sets.select("id", "block", "toks"), 0.60))
    fell = M.losers(pairs.where("score >= 0.8"))
    lost = fell.select("a", "b", F.when(F.col("score") >= 0.95, "merge").otherwise("supersede_b").alias("action"))
    copies = sets.where("size(ids) > 1").select("id", F.explode("ids").alias("b")).where("b <> id")
    copies = copies.join(fell.where("score = 1").select(F.col("b").alias("id"), "a"), "id", "left").select(F.coalesce("a", "id").alias("a"), "b", F.lit("merge").alias("action"))
    kept = pairs.where("score < 0.8")
    for c in "ab":
        kept = kept.join(fell.select(F.col("b").alias(c)), c, "left_anti")
    return lost.unionByName(copies).unionByName(kept.select("a", "b", F.lit("keep").alias("action")))


@query("draw_selection")
def draw_selection(v, most_nodes: int = 60, most_groups: int = 12):
    """Whole components for a drawing, largest first, skipping those that don't fit: a fold over a few hundred candidates.

    Of each size only as many as fit by themselves are candidates; the fold takes no more of them."""
    sizes = G.components(v.beliefs.select("id"), v.edges).groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("n").orderBy("component"))
    top = sizes.where(F.col("n") <= most_nodes).withColumn("place", place).where(F.col("place") <= most_nodes).where(F.col("place") * F.col("n") <= most_nodes)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "component", "n"))).alias("r"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, x: F.when(
        (acc["used"] + x["n"] <= most_nodes) & (F.size(acc["kept"]) < most_groups), F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["kept"], F.array(x["component"])).alias("kept"))
    ).otherwise(acc)
    return listed.select(F.explode(F.aggregate("r", zero, step)["kept"]).alias("component"))


@query("sample_active")
def sample_active(v):
    """A random sample of active beliefs, repeatable by its seed."""
    return v.active.orderBy(F.rand(7), "id").limit(10).select("id")


@query("tool_lines")
def tool_lines(v):
    """Tool calls and tool errors of transcripts, one compact line each."""
    call = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.substring("content", 1, 300).alias("command")).alias("input"))))
    line = F.concat(F.lit('{"type":"assistant","timestamp":"'), "ts", F.lit('","message":{"content":'), call, F.lit("}}"))
    return S.tools(S.parse(v.msg.where("role = 'assistant'").select("session_id", "rowid", line.alias("line"))))


@query("rollout_scan", "SELECT 'codex:t' || session_id AS session_id, rowid, role FROM msg WHERE role IN ('user', 'assistant') AND trim(content, ' ') <> '' AND CAST(substr(session_id, 2) AS BIGINT) % 5 <> 0")
def rollout_scan(v):
    """The second transcript dialect; every fifth file is a sub-agent's and is dropped."""
    body = F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("ts").alias("timestamp"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), F.col("content").alias("text"))).alias("content")).alias("payload")))
    said = v.msg.select("session_id", "rowid", body.alias("line"))
    n = F.expr("cast(substring(session_id, 2) as bigint)")
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("t"), "session_id").alias("id"), F.lit("/w").alias("cwd"), F.when(n % 5 == 0, F.lit("parent")).alias("parent_thread_id")).alias("payload")))
    heads = v.sessions.select("session_id", F.lit(1000).cast("long").alias("rowid"), meta.alias("line"))
    return S.rollout_messages(said.unionByName(heads)).select("session_id", "rowid", "role")


@query("header_probe", """WITH lines AS (SELECT session_id, rowid, 'T ' || content AS line FROM msg UNION ALL
    SELECT session_id, 1000, '{"type":"session_meta","payload":{"id":"t' || session_id || '"}}' FROM sessions),
    ends AS (SELECT session_id, line, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY rowid) AS e FROM lines)
    SELECT session_id, max(CASE WHEN line LIKE '{"type":"session_meta"%' AND e <= 65537 THEN 't' || session_id END) AS thread FROM ends GROUP BY 1""")
def header_probe(v):
    """Thread ids found in a bounded prefix of each file; the metadata stands after the messages."""
    said = v.msg.select("session_id", "rowid", F.concat(F.lit("T "), "content").alias("line"))
    head = F.concat(F.lit('{"type":"session_meta","payload":{"id":"t'), F.col("session_id").cast("string"), F.lit('"}}'))
    return S.header_probe(said.unionByName(v.sessions.select("session_id", F.lit(1000).cast("long").alias("rowid"), head.alias("line"))))
