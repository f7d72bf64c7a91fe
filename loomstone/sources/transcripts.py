"""Transcripts: JSON lines to messages, in two dialects, batch or streaming.

Columns: session_id (one per file), rowid (line number) and line. Malformed lines and non-objects are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.scrub import scrub
from loomstone.functions.text import one_line

SCHEMA = (
    "type string, timestamp string, cwd string, engine string, isMeta boolean, customTitle string, aiTitle string, sessionId string, entrypoint string, "
    "message struct<content string>"
)
BLOCKS = "array<struct<type:string,text:string,name:string,input:string,is_error:boolean,content:string>>"
ROLLOUT = (
    "type string, timestamp string, payload struct<id:string,cwd:string,parent_thread_id:string,agent_path:string,thread_source:string,type:string,role:string,"
    "content:array<struct<type:string,text:string>>>"
)
# Wrappers that hosts put around what nobody said.
BOILERPLATE = (
    r"(?s)<command-(?:message|name|args)>.*?</command-(?:message|name|args)>|<local-command-(?:caveat|stdout)>.*?</local-command-(?:caveat|stdout)>"
    r"|<system-reminder>.*?</system-reminder>|<task-notification>.*?</task-notification>"
)


def as_transcript(msg: DataFrame) -> DataFrame:
    """Messages as transcript lines: the inverse of the scan, for round trips. Every second content is a list of blocks."""
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))))
    content = F.when(F.col("rowid") % 2 == 0, F.to_json(F.struct(F.col("content").alias("c")))).otherwise(block)
    content = F.when(F.col("rowid") % 2 == 0, F.regexp_extract(content, r'(?s)^\{"c":(.*)\}$', 1)).otherwise(content)
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","timestamp":"'), "ts", F.lit('","sessionId":"'), "session_id", F.lit('","message":{"content":'), content, F.lit("}}")
    )
    return msg.select("session_id", "rowid", line.alias("line"))


def extract_text(content: Column) -> Column:
    """A string, or the text blocks of a list joined by a space; wrappers removed, trimmed."""
    blocks = F.from_json(content, BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    text = F.when(content.startswith("[") & blocks.isNotNull() & (F.size(blocks) > 0) & blocks[0]["type"].isNotNull(), joined).otherwise(content)
    return F.regexp_replace(F.regexp_replace(text, BOILERPLATE, ""), r"^\s+|\s+$", "")


def parse(lines: DataFrame) -> DataFrame:
    """One row per line that is an object: ts, role, meta flag, content as text, titles, directory."""
    d = F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.where(F.ltrim("line").startswith("{")).withColumn("d", d).where("d.type is not null")
    return rows.select(
        "session_id", "rowid", F.col("d.timestamp").alias("ts"), F.col("d.type").alias("role"), F.coalesce("d.isMeta", F.lit(False)).alias("meta"), F.col("d.cwd").alias("cwd"),
        F.col("d.customTitle").alias("custom_title"), F.col("d.aiTitle").alias("ai_title"), F.col("d.engine").alias("engine"), F.col("d.message.content").alias("raw"), extract_text(F.col("d.message.content")).alias("content"),
    )


def messages(parsed: DataFrame, redact: bool = False) -> DataFrame:
    """User and assistant messages with text. With ``redact``, secrets go before any cap is applied."""
    rows = parsed.where("role in ('user', 'assistant') and not meta and content <> ''")
    return rows.withColumn("content", scrub(F.col("content"))) if redact else rows


def sessions(parsed: DataFrame) -> DataFrame:
    """First directory wins; a custom title (the last) beats a generated one (the first); first and last timestamp."""
    place = F.col("rowid")
    return parsed.groupBy("session_id").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), place)).alias("cwd"),
        F.coalesce(F.max_by("custom_title", F.when(F.col("custom_title").isNotNull(), place)), F.min_by("ai_title", F.when(F.col("ai_title").isNotNull(), place))).alias("title"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), place)).alias("first_ts"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), place)).alias("last_ts"),
        F.count_if(F.col("role").isin("user", "assistant") & ~F.col("meta") & (F.col("content") != "")).alias("messages"),
    )


PROBE = 64 * 1024  # characters of a file that the header probe looks at


def header_probe(lines: DataFrame, most: int = PROBE) -> DataFrame:
    """(session_id, thread): the id in the first metadata record that lies whole within the first ``most`` characters of each file.

    An empty id gives way to ``session_id`` of the same record. Null where there is no such record or its id is no text.
    Lengths are summed in a window over the file; only lines within the prefix are parsed.
    """
    size = F.coalesce(F.char_length("line"), F.lit(0)) + 1
    ahead = lines.select("session_id", "rowid", "line", F.sum(size).over(Window.partitionBy("session_id").orderBy("rowid")).alias("end"))
    record = F.when((F.col("end") <= most + 1) & F.col("line").contains("session_meta"), F.try_parse_json("line"))
    rows = ahead.select("session_id", "rowid", record.alias("v")).withColumn("type", F.try_variant_get("v", "$.type", "string"))

    def text(field):
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.payload.{field}", "variant"))
        value = F.try_variant_get("v", f"$.payload.{field}", "string")
        return F.when(kind == "STRING", value), F.coalesce(kind.isin("VOID") | value.isin("", "0", "false", "[]", "{}"), F.lit(True))

    (first, empty), (second, _) = text("id"), text("session_id")
    rows = rows.select("session_id", F.when(F.col("type") == "session_meta", F.struct("rowid", F.when(empty, second).otherwise(first).alias("thread"))).alias("m"))
    return rows.groupBy("session_id").agg(F.min("m").alias("m")).select("session_id", F.nullif("m.thread", F.lit("")).alias("thread"))


def rollout_messages(lines: DataFrame) -> DataFrame:
    """The second dialect: metadata may stand anywhere in a file and is mandatory; sub-agent sessions are dropped."""
    rows = lines.where(F.ltrim("line").startswith("{")).withColumn("d", F.from_json("line", ROLLOUT)).where("d.type is not null")
    meta = rows.where("d.type = 'session_meta'").groupBy("session_id").agg(
        F.min_by("d.payload.id", "rowid").alias("thread"), F.min_by("d.payload.cwd", "rowid").alias("cwd"),
        F.bool_or(F.expr("d.payload.parent_thread_id is not null or d.payload.agent_path is not null or coalesce(d.payload.thread_source, '') = 'subagent'")).alias("internal"),
    ).where("thread is not null and cwd is not null and not internal")
    said = rows.where("d.type = 'response_item' and d.payload.type = 'message' and d.payload.role in ('user', 'assistant')")
    text = F.expr("array_join(transform(filter(d.payload.content, b -> b.type in ('input_text', 'output_text')), b -> b.text), ' ')")
    said = said.select("session_id", "rowid", F.col("d.timestamp").alias("ts"), F.col("d.payload.role").alias("role"), F.trim(text).alias("content")).where("content <> ''")
    return said.join(meta, "session_id").select(F.concat(F.lit("codex:"), "thread").alias("session_id"), "rowid", "ts", "role", "content", "cwd")


def tools(parsed: DataFrame) -> DataFrame:
    """One compact line per tool call, and error texts of tool results (280 characters each)."""
    rows = parsed.where("raw like '[%'").select("session_id", "rowid", "ts", "role", F.posexplode(F.from_json("raw", BLOCKS)).alias("pos", "b"))
    field = F.when(F.col("b.name") == "Bash", F.get_json_object("b.input", "$.command")).when(
        F.col("b.name").isin("Edit", "Write", "Read", "NotebookEdit"), F.get_json_object("b.input", "$.file_path")
    ).when(F.col("b.name") == "Skill", F.coalesce(F.get_json_object("b.input", "$.skill"), F.get_json_object("b.input", "$.name"))).otherwise(F.substring("b.input", 1, 160))
    call = (F.col("role") == "assistant") & (F.col("b.type") == "tool_use")
    fault = (F.col("role") == "user") & (F.col("b.type") == "tool_result") & F.coalesce("b.is_error", F.lit(False))
    line = F.when(call, F.concat(F.coalesce("b.name", F.lit("?")), F.lit(": "), F.substring(one_line(F.coalesce(field, F.lit(""))), 1, 280))).otherwise(F.substring(one_line(extract_text(F.col("b.content"))), 1, 280))
    return rows.where(call | fault).select("session_id", "rowid", "pos", "ts", F.when(call, "tool").otherwise("toolerr").alias("role"), line.alias("content")).where("content <> ''")


def trace(parsed: DataFrame, clip: int = 2000) -> DataFrame:
    """Events with source line, scrubbed and clipped content and a hash of what was clipped."""
    rows = parsed.where("content <> ''").withColumn("full", scrub(F.col("content")))
    return rows.select("session_id", "rowid", F.col("role").alias("kind"), F.substring("full", 1, clip).alias("content"), (F.char_length("full") > clip).alias("clipped"), F.sha2("full", 256).alias("sha256"))
