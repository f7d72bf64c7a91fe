"""Queries over scrubbing, transcripts, signatures and ordered replays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomstone import constants as C
from loomstone.functions import scrub as R
from loomstone.functions import text as T
from loomstone.operators import oplog as O
from loomstone.operators import signing as G
from loomstone.sources import transcripts as S

from .registry import query

R6 = T.rounded


def _safe(pattern: str) -> str:
    return pattern.replace("'", "''")


def duck_scrub(text: str) -> str:
    """The patterns that RE2 can run: all but the connection string, whose host test looks ahead."""
    for kind, pattern in R.PATTERNS:
        if "(?=" not in pattern:
            text = f"regexp_replace({text}, '{_safe(pattern)}', '[REDACTED:{kind}]', 'g')"
    return text


#: Secrets planted into texts by id, so that every pattern meets one.
PLANT = """case doc_id % 7 when 0 then concat(text, ' sk-', substring(sha2(text, 256), 1, 30)) when 1 then concat('AKIA', upper(substring(sha2(text, 256), 1, 16)), ' ', text)
    when 2 then concat(text, ' Bearer ', sha2(text, 256)) when 3 then concat('xoxb-', substring(sha2(text, 256), 1, 12), ' ', text) when 4 then concat('npm_', substring(sha2(text, 256), 1, 36), ' ', text) else text end"""
DUCK_PLANT = """CASE doc_id % 7 WHEN 0 THEN text || ' sk-' || substr(sha256(text), 1, 30) WHEN 1 THEN 'AKIA' || upper(substr(sha256(text), 1, 16)) || ' ' || text
    WHEN 2 THEN text || ' Bearer ' || sha256(text) WHEN 3 THEN 'xoxb-' || substr(sha256(text), 1, 12) || ' ' || text WHEN 4 THEN 'npm_' || substr(sha256(text), 1, 36) || ' ' || text ELSE text END"""


def planted(v):
    return v.table("documents").where("text is not null").select("doc_id", F.expr(PLANT).alias("text"))


@query("scrub_patterns", f"SELECT doc_id, sha256({duck_scrub('t')}) AS h FROM (SELECT doc_id, {DUCK_PLANT} AS t FROM documents WHERE text IS NOT NULL)")
def scrub_patterns(v):
    return planted(v).select("doc_id", F.sha2(R.scrub_patterns(F.col("text")), 256).alias("h"))


@query("scrub_then_crop", f"SELECT doc_id, substr({duck_scrub('t')}, 1, 4000) AS message FROM (SELECT doc_id, {DUCK_PLANT} AS t FROM documents WHERE text IS NOT NULL)")
def scrub_then_crop(v):
    """Redaction comes before the message cap of 4000 characters: a secret across the cut leaves nothing behind."""
    return planted(v).select("doc_id", F.substring(R.scrub_patterns(F.col("text")), 1, C.MESSAGE_CHARS).alias("message"))


@query("scrub_full")
def scrub_full(v):
    return planted(v).select("doc_id", R.scrub(F.col("text")).alias("text"))


@query("scrub_tree")
def scrub_tree(v):
    """String leaves of JSON documents."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(R.scrub_tree)

    rows = v.table("documents").where("text is not null")
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("sk-"), F.sha2("text", 256)).alias("key"), "lang").alias("inner"), "doc_id"))
    return rows.select("doc_id", run(payload).alias("payload"))


@query("scrub_pointers", """SELECT doc_id, regexp_full_match(value, '(?:op://[^\\s,=]+|(?i:vault)(?:://|:)[^\\s,=]+|\\$\\{[A-Za-z_][A-Za-z0-9_]*\\}|\\$[A-Za-z_][A-Za-z0-9_]*|<[^<>\\s]+>)') AS pointer
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'op://vault/' || source WHEN 1 THEN '${' || source || '}' WHEN 2 THEN '<' || lang || '>' WHEN 3 THEN 'vault:' || source ELSE 'x' || source END AS value FROM documents)""")
def scrub_pointers(v):
    value = F.expr("case doc_id % 5 when 0 then concat('op://vault/', source) when 1 then concat('${', source, '}') when 2 then concat('<', lang, '>') when 3 then concat('vault:', source) else concat('x', source) end")
    return v.table("documents").select("doc_id", value.rlike(rf"^{R.POINTERS}$").alias("pointer"))


@query("hash_refs", """SELECT DISTINCT doc_id, h FROM (SELECT doc_id, unnest(string_split_regex(lower('{"a":"' || sha256(coalesce(text, '')) || '","b":"' || source || sha256(source) || '"}'), '[^0-9a-f]+')) AS h FROM documents) WHERE length(h) = 64""")
def hash_refs(v):
    """Every run of exactly 64 hex digits in a JSON text, lower case."""
    json = F.concat(F.lit('{"a":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('","b":"'), "source", F.sha2("source", 256), F.lit('"}'))
    rows = v.table("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower(json), F.lit("(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])"), F.lit(0))).alias("h"))
    return rows.distinct()


# Transcripts: conversations written as JSON lines, then read as an agent's transcript


def lines(v):
    return S.as_transcript(v.msg)


@query("scan_messages", "SELECT session_id, rowid, ts, role, substr(content, 1, 4000) AS content FROM msg WHERE role IN ('user', 'assistant') AND trim(content, ' ' || chr(10)) <> ''")
def scan_messages(v):
    rows = S.messages(S.parse(lines(v)))
    return rows.select("session_id", "rowid", "ts", "role", F.substring("content", 1, C.MESSAGE_CHARS).alias("content"))


@query("extract_text", "SELECT session_id, rowid, trim(content, ' ' || chr(10)) AS content FROM msg WHERE role IN ('user', 'assistant') AND trim(content, ' ' || chr(10)) <> ''")
def extract_text(v):
    return S.messages(S.parse(lines(v))).select("session_id", "rowid", F.col("content"))


@query("index_full", "SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (role IN ('user', 'assistant')) AS messages FROM msg WHERE session_id NOT IN (SELECT session_id FROM reviewed) GROUP BY 1")
def index_full(v):
    """Files whose stamp is known are skipped, the others make session rows anew."""
    rows = S.parse(lines(v).join(v.reviewed, "session_id", "left_anti"))
    return rows.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("role").isin("user", "assistant")).alias("messages"))


@query("trace_events")
def trace_events(v):
    """Events of each session with place, clipped scrubbed content and its hash."""
    return S.trace(S.parse(lines(v)))


# Signatures and ordered replays


@query("op_append", """SELECT 'new' || doc_id AS op_id, (SELECT max(machine_seq) FROM log WHERE machine_id = 'm1') + row_number() OVER (ORDER BY doc_id) AS machine_seq, (SELECT max(lamport) FROM log) + row_number() OVER (ORDER BY doc_id) AS lamport,
    64 AS mac_length FROM documents""")
def op_append(v):
    """Local operations with the next sequence numbers, scrubbed and signed. Their order n is dense, as a journal's is."""
    new = v.table("documents").select(F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("op_id"), (F.col("doc_id") + 1).alias("n"), F.lit("belief").alias("class"), F.lit("insert").alias("op"), F.lit("k0").alias("project_key"), F.to_json(F.struct("doc_id", "lang")).alias("payload"))
    rows = G.signed(O.append(v.log, new, "m1"), b"key")
    return rows.select("op_id", "machine_seq", "lamport", F.char_length("mac").alias("mac_length"))


@query("verify_mac", "SELECT op_id, event_id % 10 <> 0 AS valid FROM log")
def verify_mac(v):
    """Operations signed with one key; every tenth is tampered with before it is verified."""
    rows = G.signed(v.log, b"key").withColumn("payload", F.when(F.col("event_id") % 10 == 0, F.lit('{"k": -1}')).otherwise(F.col("payload")))
    return G.verified(rows, b"key").select("op_id", "valid")


@query("memory_replay")
def memory_replay(v):
    """Adds and replacements of each bucket folded in canonical order."""
    ops = v.accepted.where("class in ('memory', 'skill')").withColumn("bucket", F.col("project_key")).withColumn("entry", F.concat(F.lit("fact "), F.col("k").cast("string"), F.lit(" "), "class"))
    return G.replay(ops)


@query("bundle_roundtrip", "SELECT count(*) AS n FROM accepted")
def bundle_roundtrip(v):
    """Accepted operations, signed, written as a bundle in canonical order with a digest for every part, and read back verified."""
    return G.read_bundle(G.write_bundle(G.signed(v.accepted, b"key"), b"key"), b"key").agg(F.count("*").alias("n"))


@query("digest", """WITH hashed AS (SELECT sha256(strlen(body) || ':' || body) AS path FROM (SELECT to_json([uid, subject, status])::VARCHAR AS body FROM beliefs)),
    counted AS (SELECT path, count(*) AS n FROM hashed GROUP BY path),
    ranges AS (SELECT substr(path, 1, 5) AS path, sum(n) AS n, sha256(string_agg(path || ':' || n, chr(10) ORDER BY path)) AS d FROM counted GROUP BY 1),
    wide AS (SELECT substr(path, 1, 2) AS path, sum(n) AS n, sha256(string_agg(path || ':' || d, chr(10) ORDER BY path)) AS d FROM ranges GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, sha256(string_agg(path || ':' || d, chr(10) ORDER BY path)) AS sha256 FROM wide""")
def digest(v):
    """Order-independent SHA-256 of a projection of all beliefs."""
    return G.rows_digest(v.beliefs, ["uid", "subject", "status"])
