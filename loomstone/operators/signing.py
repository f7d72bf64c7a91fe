"""Signed operations, bundles, and replays that depend on order."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oplog import canonical

SIGNED = ("op_id", "machine_id", "machine_seq", "lamport", "class", "op", "project_key")


def mac_of(key: bytes, row: tuple, payload: str | None) -> str:
    """HMAC-SHA256 over the canonical JSON of the eight signed fields: sorted keys, no white space, unescaped Unicode."""
    body = json.dumps([*row, json.loads(payload) if payload else None], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hmac.new(key, body.encode("utf-8"), hashlib.sha256).hexdigest()


def _macs(key: bytes):
    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        cells = [[None if pd.isna(x) else int(x) if c in ("machine_seq", "lamport") else x for x in rows[c]] for c in SIGNED]
        return pd.Series([mac_of(key, r, p) for r, p in zip(zip(*cells), rows["payload"])], dtype=object)

    return run(F.struct(*SIGNED, "payload"))


def signed(ops: DataFrame, key: bytes) -> DataFrame:
    return ops.withColumn("mac", _macs(key))


def verified(ops: DataFrame, key: bytes) -> DataFrame:
    """valid: the MAC is the one of the row; an absent MAC is a wrong one."""
    return ops.withColumn("valid", F.coalesce(F.col("mac") == _macs(key), F.lit(False)))


def _or_fail(holds, message: str):
    """A condition that stops the query where it doesn't hold."""
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def write_bundle(ops: DataFrame, key: bytes, parts: int = 16) -> DataFrame:
    """Rows (part, parts, n, sha256, body): signed operations as JSON lines in canonical order; parts are hash ranges of op_id, so
    none holds the log. An operation whose MAC isn't the one under ``key`` stops the export."""
    ops = verified(ops, key).where(_or_fail(F.col("valid"), "an operation isn't signed by this key; no bundle is written"))
    line = F.to_json(F.struct("op_id", "machine_id", "machine_seq", "lamport", "class", "op", "project_key", "payload", "mac"))
    rows = ops.select(F.expr(f"pmod(xxhash64(op_id), {parts})").alias("part"), F.struct(canonical().alias("o"), line.alias("line")).alias("x"))
    rows = rows.groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = rows.select("part", F.lit(parts).alias("parts"), F.size("xs").alias("n"), F.expr("array_join(transform(xs, x -> x.line), '\n')").alias("body"))
    return rows.withColumn("sha256", F.sha2("body", 256))


def read_bundle(bundle: DataFrame, key: bytes) -> DataFrame:
    """Operations of a bundle; the read fails if a part's digest or count is wrong, an operation repeats, stands in a part that isn't
    its own, or isn't signed by ``key``."""
    intact = (F.sha2("body", 256) == F.col("sha256")) & (F.size(F.split("body", "\n")) == F.col("n"))
    schema = "op_id string, machine_id string, machine_seq long, lamport long, class string, op string, project_key string, payload string, mac string"
    text = F.concat(F.lit("["), F.array_join(F.split("body", "\n"), ","), F.lit("]"))
    lines = bundle.where(_or_fail(intact, "bundle part is damaged")).select("part", "parts", "n", F.from_json(text, f"array<struct<{schema}>>").alias("os"))
    own = F.expr("size(array_distinct(os.op_id)) = n and forall(os, o -> o.op_id is not null and pmod(xxhash64(o.op_id), parts) = part)")
    ops = lines.where(_or_fail(F.coalesce(own, F.lit(False)), "bundle repeats or misplaces an operation")).select(F.explode("os").alias("o")).select("o.*")
    return verified(ops, key).where(_or_fail(F.col("valid"), "bundle holds an operation that isn't signed by this key")).drop("valid", "mac")


def export_bundle(ops: DataFrame, key: bytes, path: str) -> None:
    """Write a bundle as Parquet to a new folder; an existing one is never overwritten."""
    write_bundle(ops, key).write.mode("error").parquet(path)


def import_bundle(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """Operations of the bundle at ``path``, handed out only after the whole of it has been validated."""
    bundle = spark.read.parquet(path)
    if not bundle.groupBy("part").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        raise ValueError("bundle repeats a part")
    read_bundle(bundle, key).agg(F.count("*")).first()
    return read_bundle(bundle, key)


#: Hexadecimal digits that tell the ranges of each level of a digest: a million ranges of rows, 256 of ranges, one.
LEVELS = (5, 2, 0)


def rows_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, sha256) of the multiset of rows, whatever their order and partitions; one row, also for an empty table.

    A row is the JSON array of its columns as text (null stays null) behind its length in bytes. Equal rows are counted
    before the shuffle; the SHA-256 of rows are sorted and digested by range of hash, ranges by range of ranges,
    so a task gathers a millionth of the distinct rows or 4096 digests.
    """
    body = F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))
    rows = df.select(F.sha2(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), 256).alias("path"))
    rows = rows.groupBy("path").agg(F.count("*").alias("n")).withColumn("line", F.concat("path", F.lit(":"), F.col("n").cast("string")))
    for digits in LEVELS:
        lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
        rows = rows.groupBy(*([F.substring("path", 1, digits).alias("path")] if digits else [])).agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("sha256"))
        if digits:
            rows = rows.withColumn("line", F.concat("path", F.lit(":"), "sha256"))
    return rows.select(F.coalesce("n", F.lit(0)).alias("n"), "sha256")


def replay(ops: DataFrame) -> DataFrame:
    """(bucket, place, entry) after adds ('put') and replacements ('replace' of key k) in canonical order.

    Adds of a text that is there change nothing; a replacement takes the place of its key's entry or is added."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        entries: list[str] = []
        place: dict[int, int] = {}  # first entry of each key; a null key has none
        there: Counter[str] = Counter()
        for r in pdf.sort_values(["lamport", "machine_id", "machine_seq"]).itertuples():
            at, low = place.get(r.k), r.entry.lower()
            if r.op == "replace" and at is not None:
                there[entries[at].lower()] -= 1
                entries[at] = r.entry
                there[low] += 1
            elif not there[low]:
                if not pd.isna(r.k):
                    place.setdefault(r.k, len(entries))
                entries.append(r.entry)
                there[low] += 1
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]] * len(entries), "place": range(len(entries)), "entry": entries})

    return ops.select("bucket", "lamport", "machine_id", "machine_seq", "k", "op", "entry").groupBy("bucket").applyInPandas(fold, "bucket string, place long, entry string")


def page_token(key: bytes, last: int, expires: int) -> str:
    """An opaque cursor: the last key served and an expiry, signed together."""
    body = f"{last}.{expires}"
    return f"{body}.{hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}"


def read_token(key: bytes, token: str, now: int) -> int:
    """The last key of a token; a forged or expired one is refused."""
    last, expires, mac = token.split(".")
    if not hmac.compare_digest(mac, page_token(key, int(last), int(expires)).rsplit(".", 1)[1]):
        raise ValueError("cursor was not issued here")
    if now > int(expires):
        raise ValueError("cursor has expired")
    return int(last)
