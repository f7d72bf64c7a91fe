"""Operator 6: document fingerprints, canonical exact digest, DataFrame functions only.

Canonical form: NFKC, lower case, NFKC again, runs of white space as one space, trimmed. The fingerprint is wide: two
xxhash64 with different seeds (32 hex digits). Rows with equal digests form a bucket whose canonical forms are
compared byte by byte (least and greatest must be equal, a comparison that pre-aggregates). Where a bucket holds
different forms, its fingerprints get the SHA-256 of the form as suffix, so equal fingerprints mean equal forms.

Likeness of two exact digests is 1 or 0. Null texts are empty. The next document follows in descending (doc_id, hash of
the text), a null doc_id last; after the last comes the first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

RANGE_ROWS, RANGES = 512, 250_000  # rows of a range; most ranges: bounds the broadcast of their first rows
SAMPLED = 8  # rows sampled for each range: at most RANGES * SAMPLED * 24 bytes reach the driver
SMALL = 500_000  # rows of 40 bytes that are broadcast; above, the join shuffles


def canonical(text: Column) -> Column:
    """NFKC, lower case and white space folded; plain ASCII needs no normalisation."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(F.lower(nfkc(text)))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide(canon: Column) -> Column:
    """128 bits: the second hash starts from another seed."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(canon))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("second"), canon))), 16, "0"))


def place() -> Column:
    """The order of rows as one comparable value: null ids are the least."""
    return F.struct(F.col("id").isNotNull().cast("int").alias("v"), F.coalesce("id", F.lit(0)).alias("id"), F.col("tie").alias("tie"))


def ranges(rows: DataFrame) -> Column:
    """The range of each row, monotone in (id, tie): bounds are quantiles of a sample that a hash of (id, tie) takes, so outliers, null
    ids and repeated ids make no range larger; rows equal in both are in one range. A range is found in two steps over sorted bounds."""
    n = rows.count()
    k = max(1, min(RANGES, n // RANGE_ROWS))
    every = max(1, n // (k * SAMPLED))
    places = [tuple(r[0]) for r in rows.where(F.pmod(F.xxhash64("id", "tie", F.lit(5)), F.lit(every)) == 0).select(place().alias("p")).distinct().collect()]
    places.sort()
    bounds = sorted({places[len(places) * i // k] for i in range(1, k)}) if places else []
    if not bounds:
        return F.lit(0).cast("long")
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = "array<struct<v:int,id:bigint,tie:bigint>>"
    told = lambda rows: [{"v": v, "id": i, "tie": t} for v, i, t in rows]
    first = F.from_json(F.lit(json.dumps(told(b[0] for b in blocks))), kind)
    all_ = F.from_json(F.lit(json.dumps([told(b) for b in blocks])), f"array<{kind}>")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= place()))
    block = below(first)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + below(F.element_at(all_, block))).cast("long")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """``next_<c>`` of each carried column: the row after in descending (id, tie), the last followed by the first.

    The first row of each range is dealt to the range before as well, so that one shuffle by range and one window
    do the rest.
    """
    rows = rows.withColumn("range", ranges(rows))
    heads = rows.groupBy("range").agg(F.max(F.struct(place().alias("p"))).alias("head"))
    down = Window.orderBy(F.desc("range"))  # over the ranges, RANGES at most
    top = F.max("head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chain = heads.select(F.col("range").alias("to"), F.coalesce(F.lead("head").over(down), top).alias("h"))
    chain = F.broadcast(chain.select(F.col("h.p.v").alias("h_v"), F.col("h.p.id").alias("h_id"), F.col("h.p.tie").alias("h_tie"), "to"))
    joined = (place()["v"] == chain["h_v"]) & (place()["id"] == chain["h_id"]) & (rows["tie"] == chain["h_tie"])
    dealt = rows.join(chain, joined, "left").drop("h_v", "h_id", "h_tie")
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("borrowed"))
    there = F.struct(F.col("to").alias("range"), F.lit(1).alias("borrowed"))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there)))).drop("range", "to")
    w = Window.partitionBy("place.range").orderBy("place.borrowed", F.desc_nulls_last("id"), F.desc("tie"))
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return out.where("place.borrowed = 0").drop("place")


def conflicts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Digests (column wide) that stand for more than one canonical form, found by comparing bytes."""
    several = scratch.keep(rows.groupBy("wide").agg(F.count("*").alias("c")).where("c > 1").select("wide"), "buckets")
    same = rows.select("wide", "canon").join(F.broadcast(several) if several.count() <= SMALL else several, "wide")
    found = same.groupBy("wide").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("wide")
    return scratch.keep(found, "conflicts")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs`` (doc_id, text);
    other columns are ignored, whatever their names.

    Rows that repeat a doc_id follow each other by a hash of their texts, rows equal in both in any order (they are alike). No rows
    give no rows; a single row is its own next document.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    canon = rows.withColumn("canon", canonical(F.col("text"))).withColumn("wide", wide(F.col("canon")))
    odd = conflicts(canon, scratch)
    n_odd = odd.count()

    def named(df: DataFrame, digest: str, form: str, out: str) -> DataFrame:
        if not n_odd:
            return df.withColumn(out, F.col(digest))
        marked = odd.select(F.col("wide").alias(digest), F.lit(True).alias("odd"))
        df = df.join(F.broadcast(marked) if n_odd <= SMALL else marked, digest, "left")
        return df.withColumn(out, F.when(F.col("odd"), F.concat(digest, F.lit("-"), F.sha2(form, 256))).otherwise(F.col(digest))).drop("odd")

    out = with_next(rows, ["text"])
    out = out.withColumn("n", F.char_length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 2 as int)), substring(next_text, 1, cast(n div 2 as int)))"))
    for name, text in (("own", "text"), ("edit", "edited"), ("next", "next_text")):
        out = out.withColumn(f"{name}_form", canonical(F.col(text))).withColumn(f"{name}_wide", wide(F.col(f"{name}_form")))
    out = named(named(out, "own_wide", "own_form", "fingerprint"), "edit_wide", "edit_form", "edited_fingerprint")
    like = lambda other: ((F.col("own_wide") == F.col(f"{other}_wide")) & (F.col("own_form") == F.col(f"{other}_form"))).cast("double")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        like("edit").alias("near_edited"),
        like("next").alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
