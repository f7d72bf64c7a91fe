"""Operator 2: benchmark decontamination by spaced-seed hashing, DataFrame functions only.

With the texts laid over each other, a window of SPAN tokens is a leak if at least SHARE of the tokens are equal on it and
REACH tokens to either side (as far as the item and the document go), or at least CLOSE on it and NEAR tokens to
either side, which finds shorter quotations that are nearly literal. Items with fewer than SPAN tokens are leaks where SHARE
of the whole item is equal; with fewer than 5 that means all of it (``shortest`` leaves out items of fewer tokens).

Fixed masks of SPAN tokens ignore some positions; a hash over the other positions survives substitutions at the ignored
ones. COVER has enough masks that every stretch that passes leaves a seed whole, wherever its substitutions are. Hashes
of all windows of the benchmark items meet those of all documents, and every window whose stretch holds the hit is tested.

Texts are cut into pieces of PIECE windows with the tokens a test can reach to either side, so no row grows with its
text. The seed join knows numbers only (seed, item, position; 24 bytes); the item's piece is fetched for hits.
Both are broadcast in blocks of SEEDS seeds, as many blocks as the benchmark needs: each side broadcast at a time
is bounded whatever the size of an item or of the benchmark, documents never shuffle, and no key is hot.

Tokens are runs of letters and digits, lower case. Null and empty texts and items have none and never match; a null item_id or
doc_id takes no part. Rows that repeat a doc_id share their finds, rows that repeat an item_id are one item with several texts.
No documents give no rows, no benchmark gives no finds; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPAN = 12
REACH, SHARE, NEAR, CLOSE = 6, 0.8, 2, 0.9
#: Positions that count, of SPAN: every stretch of SPAN to SPAN + 2 * REACH tokens with SHARE of them equal has a window
#: where one of these is whole (a test goes through all placements).
COVER = ((0, 1, 3, 7, 10, 11), (0, 5, 6, 8, 9, 11), (0, 1, 2, 4, 5, 10), (2, 3, 4, 5, 7, 11), (1, 2, 3, 6, 8, 9), (4, 6, 7, 8, 9, 10))
PIECE, EDGE = 64, SPAN + 2 * REACH  # windows of a piece; tokens to either side
SEEDS = 1_000_000  # seeds of a block: 24 MB, and their pieces 12 MB
SMALL = 2_000_000  # document ids (8 bytes each) that are broadcast; above, the join shuffles


def guarded(c: Column) -> Column:
    """``c`` behind a condition that always holds but isn't known to: filters above aren't pushed below it, where they
    would evaluate it again and again."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return guarded(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def pieces(df: DataFrame) -> DataFrame:
    """Rows of a text's pieces, in place of ``toks``: chunk, n (tokens of the text), base (place of the first token), part."""
    base = f"greatest(0, c * {PIECE} - {EDGE})"
    cut = f"transform(sequence(0, int((size(toks) - 1) div {PIECE})), c -> named_struct('chunk', c, 'base', {base}, 'part', slice(toks, {base} + 1, {PIECE + 2 * EDGE})))"
    keys = [c for c in df.columns if c != "toks"]
    df = df.where(F.size("toks") > 0).select(*keys, F.size("toks").alias("n"), F.explode(F.expr(cut)).alias("p"))
    return df.select(*keys, "n", "p.chunk", "p.base", "p.part")


def cover(k: int) -> tuple[tuple[int, ...], ...]:
    """Masks for windows of ``k`` tokens. Below SPAN: with e substitutions, two of e + 2 groups of positions stay whole."""
    if k >= SPAN:
        return COVER
    groups = k - math.ceil(SHARE * k) + 2
    return tuple(tuple(j for j in range(k) if j * groups // k in pair) for pair in combinations(range(groups), 2))


def seeds(df: DataFrame, k: int = SPAN) -> DataFrame:
    """A row for each window of ``k`` tokens that starts in a piece and each of its masks: pos (in the text) and seed."""
    first, last = f"chunk * {PIECE}", f"least(chunk * {PIECE} + {PIECE}, n - {k} + 1) - 1"
    masked = [F.xxhash64(F.lit(100 * k + m), *(F.expr(f"get(part, pos - base + {j})") for j in mask)) for m, mask in enumerate(cover(k))]
    df = df.where(f"{last} >= {first}").withColumn("pos", F.explode(F.expr(f"sequence({first}, {last})")))
    return df.withColumn("seed", F.explode(F.array(*masked)))


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = 1) -> DataFrame:
    """Verified (doc_id, item_id) with the most equal tokens of a hit, once a pair. Items of fewer tokens than ``shortest`` are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("toks")).where("item_id is not null")
    items = items.where(F.size("toks") >= max(1, shortest))
    size = F.size("toks")
    masks = F.when(size >= SPAN, F.lit(len(COVER))).otherwise(max(len(cover(k)) for k in range(1, SPAN)))
    told = items.agg(F.collect_set(F.when(size < SPAN, size)).alias("short"), F.sum(size * masks).alias("seeds"), F.max(size).alias("longest")).first()
    short, blocks = sorted(told["short"]), max(1, -(-(told["seeds"] or 0) // SEEDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("toks")).where("doc_id is not null")
    rows, items = pieces(rows), pieces(items)
    if blocks > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "chunk"), F.lit(blocks)))

    def seeded(df: DataFrame, own: bool) -> DataFrame:
        out = seeds(df) if not own else seeds(df.where(f"n >= {SPAN}"))
        for k in short:
            out = out.unionByName(seeds(df.where(f"n = {k}") if own else df, k))
        return out

    found = seeded(rows, False)
    good = None
    for block in range(blocks):
        part = items.where(F.col("block") == block).drop("block") if blocks > 1 else items
        wanted = seeded(part, True).select("seed", "item_id", F.col("pos").alias("item_pos"), F.col("chunk").alias("item_chunk"))
        text = part.select("item_id", F.col("chunk").alias("item_chunk"), F.col("n").alias("item_n"), F.col("base").alias("item_base"), F.col("part").alias("item_part"))
        hits = tested(found.join(F.broadcast(wanted), "seed").join(F.broadcast(text), ["item_id", "item_chunk"]))
        good = hits if good is None else good.unionByName(hits)
    return good.groupBy("doc_id", "item_id").agg(F.max("same").cast("long").alias("n_same"))


def tested(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, same) of the hits whose stretch passes."""
    # Item position p lies over document position pos + p - item_pos. [a, b) holds the stretches of all windows to be tested.
    hits = hits.withColumn("a", F.expr(f"greatest(0, item_pos - {2 * REACH}, item_pos - pos)"))
    hits = hits.withColumn("b", F.expr(f"least(item_n, item_pos + {SPAN + 2 * REACH}, item_pos - pos + n)"))
    # Only the two slices leave the join; the guard keeps the comparison, which runs outside generated code, out of it.
    hits = hits.select(
        "doc_id", "item_id", guarded(F.expr("slice(item_part, a - item_base + 1, b - a)")).alias("x"), guarded(F.expr("slice(part, pos - item_pos + a - base + 1, b - a)")).alias("y"),
        F.expr("b - a").alias("n"), F.expr("item_pos - a").alias("at"), F.expr(f"least({SPAN}, item_n)").alias("span"),
    )
    # Bit j: the tokens at j are equal.
    hits = hits.withColumn("bits", guarded(F.expr("aggregate(zip_with(x, y, (x, y) -> if(x = y, 1L, 0L)), 0L, (s, z) -> shiftleft(s, 1) + z)"))).drop("x", "y")
    hits = hits.where(F.bit_count("bits") >= F.lit(SHARE) * F.col("span")).where("n >= span")

    def equal(lo: str, hi: str) -> str:
        return f"bit_count(shiftright(bits, n - ({hi})) & (shiftleft(1L, ({hi}) - ({lo})) - 1L))"

    far = f"greatest(0, r - {REACH})", f"least(n, r + span + {REACH})"
    near = f"greatest(0, r - {NEAR})", f"least(n, r + span + {NEAR})"
    passes = " OR ".join(f"{equal(lo, hi)} >= {share}D * ({hi} - {lo})" for (lo, hi), share in ((far, SHARE), (near, CLOSE)))
    tries = f"sequence(greatest(0, at - {REACH}), greatest(0, least(at + {REACH}, n - span)))"
    return hits.withColumn("same", F.expr(f"array_max(transform({tries}, r -> if({passes}, {equal(*far)}, null)))")).where("same is not null").select("doc_id", "item_id", "same")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) per row of ``docs``; a null doc_id is never contaminated."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))
