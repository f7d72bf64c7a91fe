"""Set-similarity joins on token arrays: inverted-index candidates, exact verification.

Containment of a in b at threshold t: of the n tokens of a at least ceil(t n) are in b, so any n - ceil(t n) + 1 of them
include one of b's. These are taken rarest first (document frequency), and looked up among all tokens of b. Tokens are
projected once per row, never per pair. Jaccard at t implies containment at t of the smaller set in the larger.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import graph as G


def _prefix(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, block, tok): the rarest tokens that decide whether a row can be contained elsewhere."""
    every = rows.select("id", F.explode("toks").alias("tok"))
    df = every.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = every.join(df, "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r"))
    # Exact arithmetic on millionths: 0.6 n in floating point can round up and lose a pair.
    need = F.expr(f"cast(ceil(cast({round(threshold * 1_000_000)} as decimal(20,0)) * size(r) / 1000000) as int)")
    return ranked.select("id", F.explode(F.slice("r", 1, F.size("r") - need + 1)).alias("x")).select("id", F.col("x.tok").alias("tok"))


def covering_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): left rows a whose tokens are contained in right row b of the same block, at ``threshold`` or more.

    Both sides have id, block and toks; a row never covers itself."""
    left, right = left.where("size(toks) > 0"), right.where("size(toks) > 0")
    keys = _prefix(left, threshold).join(left.select("id", "block"), "id").select(F.col("id").alias("a"), "block", "tok")
    index = right.select(F.col("id").alias("b"), "block", F.explode("toks").alias("tok"))
    maybe = keys.join(index, ["block", "tok"]).where("a <> b").select("a", "b").distinct()
    rows = maybe.join(left.select(F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(right.select(F.col("id").alias("b"), F.col("toks").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return rows.select("a", "b", T.containment(common, F.size("ta")).alias("score")).where(F.col("score") >= threshold)


def overlapping_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b, same block: the greater of both containments reaches ``threshold``."""
    found = covering_pairs(rows, rows, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def cluster_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): links of overlapping rows (see ``overlapping_pairs``) whose components are those of all such links.

    Every row meets the smallest row of each of its tokens first; the tokens it shares with that one through them alone often
    suffice. Most rows of a block are one component by then, and links inside it change nothing: all others have an end outside,
    so only rows outside are joined with all rows."""
    rows = G.cut(rows.where("size(toks) > 0"))
    every = rows.select("id", "block", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    least = every.groupBy("block", "tok").agg(F.min(F.struct("n", "id")).alias("m"))
    shared = every.join(least, ["block", "tok"]).groupBy("id", "n", F.col("m.id").alias("dst"), F.col("m.n").alias("dn")).agg(F.count("*").alias("c"))
    sure = T.containment(F.col("c"), F.least("n", "dn")) >= threshold
    links = G.cut(shared.where("id <> dst").where(sure).select(F.col("id").alias("src"), "dst"))
    comp = G.cut(G.components(rows, links).join(rows.select("id", "block"), "id"))
    large = comp.groupBy("block", "component").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("component"))
    outside = G.cut(rows.join(comp.join(large, ["block", "component"], "left_anti").select("id"), "id", "left_semi"))
    more = covering_pairs(outside, rows, threshold).unionByName(covering_pairs(rows, outside, threshold))
    return links.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def jaccard_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b, same block, Jaccard at ``threshold`` or more.

    Rows with equal sets are one class. Of two classes that reach t, the first shared token in the common order (rarest first) is in
    both prefixes of n - ceil(t n) + 1 tokens, and from there on both hold the t / (1 + t) (n + m) tokens that they must share.
    Hashes of the tokens go along with every token of the prefix, so a pair is decided where it meets, once, at its first shared
    token: what is shuffled grows with the rows, not with the candidates. What passes is verified on the tokens themselves."""
    rows = rows.where("size(toks) > 0 and block is not null").select("id", "block", F.array_sort("toks").alias("toks"))
    member = rows.groupBy("block", "toks").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    sets = member.select(F.col("rep").alias("id"), "block", "toks")
    every = sets.select("id", "block", F.explode("toks").alias("tok"))
    df = every.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = every.join(df, "tok").groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("tok").alias("h")))).alias("r"))
    t = round(threshold * 1_000_000)
    need = F.expr(f"cast(ceil(cast({t} as decimal(20,0)) * size(r) / 1000000) as int)")
    ranked = ranked.select("id", "block", F.col("r.h").alias("hs"), F.size("r").alias("n"), need.alias("need"))
    keys = ranked.select("id", "block", "hs", "n", F.posexplode(F.slice("hs", 1, F.col("n") - F.col("need") + 1)).alias("pos", "h"))
    # One shuffle, read by both sides.
    keys = keys.repartition("h", "block")
    one, two = (keys.select("h", "block", *(F.col(c).alias(c + k) for c in ("id", "hs", "n", "pos"))) for k in "ab")
    met = one.join(two, ["h", "block"]).where("ida < idb").where(f"1000000 * least(na, nb) >= {t}L * greatest(na, nb)")
    met = met.where(f"{1_000_000 + t}L * least(na - posa, nb - posb) >= {t}L * (na + nb)")
    common = F.array_intersect("hsa", "hsb")
    met = met.withColumn("common", common).where(f"{1_000_000 + t}L * size(common) >= {t}L * (na + nb) and common[0] = h").select("ida", "idb")
    both = met.join(member.select(F.col("rep").alias("ida"), F.col("toks").alias("ta"), F.col("ids").alias("a")), "ida").join(member.select(F.col("rep").alias("idb"), F.col("toks").alias("tb"), F.col("ids").alias("b")), "idb")
    both = both.withColumn("score", T.jaccard(F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb"))).where(F.col("score") >= threshold)
    across = both.select("score", F.explode("a").alias("x"), "b").select("score", "x", F.explode("b").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    copies = member.where("size(ids) > 1").select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
    return across.unionByName(copies.withColumn("score", F.lit(1.0)))


def classes(rows: DataFrame) -> DataFrame:
    """(id, block, toks, ids): rows with equal sets of a block, written once under their least id."""
    rows = rows.where("size(toks) > 0 and block is not null").select("id", "block", F.array_sort("toks").alias("toks"))
    return G.cut(rows.groupBy("block", "toks").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")).select(F.col("rep").alias("id"), "block", "toks", "ids"))


def overlapping_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b, same block: the greater of both containments reaches ``threshold``, between rows of ``classes``.

    It is that of the smaller set: ceil(t n) of its n tokens are shared, so the first shared token in the common order (rarest
    first) is in its prefix of n - ceil(t n) + 1, and as many tokens follow in the larger set. Tokens that two rows of a block
    share get numbers of their own there, which go along with every token, so a pair is decided where it meets, once, at its first
    shared token, and exactly: what is shuffled grows with the rows, not with the candidates. Bit maps of the tokens spare most
    intersections."""
    t = round(threshold * 1_000_000)
    every = sets.select("id", "block", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    df = every.groupBy("block", "tok").agg(F.count("*").alias("df")).where("df > 1").withColumn("part", F.pmod(F.xxhash64("block", "tok"), F.lit(4096)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("block", "tok")).cast("long")
    key = place * 4096 + F.col("part")
    key = F.when(key < 2**31, key.cast("int")).otherwise(F.raise_error(F.lit("more than 2^31 tokens")).cast("int"))
    df = df.select("block", "tok", "df", key.alias("key"), F.pmod(F.xxhash64("tok"), F.lit(128)).alias("bit"))
    bits = (F.bit_or(F.expr(f"if(bit div 64 = {k}, shiftleft(1L, cast(bit % 64 as int)), 0L)")).alias(f"bits{k}") for k in (0, 1))
    ranked = every.join(df, ["block", "tok"]).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"), *bits)
    need = F.expr(f"cast(ceil(cast({t} as decimal(20,0)) * n / 1000000) as int)")
    ranked = G.cut(ranked.select("id", "n", need.alias("need"), F.col("r.key").alias("keys"), "bits0", "bits1"))
    # Tokens of one row only come first in the common order; they aren't among the keys.
    at = ranked.select("*", F.posexplode("keys").alias("p", "key")).withColumn("pos", F.col("n") - F.size("keys") + F.col("p"))
    large = at.select("key", *(F.col(c).alias(c + "l") for c in ("id", "n", "keys", "bits0", "bits1", "pos")))
    small = at.where("pos <= n - need").select("key", *(F.col(c).alias(c + "s") for c in ("id", "n", "need", "keys", "bits0", "bits1")))
    met = large.join(small, "key").where("(ns < nl or ns = nl and ids < idl) and nl - posl >= needs")
    met = met.where("ns - size(keyss) + bit_count(bits0s & ~bits0l) + bit_count(bits1s & ~bits1l) <= ns - needs")
    met = met.withColumn("common", F.array_intersect("keyss", "keysl")).where("size(common) >= needs and common[0] = key")
    met = met.withColumn("score", T.containment(F.size("common"), F.col("ns"))).where(F.col("score") >= threshold)
    return met.select(F.least("idl", "ids").alias("a"), F.greatest("idl", "ids").alias("b"), "score")


def losers(pairs: DataFrame, most: int = 200_000) -> DataFrame:
    """(a, b, score): pairs taken best first (score, then least a and b), where b falls out with the first pair taken that has it,
    and no pair is taken that has a row that fell out before.

    A pair is sure when no pair before it could make one of its rows fall out. Each round takes all sure pairs at once and drops
    those that they decide; the best pair left is always sure. The last ``most`` pairs are folded in one task."""
    left, out = pairs.select("a", "b", "score", F.struct((-F.col("score")).alias("s"), "a", "b").alias("o")), None
    left = G.cut(left)
    while left.count() > most:
        first = left.groupBy("b").agg(F.min("o").alias("first"))
        sure = left.join(first, "b").where("o = first").select("a", "b", "score", "o").join(first.withColumnsRenamed({"b": "a", "first": "before"}), "a", "left")
        sure = G.cut(sure.where("before is null or before > o").select("a", "b", "score", "o"))
        left = left.join(sure.select("b"), "b", "left_anti").join(sure.select(F.col("b").alias("a"), F.col("o").alias("fell")), "a", "left")
        left = G.cut(left.where("fell is null or fell > o").select("a", "b", "score", "o"))
        out = sure if out is None else out.unionByName(sure)

    def fold(frames):
        gone, took = set(), []
        for score, a, b in sorted((-score, a, b) for pdf in frames for a, b, score in zip(pdf["a"], pdf["b"], pdf["score"])):
            if a not in gone and b not in gone:
                gone.add(b)
                took.append((a, b, -score))
        yield pd.DataFrame(took, columns=["a", "b", "score"])

    last = G.cut(left.select("a", "b", "score").coalesce(1).mapInPandas(fold, "a long, b long, score double"))
    return last if out is None else out.select("a", "b", "score").unionByName(last)


def best_cover(claims: DataFrame, store: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): for each claim the best covering row of the store, ties to the least id."""
    pairs = covering_pairs(claims, store, threshold)
    return pairs.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("nb"))).alias("m")).selectExpr("a", "-m.nb b", "m.score score")
