"""Graph analytics over edge frames (src, dst, rel, weight): iterative frontier joins, each step planned by Catalyst."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T


def shared_dir(spark: SparkSession) -> str:
    """The folder executors and driver share; where none is named, a local one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or "/tmp/checkpoints/loomstone"


def cut(df: DataFrame) -> DataFrame:
    """Write and reread: iterations don't pile up lineage and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loomstone-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edge_support(assertions: DataFrame) -> DataFrame:
    """Distinct sessions per edge and the weight they give it; never certain."""
    rows = assertions.groupBy("src", "dst", "rel").agg(F.countDistinct("session_id").alias("n"))
    return rows.withColumn("weight", T.support_weight(F.col("n")))


def active_edges(edges: DataFrame, active: DataFrame) -> DataFrame:
    ids = active.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """Symmetric edges in both directions."""
    back = edges.where("rel in ('contradicts', 'co_derived')").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight")
    return edges.select("src", "dst", "rel", "weight").unionByName(back)


def co_derived(evidence: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Pairs of beliefs with evidence from one session of ``least`` to ``most`` beliefs; a pair weighs 1/size a session.

    The size filter comes before the self-join: it bounds what a session can produce."""
    members = evidence.select("session_id", F.col("belief_id").alias("id")).distinct()
    sized = members.groupBy("session_id").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    a = members.join(sized, "session_id")
    b = members.withColumnRenamed("id", "dst")
    pairs = a.join(b, "session_id").where("id < dst")
    return pairs.groupBy(F.col("id").alias("src"), "dst").agg(F.count("*").alias("n_sessions"), F.sum(1.0 / F.col("size")).alias("weight"))


def khop(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth): shortest depth of every node within ``hops`` of the seeds (column id)."""
    links = cut(adj.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct())
    seen = front = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")))
    for d in range(1, hops + 1):
        # Each frontier is written once: plans stay of one hop's size, whatever the number of hops.
        front = cut(front.join(links, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        seen = seen.unionByName(front)
    return seen


def best_paths(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, score, length): the greatest product of weights from each seed over at most ``hops`` edges.

    Bellman-Ford rounds; equal scores go to the shorter path."""
    links = cut(adj.groupBy(F.col("src").alias("id"), F.col("dst").alias("to")).agg(F.greatest(F.max("weight"), F.lit(1e-9)).alias("w")))
    best = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumns({"score": F.lit(1.0), "length": F.lit(0).cast("long")})
    for _ in range(hops):
        step = best.join(links, "id").select("seed", F.col("to").alias("id"), (F.col("score") * F.col("w")).alias("score"), (F.col("length") + 1).alias("length"))
        best = cut(best.unionByName(step).groupBy("seed", "id").agg(F.max(F.struct("score", (-F.col("length")).alias("l"))).alias("m")).selectExpr("seed", "id", "m.score score", "-m.l length"))
    return best


def simple_paths(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(path, hops): acyclic paths from the seeds, as ids joined by '>'."""
    links = cut(adj.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    cur = seeds.select(F.col("id").alias("at"), F.array("id").alias("path")).distinct()
    out = None
    for h in range(1, hops + 1):
        cur = cut(cur.join(links, "at").where("not array_contains(path, to)").select(F.col("to").alias("at"), F.expr("concat(path, array(to))").alias("path")))
        rows = cur.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.lit(h).cast("long").alias("hops"))
        out = rows if out is None else out.unionByName(rows)
    return out


def components(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(id, component): the least id that a node reaches, singletons included. Large-star, small-star rounds, each cut."""
    cur, before = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    for _ in range(most):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        nxt = cut(small)
        # Equal digests of two rounds: nothing moves any more.
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.select("id").distinct().join(cur.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
        cur, before = nxt, now
    raise RuntimeError(f"components did not settle in {most} rounds")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, community): weighted label propagation in rotated id order, ties to the least label.

    Depends on the order of updates, so each component is one group: parallel over components."""
    comp = components(nodes, edges)
    rows = edges.join(comp.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "weight")
    alone = comp.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_anti").select("id", F.col("id").alias("community"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = {}
        for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"]):
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0.0) + w
        ids = sorted(near)
        label = {i: i for i in ids}
        for r in range(rounds):
            k, moved = r % len(ids), False
            for i in ids[k:] + ids[:k]:
                score: dict[int, float] = {}
                for j, w in near[i].items():
                    score[label[j]] = score.get(label[j], 0.0) + w
                best = min(score, key=lambda c: (-score[c], c))
                moved |= best != label[i]
                label[i] = best
            if not moved:
                break
        return pd.DataFrame({"id": ids, "community": [label[i] for i in ids]})

    return rows.groupBy("component").applyInPandas(settle, "id long, community long").unionByName(alone)


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def repoint(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with endpoints moved from old to new (remap: old, new): self-loops go, symmetric pairs are put in order
    again, edges that fall together become one."""
    from loomstone.sources.adapters import symmetric_first

    m = remap.select("old", "new")
    rows = edges.join(m, F.col("src") == F.col("old"), "left").withColumn("src", F.coalesce("new", "src")).drop("old", "new")
    rows = rows.join(m, F.col("dst") == F.col("old"), "left").withColumn("dst", F.coalesce("new", "dst")).drop("old", "new")
    return symmetric_first(rows).where("src <> dst").select("src", "dst", "rel").distinct()
