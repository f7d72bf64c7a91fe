"""Full-text search: postings, BM25, phrases, staged AND/OR and scope widening, code-token repair."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.constants import BM25_B, BM25_K1
from loomstone.functions import text as T
from loomstone.functions.stem import stems


def query_phrases(text: str) -> list[list[str]]:
    """The phrases of a query as typed: every token of letters, digits and ``_./:-`` is one; its parts must be adjacent."""
    return [p for t in re.findall(r"[A-Za-z0-9_./:-]+", text) if (p := re.findall(r"[^\W_]+", t.lower()))]


def is_code_token(text: str) -> bool:
    """Whether a query looks like an identifier: an underscore, a dotted name or a camel-case hump."""
    return bool(re.search(r"_|\w\.\w|[a-z][A-Z]", text))


def typed(docs: DataFrame, key: list[str], content: str, queries: list[str]) -> DataFrame:
    """(q, key, tier): tier 0 where all phrases of the query stand in the row, 1 where a query that looks like code only stands there
    literally. A query without words hits nothing. The rows are read once, for all queries."""
    words = F.concat(F.lit(" "), F.array_join(T.search_terms(F.col(content)), " "), F.lit(" "))
    rows = docs.select(*key, F.lower(content).alias("_text"), words.alias("_words"))

    def tier(q):
        phrases = [F.col("_words").contains(" " + " ".join(p) + " ") for p in query_phrases(q)]
        out = F.when(reduce(lambda a, b: a & b, phrases), F.lit(0)) if phrases else F.lit(None).cast("int")
        return out.when(F.col("_text").contains(q.lower()), F.lit(1)) if phrases and is_code_token(q) else out

    if not queries:
        return rows.select(F.lit("").alias("q"), *key, F.lit(0).alias("tier")).limit(0)
    hits = F.array(*(F.struct(F.lit(q).alias("q"), tier(q).alias("tier")) for q in queries))
    return rows.select(*key, F.explode(F.filter(hits, lambda h: h.tier.isNotNull())).alias("h")).select("h.q", *key, "h.tier")


def stemmed(docs: DataFrame, content: str) -> DataFrame:
    """The content as stemmed terms without diacritics, joined by spaces: an index over it finds other word forms."""
    return docs.withColumn(content, stems(F.col(content)))


def postings(docs: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, term, pos, n_terms): one row per term occurrence, positions from 1."""
    rows = docs.select(*key, T.search_terms(F.col(content)).alias("t")).withColumn("n_terms", F.size("t").cast("long"))
    return rows.select(*key, F.posexplode("t").alias("pos", "term"), "n_terms").withColumn("pos", (F.col("pos") + 1).cast("long"))


def bm25(docs: DataFrame, key: list[str], content: str, terms: list[str]) -> DataFrame:
    """(key, rank, n_hit): SQLite's convention, smaller is better. Only the query's terms are counted: the filter runs on
    the term arrays before anything is exploded or shuffled."""
    terms = sorted(set(terms))
    rows = docs.select(*key, T.search_terms(F.col(content)).alias("t")).withColumn("n_terms", F.size("t").cast("long"))
    for i, term in enumerate(terms):
        rows = rows.withColumn(f"tf{i}", F.size("t").cast("long") - F.size(F.array_remove("t", term)).cast("long"))
    rows = rows.drop("t")
    # Statistics are one row whatever the corpus holds.
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_terms").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score: Column = F.lit(0.0)
    n_hit: Column = F.lit(0)
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}").cast("double"), F.col(f"tf{i}").cast("double")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_terms") / F.col("avgdl")))
        n_hit = n_hit + (tf > 0).cast("int")
    return hits.select(*key, (-score).alias("rank"), n_hit.cast("long").alias("n_hit"))


def and_or(scored: DataFrame, n_terms: int, scope: Column | None = None) -> DataFrame:
    """Stages in one plan: in-scope AND, in-scope OR, AND, OR; only the first stage with a row is kept.

    The least stage is a scalar aggregate, joined as one broadcast row."""
    full = F.col("n_hit") == n_terms
    stage = F.when(full, 0).otherwise(1) if scope is None else F.when(scope & full, 0).when(scope, 1).when(full, 2).otherwise(3)
    rows = scored.withColumn("stage", stage)
    return rows.join(F.broadcast(rows.agg(F.min("stage").alias("stage"))), "stage")


def snippet(content: Column, term: str, width: int = 16) -> Column:
    """A window of ``width`` terms around the first match, which stands in brackets; null without a match."""
    t = T.search_terms(content)
    at = F.array_position(t, term).cast("int")
    lo = F.greatest(F.lit(1), at - width // 2)
    shown = F.transform(F.slice(t, lo, F.lit(width)), lambda x: F.when(x == term, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.when(at > 0, F.array_join(shown, " "))


def phrase(posted: DataFrame, key: list[str], words: list[str]) -> DataFrame:
    """Rows that hold the words next to each other, with how often."""
    out = posted.where(F.col("term") == words[0]).select(*key, F.col("pos").alias("at"))
    for k, w in enumerate(words[1:], 1):
        nxt = posted.where(F.col("term") == w).select(*key, (F.col("pos") - k).alias("at"))
        out = out.join(nxt, [*key, "at"])
    return out.groupBy(*key).agg(F.count("*").alias("n"))


def grouped_hits(hits: DataFrame, per_session: int = 3) -> DataFrame:
    """Best hits of each session, sessions ranked by their best one."""
    w = Window.partitionBy("session_id").orderBy("rank", "rowid")
    return hits.withColumn("place", F.row_number().over(w).cast("long")).withColumn("session_rank", F.min("rank").over(Window.partitionBy("session_id"))).where(F.col("place") <= per_session)


def grep(msg: DataFrame, needle: str, around: int, case_insensitive: bool = False) -> DataFrame:
    """Rows within ``around`` rows of a match in the same session."""
    text, want = (F.lower("content"), needle.lower()) if case_insensitive else (F.col("content"), needle)
    w = Window.partitionBy("session_id").orderBy("rowid")
    rows = msg.withColumn("n", F.row_number().over(w).cast("long")).withColumn("hit", text.contains(want))
    return rows.withColumn("near", F.max("hit").over(w.rowsBetween(-around, around))).where("near").drop("near")
