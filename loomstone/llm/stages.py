"""Whole-row forms of the operators, for pipelines: rows keep all their columns, whatever their names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fold_shares
from .decontamination import SMALL, leaks
from .language_id import _pieces, train
from .ngram_jaccard import jaccard_rows
from .suffix_dedup import _remove, ids_repeat, keyed, repeated_spans


def _kept_languages(model):
    def run(batches):
        m = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep: list[bool] = []
            for _, _, part in _pieces(batch.column(at).to_pylist()):
                if not m.langs:
                    keep += [False] * len(part)
                    continue
                h, n, letters = m.score(part)
                keep += (~m.rejects(h, n) & (letters > 0)).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def in_a_language(docs: DataFrame) -> DataFrame:
    """Documents whose language is not rejected; null texts and texts without letters go."""
    rows = fold_shares(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), 3, "share")
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where("share <> 1")))
    return docs.mapInArrow(_kept_languages(model), docs.schema)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The row with the least (doc_id, hash of text) of each group of linked texts; empty texts and null ids stay. Of rows equal in
    doc_id and text one stays; rows that repeat a doc_id with texts that aren't linked all stay."""
    rows = jaccard_rows(docs).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "th")).alias("f")
    groups = rows.where("component is not null").groupBy("component").agg(first).select("f.*")
    groups = groups.unionByName(rows.where("component is null").select("doc_id", "th")).distinct().select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"))
    whole = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    place = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.lit(0)))
    kept = whole.join(groups, (F.col("id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_th")), "left_semi")
    return kept.withColumn("place", place).where("place = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages cut from their texts; n_chars, where present, is counted anew. No row goes."""
    rest = [c for c in docs.columns if c != "text"]
    repeated = ids_repeat(docs)
    spans = repeated_spans(docs, repeated)
    rows = keyed(docs, repeated, F.struct(*rest).alias("rest")).join(spans, ["did", "th"], "left").select("rest", "text", "lists")
    fields = rows.schema["rest"].dataType
    run = _remove(True)

    def cut(batches):
        for batch in batches:
            ids = pa.array([0] * batch.num_rows, pa.int64())
            slim = pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2)], names=["doc_id", "text", "lists"])
            kept = next(iter(run([slim]))).column(5)
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], names=["rest", "text"])

    out = rows.mapInArrow(cut, f"rest {fields.simpleString()}, text string")
    size = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in rest else {}
    return out.select(*(F.col("text") if c == "text" else size.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def not_in_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a passage of the benchmark; null ids stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id")).where("leak_id is not null").distinct(), "leaks")
    small = found.count() <= SMALL
    return docs.join(F.broadcast(found) if small else found, docs["doc_id"] == found["leak_id"], "left_anti")


__all__ = ["in_a_language", "not_in_benchmark", "one_of_each_group", "without_repeats"]
