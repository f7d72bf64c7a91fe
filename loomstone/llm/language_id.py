"""Operator 4: language ID by interpolated Kneser-Ney character language models.

One model of order 4 per language over the code points of its texts: letters and combining marks of any script are symbols of
their own, lower case; anything else is one symbol, 0, whose runs count once. Counts are taken over every training document in
Spark, pre-aggregated in the tasks, and the models are fitted there too, with joins of n-grams, their contexts and the
n-grams below them; what is gathered grows with the distinct n-grams of the corpus. A model is, per order, a sorted array
of 64-bit n-gram hashes with a row of log-probabilities, a column per language, and one of context hashes with back-off
weights. Texts are scored by searching the distinct n-grams of a batch in these arrays, and what isn't there backs off.

The language with the least length-normalised cross-entropy wins (ties: the first by name). Rejection is calibrated per
language on HELD_OUT of the training texts under models that haven't counted them: a text of n symbols is rejected
beyond bound + WIDE * spread / sqrt(n). The bound lies midway between a high quantile of the language's own texts and a
low one of texts of the other languages that would fall to it if their own were not learned, but not below the former.
The final models count every training text. With fewer than LEAST own texts held out, a fixed bound stands
in: mean + MARGIN + Z deviations of a mean over n / SPAN symbols, from the training counts.

Null texts and texts without a letter are ``und``, score 0, rejected. With nothing to learn from, everything is ``und``.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, documents, fold_shares, mix

ORDER = 4
CHUNK = 1 << 19
MARGIN, Z, SPAN = 2.0, 8.0, 4.0
HELD_OUT, LEAST, OWN, OTHER, WIDE = 4, 20, 0.999, 0.05, 3.0  # one in HELD_OUT
STEP, FAR = 0.01, 4000  # bins of cross-entropy over the mean
SEEN_AT_MOST = 64  # symbols that a score counts in full: it stays short of 0 and 1 for longer texts
POINTS = 0x110000
GATHERED = 1 << 21  # symbols of all languages that a task holds before it counts them
BITS = 21  # of a code point

_SYMBOL: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Per code point: 0 for no symbol, 1 for a combining mark, 2 for a letter."""
    global _SYMBOL
    if _SYMBOL is None:
        _SYMBOL = np.fromiter((2 if c.isalpha() else unicodedata.category(c)[0] == "M" for c in map(chr, range(POINTS))), np.uint8, POINTS)
    return _SYMBOL


def spell(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of a list of texts: context (three symbols of BITS bits) and last symbol; the text each belongs to, letters per text.

    Every text stands between ORDER - 1 zeros, so no n-gram has symbols of two texts.
    """
    gap = "\x00" * (ORDER - 1)
    joined = gap + gap.join(t.replace("\x00", " ") for t in texts) + gap
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = symbols()[code]
    sym = np.where(kind > 0, code, 0).astype(np.int64)
    between = code == 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | between[1:]
    sym, between, letter = sym[keep], between[keep], kind[keep] == 2
    # The gap before text k ends at its (ORDER - 1)th zero.
    own = np.cumsum(between) // (ORDER - 1) - 1
    context = (sym[:-3] << 2 * BITS) | (sym[1:-2] << BITS) | sym[2:-1]
    real = ~between[ORDER - 1 :]
    own, last = own[ORDER - 1 :][real], sym[ORDER - 1 :][real]
    return context[real], last, own, np.bincount(own[letter[ORDER - 1 :][real]], minlength=len(texts))


def gram_hash(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(context.astype(U64) * U64(0x9E3779B97F4A7C15) + last.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def _pieces(texts: list[str | None]):
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= CHUNK):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, hi, [t or "" for t in texts[lo:hi]]
        lo = hi


GRAMS = "lang string, held boolean, context long, last int, n long"


def _count(batches):
    """Counted n-grams of this task, aggregated by GATHERED symbols."""
    schema = pa.schema([("lang", pa.string()), ("held", pa.bool_()), ("context", pa.int64()), ("last", pa.int32()), ("n", pa.int64())])
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush(key):
        parts = held.pop(key)
        context, last = np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.lexsort((last, context))
        context, last = context[order], last[order]
        at = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (last[1:] != last[:-1]))))
        n = np.diff(np.concatenate((at, [len(context)])))
        k = len(at)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * k, pa.string()), pa.array([key[1]] * k, pa.bool_()), pa.array(context[at]), pa.array(last[at].astype(np.int32)), pa.array(n)], schema=schema)

    for batch in batches:
        by: dict[tuple[str, bool], list[str]] = {}
        for lang, text, out in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault((lang, out), []).append(text)
        for key, own in by.items():
            for _, _, part in _pieces(own):
                context, last, _, _ = spell(part)
                if len(last):
                    held.setdefault(key, []).append((context, last))
                    size += len(last)
                if size > GATHERED:
                    for k in list(held):
                        yield flush(k)
                    size = 0
    for key in list(held):
        yield flush(key)


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated Kneser-Ney from counted 4-grams (lang, context, last, n): tables (lang, k, context, last, p) of the n-grams of
    all orders k seen and (lang, k, context, back) of their contexts. Lower orders count the n-grams above that they end. Every step is a kept table, so plans stay small."""
    scratch = Scratch(grams.sparkSession)
    tables = {ORDER: scratch.keep(grams.select("lang", "context", "last", "n"), "n")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("context")
        tables[k] = scratch.keep(tables[k + 1].select("lang", shorter, "last").groupBy("lang", "context", "last").agg(F.count("*").alias("n")), "n")
    below = tables[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("below"))  # one more for symbols never seen
    grown, backs = [], []
    for k in range(1, ORDER + 1):
        t = tables[k]
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = t.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        context = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(F.broadcast(discount), "lang")
        context = scratch.keep(context.select("lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("back")), "contexts")
        t = t.join(context, ["lang", "context"]).withColumn("tail", F.col("context").bitwiseAND(F.lit((1 << BITS * max(0, k - 2)) - 1)))
        t = t.join(F.broadcast(below), "lang") if k == 1 else t.join(below, ["lang", "tail", "last"])
        t = t.withColumn("p", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below"))
        t = scratch.keep(t.select("lang", F.lit(k).alias("k"), "context", "last", "n", "p"), "p")
        grown.append(t)
        backs.append(context.select("lang", F.lit(k).alias("k"), "context", "back"))
        below = t.select("lang", F.col("context").alias("tail"), "last", F.col("p").alias("below"))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(grown), union(backs)


def codes(column: pa.ChunkedArray, number: dict[str, int]) -> np.ndarray:
    """The numbers of the strings of a column."""
    told = pc.index_in(column, pa.array(list(number), pa.string()))
    return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(number.values(), np.int64)[c.to_numpy()] for c in told.chunks)])


class Model:
    """Per order, sorted hashes of n-grams with rows of log-probabilities and sorted contexts with rows of log back-off weights; NaN
    where a language has none."""

    def __init__(self, grams: pa.Table, backs: pa.Table):
        self.langs = sorted(pc.unique(grams.column("lang")).to_pylist())
        number = {lang: k for k, lang in enumerate(self.langs)}
        column = lambda t, name, kind: t.column(name).to_numpy().astype(kind)
        of = lambda t: codes(t.column("lang"), number)
        lang, k, context, last, n, p = of(grams), column(grams, "k", int), column(grams, "context", np.int64), column(grams, "last", np.int64), column(grams, "n", float), column(grams, "p", float)
        b_lang, b_k, b_context, back = of(backs), column(backs, "k", int), column(backs, "context", np.int64), column(backs, "back", float)
        self.floor = -np.log(np.bincount(lang[k == 1], minlength=len(self.langs)) + 1.0)
        self.grams = {j: self._array(gram_hash(context[k == j], last[k == j]), lang[k == j], np.log(p[k == j])) for j in range(1, ORDER + 1)}
        self.backs = {j: self._array(b_context[b_k == j].astype(U64), b_lang[b_k == j], np.log(back[b_k == j])) for j in range(1, ORDER + 1)}
        whole = k == ORDER
        total = np.bincount(lang[whole], weights=n[whole], minlength=len(self.langs))
        h = -np.log(p[whole])
        self.mean = np.bincount(lang[whole], weights=n[whole] * h, minlength=len(self.langs)) / np.maximum(total, 1)
        square = np.bincount(lang[whole], weights=n[whole] * (h - self.mean[lang[whole]]) ** 2, minlength=len(self.langs))
        self.deviation = np.sqrt(np.maximum(square / np.maximum(total, 1), 1e-9))
        self.bound, self.spread = np.full(len(self.langs), np.nan), np.zeros(len(self.langs))

    def _array(self, h: np.ndarray, lang: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = np.unique(h, return_inverse=True)
        rows = np.full((len(hashes), len(self.langs)), np.nan, np.float32)
        rows[at, lang] = value
        return hashes, rows

    @staticmethod
    def _find(array: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        """Rows of the hashes ``h``, NaN where there is none."""
        hashes, rows = array
        out = np.full((len(h), rows.shape[1]), np.nan, np.float32)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            out[hit] = rows[at[hit]]
        return out

    def log_p(self, context: np.ndarray, last: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probabilities (n-gram x language): found, or the back-off weight of the context and the order below."""
        if k == 0:
            return np.broadcast_to(self.floor.astype(np.float32), (len(last), len(self.langs)))
        out = self._find(self.grams[k], gram_hash(context, last))
        miss = np.flatnonzero(np.isnan(out).any(1))
        if len(miss):
            back = np.nan_to_num(self._find(self.backs[k], context[miss].astype(U64)), nan=0.0)  # an unseen context passes all on
            lower = self.log_p(context[miss] & ((1 << BITS * max(0, k - 2)) - 1), last[miss], k - 1)
            out[miss] = np.where(np.isnan(out[miss]), back + lower, out[miss])
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (text x language), symbols and letters per text."""
        context, last, own, letters = spell(texts)
        _, first, at = np.unique(gram_hash(context, last), return_index=True, return_inverse=True)
        logp = self.log_p(context[first], last[first])
        n = np.bincount(own, minlength=len(texts))
        total = np.stack([np.bincount(own, weights=logp[:, k][at], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def rejects(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether even the best language is far worse than on its own text."""
        best, root = h.argmin(1), np.sqrt(np.maximum(n, 1))
        fixed = self.mean[best] + MARGIN + Z * self.deviation[best] / root * np.sqrt(SPAN)
        return h.min(1) > np.where(np.isnan(self.bound[best]), fixed, self.bound[best] + WIDE * self.spread[best] / root)

    def calibrate(self, k: int, mean: float, own: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> None:
        """Bound of language ``k`` from (cross-entropy over ``mean``, symbols, texts) of its own texts and those of others."""
        if own[2].sum() < LEAST:
            return
        self.spread[k] = quantile(np.abs(own[0] - quantile(own[0], own[2], 0.5)) * np.sqrt(own[1]), own[2], 0.5) / 0.6745
        over = lambda x, n, _: x - WIDE * self.spread[k] / np.sqrt(n)
        most = quantile(over(*own), own[2], OWN)
        least = quantile(over(*other), other[2], OTHER) if other[2].sum() else most
        self.bound[k] = mean + max(most, (most + least) / 2)


def quantile(x: np.ndarray, count: np.ndarray, q: float) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(count[order])
    return float(x[order[np.searchsorted(total, q * total[-1])]])


def _excess(model):
    """Histogram of this partition's held-out texts that fall to their own language: cross-entropy over the language's mean, and
    over that of the language they fall to without it (``own`` is false), by powers of two of the symbols."""
    schema = pa.schema([("k", pa.int32()), ("own", pa.bool_()), ("size", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        m: Model = model.value
        found: dict[tuple[int, bool, int, int], int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, part in _pieces(batch.column(1).to_pylist()):
                h, n, letters = m.score(part)
                label = np.array([m.langs.index(x) if x in m.langs else -1 for x in langs[lo:hi]])
                at = np.flatnonzero((h.argmin(1) == label) & (letters > 0))
                h, n, label = h[at], n[at], label[at]
                for own in (True, False) if len(m.langs) > 1 else (True,):
                    best = h.argmin(1)
                    over = h[np.arange(len(at)), best] - m.mean[best]
                    bins = np.clip(np.round(over / STEP), -FAR, FAR)
                    for key in zip(best.tolist(), [own] * len(at), np.log2(n).astype(int).tolist(), bins.astype(int).tolist()):
                        found[key] = found.get(key, 0) + 1
                    h[np.arange(len(at)), label] = np.inf
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, n))) for key, n in found.items()], schema=schema)

    return run


def fitted(grams: DataFrame) -> Model:
    found, backs = kneser_ney(grams)
    return Model(found.toArrow(), backs.toArrow())


def train(docs: DataFrame) -> Model:
    """Models of every non-null lang of ``docs`` (lang, text), counted over all rows, and their calibration."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.where("lang is not null and text is not null").select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0).alias("held"))
    counted = scratch.keep(rows.mapInArrow(_count, GRAMS).groupBy("lang", "held", "context", "last").agg(F.sum("n").alias("n")), "grams")
    whole = fitted(counted.groupBy("lang", "context", "last").agg(F.sum("n").alias("n")))
    rest = fitted(counted.where("not held"))
    if rest.langs:
        shared = spark.sparkContext.broadcast(rest)
        out = rows.where("held").select("lang", "text").mapInArrow(_excess(shared), "k int, own boolean, size int, bin int, n long")
        out = out.groupBy("k", "own", "size", "bin").agg(F.sum("n").alias("n")).toPandas()
        for k, lang in enumerate(rest.langs):
            seen = [out[(out["k"] == k) & (out["own"] == own)] for own in (True, False)]
            seen = [(p["bin"].to_numpy(np.float64) * STEP, 1.4 * 2.0 ** p["size"].to_numpy(np.float64), p["n"].to_numpy(np.int64)) for p in seen]
            whole.calibrate(whole.langs.index(lang), rest.mean[k], *seen)
    return whole


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m: Model = model.value
        for batch in batches:
            lang, score, ce, out = [], [], [], []
            for _, _, part in _pieces(batch.column(2).to_pylist()):
                if not m.langs:
                    lang, score, ce, out = lang + ["und"] * len(part), score + [0.0] * len(part), ce + [None] * len(part), out + [True] * len(part)
                    continue
                h, n, letters = m.score(part)
                best = h.argmin(1)
                least = h[np.arange(len(part)), best]
                p = 1 / np.exp(-(h - least[:, None]) * np.minimum(n, SEEN_AT_MOST)[:, None]).sum(1)
                far, none = m.rejects(h, n), letters == 0
                lang += ["und" if x else m.langs[b] for x, b in zip(none, best)]
                score += np.where(none, 0.0, p).tolist()
                ce += [None if x else float(v) for x, v in zip(none, least)]
                out += (far | none).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(out, pa.bool_())], schema=schema)

    return run


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected per row of ``docs`` (doc_id, text, lang); other columns are ignored,
    whatever their names.

    Learns from rows whose crc32(doc_id as text) mod 3 is not 1 (a null doc_id counts as the empty text); lang and doc_id serve
    nothing else. Equal texts get equal results, repeated rows a row each, no rows give none.
    """
    rows = fold_shares(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), 3, "share")
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where("share <> 1")))
    rows = rows.select("doc_id", (F.col("share") == 1).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
