"""Operator 8: quality by a linear-chain conditional random field over lines.

Every non-blank line gets a label, good or bad, from its own features and those of its neighbours; labels
of neighbouring lines depend on each other. Forward-backward marginals of good, weighted by length, are the
quality of the text; a logistic regression on it (and its extremes) gives the calibrated score.

Labels exist for texts only. The field is first fitted with each line labelled as its text; then lines of bad texts
that the field holds to be good beyond doubt become good (at least one stays bad), and it is fitted once more.
Fitting uses at most SAMPLE labelled rows, as whole texts, and so does scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Powers, Scratch, chunks, documents, fold_shares, mix, utf8
from .labelled import Logistic, labelled_sample

SAMPLE = 6_000
CHUNK = 1 << 20
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
#: Byte classes: lower case, upper case, digit, space, bar, exclamation and question, other signs, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, *range(9, 14)]] = 0, 1, 2, 3
_CLASS[124], _CLASS[[33, 63]], _CLASS[[46, 44]] = 4, 5, 3
_CLASS[128:] = 7
N_CLASS, N_OWN = 8, 14
_POWERS = Powers()


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per non-blank line of a chunk of texts: features, length in bytes, and the text it belongs to."""
    n = len(buf)
    if n == 0:
        return np.zeros((0, N_OWN)), np.zeros(0), np.zeros(0, np.int64)
    new = np.zeros(n + 1, bool)
    new[offs] = True
    new[1:][buf == 10] = True
    line = np.cumsum(new[:n]) - 1
    k = int(line[-1]) + 1
    starts = np.flatnonzero(new[:n])
    text = np.searchsorted(offs, starts, "right") - 1
    classes = np.bincount(line * N_CLASS + _CLASS[buf], minlength=k * N_CLASS).reshape(k, N_CLASS).astype(np.float64)
    size = classes.sum(1)
    # Words: hashes of runs without white space, for repetition inside the line.
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[:n], out=total[1:])
    word = mix((total[b] - total[a]) * down[a])
    of = line[a]
    words = np.bincount(of, minlength=k).astype(np.float64)
    again = np.zeros(k)
    if len(word) > 1:
        again = np.bincount(of[1:], weights=(word[1:] == word[:-1]) & (of[1:] == of[:-1]), minlength=k)
    one_each = np.unique(word ^ mix(of.astype(U64) + U64(1)), return_index=True)[1]
    distinct = np.bincount(of[one_each], minlength=k).astype(np.float64)
    # Lines found again in the same text.
    body = np.zeros(k, U64)
    if len(word):
        runs = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        body[of[runs]] = np.add.reduceat(mix(word + U64(7)), runs)
    _, inv, count = np.unique(body ^ mix(text.astype(U64) + U64(3)), return_inverse=True, return_counts=True)
    full = words > 0
    one = np.maximum(size, 1)
    x = np.stack(
        [
            *(classes[:, c] / one for c in (1, 2, 3, 4, 5, 6, 7)),
            np.log1p(size),
            size / np.maximum(words, 1) / 10,
            again / np.maximum(words, 1),
            1 - distinct / np.maximum(words, 1),
            np.minimum(count[inv] - 1, 5) / 5,
            np.log1p(words),
            np.minimum(words, 4) / 4,
        ],
        1,
    )
    return x[full], size[full], text[full]


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zeros at its ends), and an intercept."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


class Field:
    """Two labels (bad, good): unary weights of the features for good, and a transition table."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.w, self.t = np.zeros(3 * N_OWN + 1), np.zeros((2, 2))

    def unary(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((x - self.mean) / self.scale, -5, 5), text) @ self.w

    def marginals(self, good: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(label, label of the next line); texts side by side, position by position."""
        n = len(good)
        if n == 0:
            return np.zeros(0), np.zeros((0, 2, 2))
        start = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        size = np.diff(np.concatenate((start, [n])))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        u = np.stack([np.zeros(n), np.clip(good, -30, 30)], 1)
        trans = np.exp(self.t)
        e = np.exp(u - u.max(1, keepdims=True))
        fwd, bwd = np.empty((n, 2)), np.ones((n, 2))
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts with more than t lines
        for t in range(int(size[0])):
            at = start[: live[t]] + t
            v = e[at] if t == 0 else (fwd[at - 1] @ trans) * e[at]
            fwd[at] = v / v.sum(1, keepdims=True)
        for t in range(int(size[0]) - 2, -1, -1):
            at = start[: live[t + 1]] + t
            v = (e[at + 1] * bwd[at + 1]) @ trans.T
            bwd[at] = v / v.sum(1, keepdims=True)
        p = fwd * bwd
        p = p / p.sum(1, keepdims=True)
        follows = np.flatnonzero(text[1:] == text[:-1]) if n > 1 else np.zeros(0, np.int64)
        pair = fwd[follows][:, :, None] * trans[None] * (e[follows + 1] * bwd[follows + 1])[:, None, :]
        return p[:, 1], pair / pair.sum((1, 2), keepdims=True)

    def fit(self, x: np.ndarray, text: np.ndarray, y: np.ndarray) -> None:
        """Gradient ascent (Adam) on the conditional log-likelihood of the line labels y."""
        design = with_neighbours(np.clip((x - self.mean) / self.scale, -5, 5), text)
        follows = np.flatnonzero(text[1:] == text[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[follows].astype(int), y[follows + 1].astype(int)), 1.0)
        n, m, v = max(len(y), 1), np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for step in range(1, STEPS + 1):
            p, pair = self.marginals(design @ self.w, text)
            g = np.concatenate([design.T @ (y - p) / n - RIDGE * self.w, ((seen - pair.sum(0)) / n - RIDGE * self.t).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w += move[:-4]
            self.t += move[-4:].reshape(2, 2)


def quality_of(p: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: length-weighted share of good, the worst line, the share of bad lines, log length. Without lines: 0.5s."""
    weight = np.bincount(text, weights=size, minlength=n)
    share = np.bincount(text, weights=size * p, minlength=n)
    lines = np.bincount(text, minlength=n)
    q = np.where(weight > 0, share / np.maximum(weight, 1e-9), 0.5)
    worst = np.ones(n)
    np.minimum.at(worst, text, p)
    bad = np.bincount(text, weights=p < 0.5, minlength=n) / np.maximum(lines, 1)
    logit = np.log((q + 0.01) / (1.01 - q))
    return np.stack([q, logit, np.where(lines > 0, worst, 0.5), np.where(lines > 0, bad, 0.5), np.log1p(weight)], 1)


def _lines(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary()), ("size", pa.binary())])
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        xs, sizes = [], []
        for lo, hi in chunks(offs, CHUNK):
            x, size, text = line_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            for a, b in zip(cut[:-1], cut[1:]):
                xs.append(x[a:b].astype(np.float64).tobytes())
                sizes.append(size[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], schema=schema)


def train(sample: DataFrame) -> tuple[Field | None, Logistic]:
    rows = sample.select("doc_id", "y", "text").mapInArrow(_lines, "doc_id long, y int, x binary, size binary").toPandas().sort_values("doc_id")
    label = rows["y"].to_numpy(np.float64)
    xs = [np.frombuffer(b, np.float64).reshape(-1, N_OWN) for b in rows["x"]]
    x = np.concatenate([np.zeros((0, N_OWN)), *xs])
    size = np.concatenate([np.zeros(0), *(np.frombuffer(b, np.float64) for b in rows["size"])])
    text = np.repeat(np.arange(len(xs)), [len(v) for v in xs])
    if not len(x) or label.min() == label.max():
        return None, Logistic(np.zeros((len(label), 5)), label)
    field = Field(x.mean(0), np.maximum(x.std(0), 1e-6))
    y = label[text]
    field.fit(x, text, y)
    p, _ = field.marginals(field.unary(x, text), text)
    least = np.full(len(xs), 2.0)
    np.minimum.at(least, text, p)
    y = np.where((y == 0) & (p > 0.9) & (p > least[text]), 1.0, y)
    field.fit(x, text, y)
    p, _ = field.marginals(field.unary(x, text), text)
    return field, Logistic(quality_of(p, size, text, len(xs)), label)


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("good_share", pa.float64())])

    def run(batches):
        field, fit = model.value
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            parts = [np.zeros((0, 5))]
            for lo, hi in chunks(offs, CHUNK):
                x, size, text = line_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                p = field.marginals(field.unary(x, text), text)[0] if field else np.full(len(x), 0.5)
                parts.append(quality_of(p, size, text, hi - lo))
            q = np.concatenate(parts)
            s = fit(q) if len(q) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.3).astype(np.int32)), pa.array(q[:, 0])], schema=schema)

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, good_share per row of ``docs`` (doc_id, text); other columns are ignored, whatever their
    names. Null texts count as empty; equal texts get equal scores, repeated rows a row each; a null doc_id is scored like any other
    and never learned from. No rows give none.

    Labels come from rows with crc32(doc_id as text) mod 5 other than 0; without any, every score is 0.5.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", SAMPLE, Scratch(spark))))
    out = fold_shares(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 5, "share")
    out = out.select("doc_id", (F.col("share") == 0).alias("held_out"), "text")
    return out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int, good_share double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
