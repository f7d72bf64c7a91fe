"""Operator 3: toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: insult and threat words carry weights; targets, negators, verbs of reported speech and
words of intent don't. Five transducers read the symbols of a clause, each with explicit arcs (state, symbol) -> (state, factor)
and labels of its final states: insult (a second insult weighs more), threat (accepts a threat word only with an intent before
it or a target after it), target (harm near a target weighs more), negation and reported speech (harm after them weighs less).
They are composed once, by the product construction over reachable states, into one table.

A clause is scored if the composed machine ends in a state that accepts an insult or a threat; its class (plain, aimed at a
target, softened by negation or report, threat, softened threat) is read from the labels of that state and its weight is
the sum of its harmful words times the factors of the arcs taken. Words outside accepted clauses count nothing. A logistic
regression learns from the labelled rows what the classes are worth, together with the length of the text.

The grammar starts from short word lists; further harmful words and word beginnings are learned from the labelled training
rows with their log-odds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fold_shares
from .labelled import Logistic, labelled_sample

SAMPLE = 20_000  # most labelled rows learned from
LEXICON = 4_000  # most learned entries
LEAST_DOCS, LEAST_ODDS, EXPLAINED = 4, 3.0, 0.7
SYMBOLS = OTHER, TARGET, NEGATION, REPORT, INTENT, BREAK, INSULT, THREAT = tuple(range(8))
HARM = (INSULT, THREAT)
INSULTS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown", "dumb", "fool")
THREATS = ("kill", "hurt", "destroy", "punch", "beat", "shoot", "stab", "burn")
TARGETS = ("you", "your", "yours", "yourself", "he", "him", "his", "she", "her", "they", "them", "their", "people")
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "isn't", "aren't", "wasn't", "don't", "didn't", "won't")
REPORTS = ("said", "says", "say", "wrote", "called", "quoted", "claimed", "reported", "alleged", "according")
INTENTS = ("will", "shall", "gonna", "must", "should", "let", "i'll", "we'll", "they'll")
SEED_WEIGHT = 3.0
SHORTEST, LONGEST = 3, 8  # letters of a learned beginning
MEMO = 250_000
_TOKENS = regex.compile(r"\p{L}+(?:['’]\p{L}+)?|[.!?;:\n]")


class Transducer(NamedTuple):
    """Start state 0. ``arcs[state, symbol]`` is (next state, factor of a harmful word read); ``labels[state]`` what ends there."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    labels: dict[int, frozenset[str]]


def machine(start, step: Callable, labels: Callable) -> Transducer:
    """The reachable part of a transducer given by ``step(state, symbol) -> (state, factor)``; BREAK ends a clause, so it has no arcs."""
    number, queue, arcs = {start: 0}, [start], {}
    for state in queue:
        for symbol in SYMBOLS:
            if symbol == BREAK:
                continue
            to, factor = step(state, symbol)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            arcs[number[state], symbol] = number[to], factor
    return Transducer(arcs, {k: frozenset(labels(state)) for state, k in number.items()})


def insult() -> Transducer:
    """Insults of the clause, two at most told apart; from the second on they weigh more."""
    return machine(0, lambda q, s: (min(q + 1, 2), 1.2 if q else 1.0) if s == INSULT else (q, 1.0), lambda q: ["insult"] * (q > 0))


def threat() -> Transducer:
    """A threat word with an intent before it or a target after it: state (intent, word, aimed)."""

    def step(q, s):
        intent, word, aimed = q
        factor = 1.5 if s == THREAT and intent else 1.0
        return (intent or s == INTENT, word or s == THREAT, aimed or (word and s == TARGET) or (intent and s == THREAT)), factor

    return machine((False, False, False), step, lambda q: ["threat"] * (q[1] and q[2]))


def target(reach: int = 4, factor: float = 1.5) -> Transducer:
    """Harm up to ``reach`` tokens from a target, whichever comes first: state (tokens left after a target, after harm, near)."""

    def step(q, s):
        after_target, after_harm, near = q
        here = s in HARM and after_target > 0
        near = near or here or (s == TARGET and after_harm > 0)
        return (reach if s == TARGET else max(0, after_target - 1), reach if s in HARM else max(0, after_harm - 1), near), factor if here else 1.0

    return machine((0, 0, False), step, lambda q: ["target"] * q[2])


def negation(reach: int = 3, factor: float = 0.3) -> Transducer:
    """Harm up to ``reach`` tokens after a negation: state (tokens left, met)."""
    return machine(
        (0, False),
        lambda q, s: ((reach if s == NEGATION else max(0, q[0] - 1), q[1] or (s in HARM and q[0] > 0)), factor if s in HARM and q[0] else 1.0),
        lambda q: ["negation"] * q[1],
    )


def report(factor: float = 0.5) -> Transducer:
    """Harm after a verb of reported speech, to the end of the clause: state (reported, met)."""
    return machine((False, False), lambda q, s: ((q[0] or s == REPORT, q[1] or (q[0] and s in HARM)), factor if s in HARM and q[0] else 1.0), lambda q: ["report"] * q[1])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The product of two transducers: states are reachable pairs, factors multiply, labels unite."""

    def step(q, s):
        (x, f), (y, g) = a.arcs[q[0], s], b.arcs[q[1], s]
        return (x, y), f * g

    return machine((0, 0), step, lambda q: a.labels[q[0]] | b.labels[q[1]])


CLASSES = PLAIN, AIMED, SOFT, MENACE, SOFT_MENACE = tuple(range(5))


class Grammar:
    """The composition of transducers as flat tables, and the classes its final states accept."""

    def __init__(self, parts: Iterable[Transducer]):
        whole = None
        for part in parts:
            whole = part if whole is None else compose(whole, part)
        size, n = len(whole.labels), len(SYMBOLS)
        self.next, self.factor = [0] * (size * n), [1.0] * (size * n)
        for (q, s), (to, factor) in whole.arcs.items():
            self.next[q * n + s], self.factor[q * n + s] = to * n, factor
        #: Per state: class of its insults and of its threats, None if it accepts none.
        self.accepts = [self._classes(whole.labels[q]) for q in range(size)]

    @staticmethod
    def _classes(labels: frozenset[str]) -> tuple[int | None, int | None]:
        soft = bool(labels & {"negation", "report"})
        return (SOFT if soft else AIMED if "target" in labels else PLAIN) if "insult" in labels else None, (SOFT_MENACE if soft else MENACE) if "threat" in labels else None

    def clauses(self, tokens: list[tuple[int, float]]):
        """(class, weight) of what each clause of the tokens (symbol, weight) is accepted for."""
        after, factor, n = self.next, self.factor, len(SYMBOLS)
        state, weights = 0, [0.0, 0.0]
        for symbol, weight in tokens:
            if symbol == BREAK:
                if state:
                    for kind, total in zip(self.accepts[state // n], weights):
                        if kind is not None:
                            yield kind, total
                    state, weights = 0, [0.0, 0.0]
            elif symbol or state:
                at = state + symbol
                if weight:
                    weights[symbol == THREAT] += weight * factor[at]
                state = after[at]


PARTS = insult, threat, target, negation, report
GRAMMAR = Grammar(part() for part in PARTS)
N_FEATURES = len(CLASSES) + 5


class Scorer:
    """Grammar and lexicon: text -> features."""

    def __init__(self, learned: dict[str, float], grammar: Grammar | None = None):
        self.fixed = {w: (s, 0.0) for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS)) for w in words}
        self.fixed |= {c: (BREAK, 0.0) for c in ".!?;:\n"}
        self.harm = {w: (s, SEED_WEIGHT) for s, words in ((INSULT, INSULTS), (THREAT, THREATS)) for w in words}
        self.learned, self.own = learned, grammar
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a lower-case word; entries that start with ^ are beginnings of words."""
        if word in self.fixed:
            return self.fixed[word]
        kind, weight = self.harm.get(word, (OTHER, 0.0))
        most = max([self.learned.get(word, 0.0), *(self.learned.get("^" + word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))])
        if most:
            kind, weight = kind or INSULT, max(most, weight)
        return kind, weight

    def tokens(self, text: str) -> list[tuple[int, float]]:
        memo, out = self.memo, []
        for t in _TOKENS.findall(text.lower().replace("’", "'")):
            got = memo.get(t)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[t] = self.symbol(t)
            out.append(got)
        return out

    def features(self, text: str) -> list[float]:
        """Of the accepted clauses alone: weight by class, in all, at most and per token; and the length."""
        out = self.tokens(text)
        by, most, n = [0.0] * len(CLASSES), 0.0, len(out)
        if any(x[1] for x in out):
            for kind, weight in (self.own or GRAMMAR).clauses([*out, (BREAK, 0.0)]):
                by[kind] += weight
                most = max(most, weight)
        total, size = sum(by), np.log(20 + n)
        return [*np.log1p(by).tolist(), np.log1p(total), np.log1p(most), np.log((1 + total) / (20 + n)), size, np.log1p(total) * size]


def _words(batches):
    """(entry, y) once a text: its words and their beginnings."""
    for batch in batches:
        entry, y = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set()
            for w in {w for w in _TOKENS.findall(text.lower()) if len(w) > 2}:
                own.add(w)
                own.update("^" + w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
            entry += own
            y += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(y, pa.int32())], schema=pa.schema([("entry", pa.string()), ("y", pa.int32())]))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries whose smoothed log-odds speak for harm, at most LEXICON of them. A beginning that one word explains (EXPLAINED of its
    texts) gives way to the word: "tra" isn't learned from "trash"."""
    size = sample.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in size}
    if not n.get(1) or not n.get(0):
        return {}
    counts = sample.select("text", "y").mapInArrow(_words, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") - F.col("a") + 0.5) / (n[0] + 1.0))
    rows = counts.where(F.col("a") >= LEAST_DOCS).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS).orderBy(F.desc(F.col("w") * F.sqrt("a")), "entry").limit(LEXICON)
    rows = rows.collect()
    words = {r["entry"]: r["a"] for r in rows if not r["entry"].startswith("^")}
    explained = {w[:k]: max(a for v, a in words.items() if v.startswith(w[:k])) for w in words for k in range(SHORTEST, len(w))}
    return {r["entry"]: float(r["w"]) for r in rows if not r["entry"].startswith("^") or explained.get(r["entry"][1:], 0) < EXPLAINED * r["a"]}


def _features(scorer):
    def run(batches):
        for batch in batches:
            s: Scorer = scorer.value
            rows = [s.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], schema=pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    return run


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        scorer, fit = model.value
        for batch in batches:
            x = np.array([scorer.features(t.as_py() or "") for t in batch.column(2)]).reshape(batch.num_rows, -1)
            p = fit(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text); other columns are ignored, whatever their names.

    Null texts count as empty; equal texts get equal scores, repeated rows a row each; a null doc_id is scored like any other
    (crc32 of the empty text) and never learned from. Labels come from rows with crc32(doc_id as text) mod 5 other than 0;
    without any, every score is 0.5. No rows give no rows.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, Scratch(spark))
    scorer = Scorer(learn_lexicon(sample))
    rows = sample.select("text", "y").mapInArrow(_features(spark.sparkContext.broadcast(scorer)), "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), -1) if len(rows) else np.zeros((0, N_FEATURES))
    fit = Logistic(x, rows["y"].to_numpy(np.float64))
    model = spark.sparkContext.broadcast((scorer, fit))
    out = fold_shares(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 5, "share")
    out = out.select("doc_id", (F.col("share") == 0).alias("held_out"), "text")
    return out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
