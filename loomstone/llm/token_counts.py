"""Operator 5: token counts by a linear longest-match automaton.

Greedy word-piece lengths: a word is cut into the longest vocabulary piece that starts it, then the longest that
starts the rest, and so on. The vocabulary trie carries failure links and, with each, the number of pieces that
following it pops, so a word is counted in one pass over its bytes and no piece is ever built.

For a node v spelling s, the longest piece p1 that starts s is popped, then the longest that starts the rest, until
the rest is again a node: that node is fail(v), and pops(v) is how many pieces went. Pieces inside a word may
have their own trie (continuation pieces); the rest after a pop is looked up there.

Vocabulary: the word-start pieces and the continuation pieces of a byte-level BPE file (``path``), a leading space
character marking word starts. Its single bytes are all pieces, so every word can be cut; for other vocabularies a
word that can't be cut counts as one unknown token. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import byte_alphabet
from .common import documents

VOCABULARY = "byte_bpe_50k.json"
MEMO = 250_000
_WORDS = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


class Automaton:
    """Failure links over two tries in one node space: node 0 starts words, node 1 goes on inside them."""

    def __init__(self, first: set[bytes], inner: set[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]
        self.piece: list[bool] = [False, False]
        parent = [(-1, -1), (-1, -1)]
        for root, pieces in ((0, first), (1, inner)):
            for p in sorted(pieces):
                at = root
                for c in p:
                    if c not in self.step[at]:
                        self.step[at][c] = len(self.step)
                        self.step.append({})
                        self.piece.append(False)
                        parent.append((at, c))
                    at = self.step[at][c]
                if at > 1:
                    self.piece[at] = True
        n = len(self.step)
        self.fail, self.pops = [-1] * n, [0] * n
        layer = [*self.step[0].values(), *self.step[1].values()]
        while layer:
            below: list[int] = []
            for v in layer:
                below += self.step[v].values()
                if self.piece[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                u, c = parent[v]
                at, k = self.fail[u], self.pops[u]
                while at >= 0 and c not in self.step[at]:
                    k += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.step[at][c], k
            layer = below

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 (unknown) if it can't be cut."""
        step, fail, pops = self.step, self.fail, self.pops
        at = n = 0
        for c in word:
            nxt = step[at].get(c)
            while nxt is None:
                if fail[at] < 0:
                    return 1
                n += pops[at]
                at = fail[at]
                nxt = step[at].get(c)
            at = nxt
        while at != 1:
            if at < 0 or fail[at] < 0:
                return 1
            n += pops[at]
            at = fail[at]
        return n


def pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-start and inner pieces, as bytes, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in enumerate(byte_alphabet())}
    space = byte_alphabet()[32]
    first, inner = set(), set()
    for token in vocab:
        if all(c in back for c in token):
            start = token.startswith(space) and len(token) > 1
            (first if start else inner).add(bytes(back[c] for c in token[start:]))
    # A word may start with any byte, also where the vocabulary has no piece for it after a space.
    return first | {x for x in inner if len(x) == 1}, inner


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_BUILT: dict[int, tuple[Automaton, dict[str, int]]] = {}


def _counts(vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        first, inner = vocabulary.value
        key = hash((len(first), len(inner), min(first), max(inner)))
        if key not in _BUILT:
            _BUILT[key] = Automaton(first, inner), {}
        automaton, memo = _BUILT[key]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = _WORDS.findall(text.as_py() or "")
                n = 0
                for w in words:
                    k = memo.get(w)
                    if k is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = automaton.count(w.encode("utf-8", "surrogatepass"))
                    n += k
                n_words.append(len(words))
                n_tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs`` (doc_id, text); other columns are ignored, whatever their names. Null texts
    have no words, null ids and repeated rows are rows like others, no rows give none."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces(path or vocabulary_path()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counts(vocabulary), "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
