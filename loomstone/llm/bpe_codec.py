"""Operator 9: BPE encoding and decoding with a contiguous rank array.

A word is an array of part boundaries with the merge rank of each adjacent pair beside it. The array is scanned
for the least rank, that boundary is deleted, and the two neighbouring ranks are refreshed. Words longer than
SHORT parts, for which repeated scans would be quadratic, take the same merges from a heap.

The vocabulary is a tokenizers JSON file of kind BPE with word ends, read by ``path``; the file reaches the
executors as one broadcast (its size is fixed by the file). Texts are cut at added tokens first, then normalised
(NFC, lower case; white space only separates), cut into words, and mapped to the byte alphabet. Null texts are
empty. Decoding joins the tokens by one space, as the library does for a file without a decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = "word_bpe_49k.json"
SHORT = 64
MEMO = 250_000
#: Fixed by the vocabulary's own pre-tokenizer: words are letter runs, single digits, other runs, and clitics.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        ids = self.ids
        #: (left id, right id) as one key -> (rank, merged id)
        self.rank = {(ids[a] << 20) | ids[b]: (r, ids[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.end = model["model"]["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = [self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)]
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        letters = [self.alphabet[b] for b in word.encode("utf-8")]
        letters[-1] += self.end
        parts = [self.ids[x] for x in letters if x in self.ids]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, none = self.rank, (1 << 30, 0)
        ranks = [rank.get((a << 20) | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == 1 << 30:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i] << 20) | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1] << 20) | parts[i], none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank, n = self.rank, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*rank[k], i, parts[i], parts[i + 1]) for i in range(n - 1) if (k := (parts[i] << 20) | parts[i + 1]) in rank]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = merged, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := rank.get((parts[x] << 20) | parts[y])):
                    heapq.heappush(heap, (got[0], x, got[1], parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def _known(self, word: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        got = self.memo[word] = np.array(self.word(word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        memo = self.memo
        for part in self.special.split(text) if self.special else (text,):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                # Lower case goes character by character: a final sigma isn't special.
                part = unicodedata.normalize("NFC", part)
                words = _WORDS.findall((part.replace("Σ", "σ") if "Σ" in part else part).lower())
                out += [memo.get(w) or self._known(w) for w in words]
        return b"".join(out)

    def decode(self, ids) -> str:
        """The tokens of ``ids``, joined by one space; ids that the vocabulary doesn't have are left out."""
        pieces, n = self.pieces, len(self.pieces)
        return " ".join([t for t in map(pieces.__getitem__, [i for i in ids if i < n]) if t is not None])


_LOADED: dict[int, Bpe] = {}


def _encoder(broadcast) -> Bpe:
    """One encoder a worker process; its memo lasts for a task."""
    key = hash(broadcast.value)
    if key not in _LOADED:
        _LOADED[key] = Bpe(json.loads(broadcast.value))
    _LOADED[key].memo.clear()
    return _LOADED[key]


def _encode(model, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches):
        bpe = _encoder(model)
        for batch in batches:
            n, ids_hex, text_hex, ids, decoded = [], [], [], [], []
            for text in batch.column(1):
                raw = bpe.encode(text.as_py() or "")
                back = bpe.decode(np.frombuffer(raw, "<u4").tolist())
                n.append(len(raw) // 4)
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                ids.append(np.frombuffer(raw, "<u4").astype(np.int64) if with_ids else None)
                decoded.append(back if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())],
                schema=schema,
            )
        bpe.memo.clear()

    return run


def bpe_codec(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded per row (the last two null unless with_ids) of ``docs`` (doc_id,
    text); other columns are ignored, whatever their names. Null texts are empty, null ids and repeated rows are rows like
    others, no rows give none.
    """
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(model, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>, decoded string")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(documents(spark, sf_dir)).drop("ids", "decoded")
