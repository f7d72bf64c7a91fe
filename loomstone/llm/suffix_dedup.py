"""Operator 10: suffix-array dedup by prefix-free parsing.

A byte goes when a 100-byte string that also starts earlier in the corpus covers it (earlier: smaller
doc_id, or same document and smaller start); matches never cross documents.

1. Shards. A rolling hash over 32 bytes is computed at every position. The position with the least hash (the leftmost on
   ties) inside a 100-byte window is the window's anchor; equal windows have it at the same place, so they
   meet where anchors meet. Runs of windows with one anchor make a passage. Of equal passages only the first in corpus order
   goes on: all windows of the others are repeats. An anchor with a single passage has no other repeats.
2. Parse. The passages that are left, shard by shard, are cut into phrases where a rolling hash over 8 bytes is 0 modulo 8;
   a phrase holds the triggers at both of its ends, so no suffix of a phrase longer than a trigger is a prefix of another.
3. The suffix array of the dictionary (distinct phrases) and the suffix array of the parse (phrases by their dictionary
   ranks), both by prefix doubling, combine into the order of all positions: by the rank of the rest of the phrase,
   then by the rank of the parse after it. Positions whose common prefix with the one before is 100 bytes or more start
   equal windows; all but the first of them in corpus order are repeats.
4. Hot anchors. A task that finds an anchor with several passages sends these by anchor and passage to different buckets,
   and a mark to the anchor's own. The shard of an anchor with more than HOT passages is split into parts; every part is parsed and sorted
   as above, and the first windows of its classes meet by digest, a pre-aggregated minimum. No task holds an anchor.

Texts longer than SEGMENT bytes are read in segments that overlap by a window, so memory is bounded.
Null texts are empty. Rows that repeat a doc_id follow each other in the order of a hash of their texts; rows
equal in doc_id and text count once and get the same result. A null doc_id sorts first. No rows give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, documents, flush_shuffles, mix, utf8
from .ngram_jaccard import grouped

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM + 1
CHUNK, SEGMENT = 1 << 20, 1 << 21
HOT = 20_000  # passages of an anchor that are sorted in one part
PART = 8_000  # passages that are sorted together
ENTRIES = 300_000  # passages that a task gathers before it sends them
TRIGGER, EVERY = 8, 8  # bytes of a phrase's trigger; one position in EVERY is one
NO_ID = -(1 << 63)
SMALL = 1_000_000  # hot anchors (8 bytes each) that are broadcast; above, the join shuffles


def triggers(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of a chunk of texts that end at ``ends``: trigger, first and last window start, trigger hash."""
    if len(buf) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    h, step = buf.astype(U64) + U64(1), 1
    power = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = h[:-step] * power + h[step:]
            power = power * power
            step *= 2
        h = mix(h)
    low = U64(23)
    least = (h >> low << low) | np.arange(len(h), dtype=U64)
    step = 1
    while step * 2 <= REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := REACH - step:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & U64((1 << 23) - 1)).astype(np.int64)
    valid = np.ones(len(at), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - WINDOW + 1) : e] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    at = at[starts]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(starts)])) - 1
    return at[first], starts[first], starts[last], h[at[first]]


def pieces(offs: np.ndarray):
    """(rows lo..hi, start, end): chunks of whole texts, or segments of a text longer than SEGMENT."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        if offs[lo + 1] - offs[lo] > SEGMENT:
            start = int(offs[lo])
            while True:
                end = min(start + SEGMENT, int(offs[lo + 1]))
                yield lo, lo + 1, start, end
                if end == offs[lo + 1]:
                    break
                start = end - WINDOW + 1
            lo += 1
            continue
        hi = lo + 1
        while hi < n and offs[hi + 1] - offs[lo] <= CHUNK:
            hi += 1
        yield lo, hi, int(offs[lo]), int(offs[hi])
        lo = hi


def join_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of spans; touching spans become one."""
    if not len(s):
        return s, e
    order = np.lexsort((e, s))
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate((at[1:] - 1, [len(e) - 1]))]


def spans_by_doc(did, th, s, e):
    """Joined spans, grouped by document: lists of (did, th, bytes of int64 pairs)."""
    out = []
    order = np.lexsort((s, th, did))
    did, th, s, e = did[order], th[order], s[order], e[order]
    cut = np.flatnonzero((did[1:] != did[:-1]) | (th[1:] != th[:-1])) + 1
    for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(did)])).tolist()):
        if b > a:
            x, y = join_spans(s[a:b], e[a:b])
            out.append((int(did[a]), int(th[a]), np.stack((x, y), 1).astype(np.int64).tobytes()))
    return out


_ENTRY = np.dtype([("trig", "<u8"), ("phrase", "<u8"), ("did", "<i8"), ("th", "<i8"), ("at", "<i4"), ("lo", "<u1"), ("hi", "<u1"), ("open", "<u1")])
MARK = 255  # in ``hi``: no passage, but the anchor has several
_SPANS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("spans", pa.binary())])


def pack(e: np.ndarray) -> bytes:
    """Entries field by field: equal fields side by side compress well in a shuffle."""
    return b"".join(np.ascontiguousarray(e[k]).tobytes() for k in _ENTRY.names)


def unpack(blocks: list[bytes]) -> np.ndarray:
    out = []
    for b in blocks:
        e, pos = np.empty(len(b) // _ENTRY.itemsize, _ENTRY), 0
        for k in _ENTRY.names:
            size = len(e) * _ENTRY[k].itemsize
            e[k] = np.frombuffer(b, _ENTRY[k], len(e), pos)
            pos += size
        out.append(e)
    return np.concatenate(out)


def _first_of_phrase(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by (anchor, passage, corpus order) and which of them are the first of their passage."""
    e = e[np.lexsort((e["at"], e["th"], e["did"], e["phrase"], e["trig"]))]
    first = np.ones(len(e), bool)
    first[1:] = (e["trig"][1:] != e["trig"][:-1]) | (e["phrase"][1:] != e["phrase"][:-1])
    return e, first


def _several(e: np.ndarray) -> np.ndarray:
    """Which entries, sorted by anchor and one for each passage, share their anchor."""
    out = np.zeros(len(e), bool)
    same = e["trig"][1:] == e["trig"][:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _repeat_rows(e: np.ndarray):
    at = e["at"].astype(np.int64)
    return spans_by_doc(e["did"], e["th"], at - e["lo"], at - e["hi"] + WINDOW)


def _parse(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("did", pa.int64()), ("th", pa.int64()), ("spans", pa.binary())])

    def flush(held):
        e, first = _first_of_phrase(np.concatenate(held))
        spans = _repeat_rows(e[~first])
        e = e[first]
        several = _several(e)
        e["open"] = several
        marks = np.zeros(len(np.unique(e["trig"][several])), _ENTRY)
        marks["trig"], marks["hi"] = np.unique(e["trig"][several]), MARK
        where = np.concatenate([np.where(several, mix(e["trig"] ^ e["phrase"]), e["trig"]), marks["trig"]])
        e = np.concatenate([e, marks])
        home = (where % U64(buckets)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        e, home = e[order], home[order]
        cut = np.flatnonzero(home[1:] != home[:-1]) + 1
        runs = list(zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(e)])).tolist())) if len(e) else []
        k = len(spans)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(int(home[a]) for a, _ in runs), *(abs(x[0] * 31 + x[1]) % buckets for x in spans)], pa.int32()),
                pa.array([*(pack(e[a:b]) for a, b in runs), *[None] * k], pa.binary()),
                pa.array([*[None] * len(runs), *(x[0] for x in spans)], pa.int64()),
                pa.array([*[None] * len(runs), *(x[1] for x in spans)], pa.int64()),
                pa.array([*[None] * len(runs), *(x[2] for x in spans)], pa.binary()),
            ],
            schema=schema,
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, offs = utf8(batch.column(2))
            for lo, hi, start, end in pieces(offs):
                part = buf[start:end]
                at, first, last, trig = triggers(part, np.minimum(offs[lo + 1 : hi + 1], end) - start)
                if not len(at):
                    continue
                view = memoryview(np.ascontiguousarray(part))
                e = np.zeros(len(at), _ENTRY)
                e["phrase"] = [xxhash.xxh3_64_intdigest(view[x : y + WINDOW], z) for x, y, z in zip(first.tolist(), last.tolist(), (at - first).tolist())]
                row = np.searchsorted(offs, at + start, "right") - 1
                e["trig"], e["did"], e["th"] = trig, did[row], th[row]
                e["at"], e["lo"], e["hi"] = at + start - offs[row], at - first, at - last
                held.append(e)
                n += len(e)
                if n > ENTRIES:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


_OPEN = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("spans", pa.binary()), ("open", pa.binary())])
#: A passage whose windows must be compared: anchor, position, reach to either side.
_NEED = np.dtype([("trig", "<u8"), ("at", "<i4"), ("lo", "<u1"), ("hi", "<u1")])


def _dictionary(batches):
    """Per bucket: spans of repeated passages; passages that share their anchor with others stay open."""
    for t in grouped(batches, 1):
        rows = [(d, h, s, None) for d, h, s in zip(t.column("did").to_pylist(), t.column("th").to_pylist(), t.column("spans").to_pylist()) if s is not None]
        parts = [x for x in t.column("entries").to_pylist() if x]
        if parts:
            e, first = _first_of_phrase(unpack(parts))
            rows += [(*x, None) for x in _repeat_rows(e[~first & (e["hi"] != MARK)])]
            e = e[first]
            e = e[(_several(e) | (e["open"] > 0)) & (e["hi"] != MARK)]
            e = e[np.lexsort((e["at"], e["th"], e["did"]))]
            need = np.zeros(len(e), _NEED)
            for k in _NEED.names:
                need[k] = e[k]
            cut = np.flatnonzero((e["did"][1:] != e["did"][:-1]) | (e["th"][1:] != e["th"][:-1])) + 1
            for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(e)])).tolist()):
                if b > a:
                    rows.append((int(e["did"][a]), int(e["th"][a]), None, need[a:b].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OPEN)], schema=_OPEN)


_CONTEXT = pa.schema([("trig", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("text", pa.binary())])


def _contexts(batches):
    """The open passages of each document: anchor, place, and text."""
    for batch in batches:
        did, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        buf, offs = utf8(batch.column(2))
        cols = [[] for _ in _CONTEXT]
        for i, lists in enumerate(batch.column(3).to_pylist()):
            need = np.frombuffer(b"".join(lists), _NEED)
            view = memoryview(np.ascontiguousarray(buf[offs[i] : offs[i + 1]]))
            at, lo, hi = need["at"].astype(np.int64), need["lo"].astype(np.int64), need["hi"].astype(np.int64)
            text = [bytes(view[a:b]) for a, b in zip((at - lo).tolist(), (at - hi + WINDOW).tolist())]
            k = len(need)
            for c, v in zip(cols, (need["trig"].view(np.int64).tolist() if k else [], [did[i]] * k, [th[i]] * k, (at - lo).tolist(), text)):
                c += v
            if len(cols[0]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT)], schema=_CONTEXT)
                cols = [[] for _ in _CONTEXT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT)], schema=_CONTEXT)


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, of four bytes each; equal keys have equal ranks."""
    order = np.argsort(key)
    key = key[order]
    rank = np.ones(len(key), np.int32)
    rank[1:] += np.cumsum(key[1:] != key[:-1], dtype=np.int32)
    out = np.empty_like(rank)
    out[order] = rank
    return out


def doubled(rank: np.ndarray, ends: np.ndarray, step: int, enough: int) -> np.ndarray:
    """Prefix doubling: ranks by the first ``step`` symbols become ranks by ``enough`` or more, up to the end of each one's string."""
    left = (ends - np.arange(len(rank))).astype(np.int32)
    while step < enough:
        key = rank.astype(np.int64)
        key *= int(rank.max()) + 1
        key[:-step] += np.where(left[:-step] > step, rank[step:], 0)
        now = dense(key)
        del key
        if now.max() == len(now):
            return now
        rank, step = now, 2 * step
    return rank


def corpus_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix-free parsing of ``texts``: all positions that start a window, in the order of their suffixes (as text and
    offset), and whether the window equals that of the position before."""
    size = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * TRIGGER
    raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    begin = TRIGGER + np.concatenate(([0], np.cumsum(size + TRIGGER)[:-1]))
    symbol = raw.astype(np.int16) + np.int16(1)
    for k in range(TRIGGER):  # what stands between texts is a symbol of its own, 0
        symbol[begin - 1 - k] = 0
        symbol[len(raw) - 1 - k] = 0
    h, step, power = symbol.astype(U64), 1, U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < TRIGGER:
            h = h[:-step] * power + h[step:]
            power = power * power
            step *= 2
    cut = mix(h) % U64(EVERY) == 0
    del h
    cut[begin - TRIGGER] = cut[-1] = True
    cuts = np.flatnonzero(cut)
    # The dictionary: distinct phrases, triggers at both ends.
    first, last = cuts[:-1], cuts[1:] + TRIGGER
    view = memoryview(symbol).cast("B")
    digest = np.array([xxhash.xxh3_64_intdigest(view[2 * a : 2 * b]) for a, b in zip(first.tolist(), last.tolist())], U64)
    _, sample, phrase = np.unique(digest, return_index=True, return_inverse=True)
    length = (last - first)[sample]
    base = np.concatenate(([0], np.cumsum(length)))
    book = symbol[np.repeat(first[sample] - base[:-1], length) + np.arange(base[-1])]
    ends = np.repeat(base[1:].astype(np.int32), length)
    left = ends - np.arange(len(book), dtype=np.int32)
    # Its suffix array, from 7 symbols on.
    packed = np.zeros(len(book), np.int64)
    for k in range(7):
        packed <<= 9
        packed[: len(book) - k] |= np.where(left[: len(book) - k] > k, book[k:], np.int16(0))
    rank = dense(packed)
    del packed, left, book
    rank = doubled(rank, ends, 7, int(length.max()))
    del ends
    # The parse and its suffix array: phrases by rank, as many as a window can reach into.
    parse = rank[base[:-1]][phrase]
    reach, k = np.concatenate((cuts, np.full(WINDOW, cuts[-1] + WINDOW))), 1
    while k < WINDOW and (reach[k : k + len(parse)] - cuts[:-1]).min() < WINDOW:
        k *= 2
    order = np.concatenate((doubled(parse, np.full(len(parse), len(parse)), 1, k), [0]))
    # Combined: the rest of the phrase, then the parse after it.
    count = np.maximum(size - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[text] + offset
    j = np.searchsorted(cuts, at, "right") - 1
    key = rank[base[phrase[j]] + at - cuts[j]].astype(np.int64)
    key *= int(order.max()) + 1
    key += order[j + 1]
    place = np.argsort(key, kind="stable")
    del key, j
    at, text, offset = at[place], text[place], offset[place]
    same = np.zeros(len(at), bool)
    if len(at):
        words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        same[1:] = True
        for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            w = words[at + k]
            same[1:] &= w[1:] == w[:-1]
    return text, offset, same


def repeats(did, th, start, texts):
    """(text, offset) of windows that equal an earlier one, and of the first of each class, with whether it has others."""
    text, offset, same = corpus_order(texts)
    group = np.cumsum(~same)
    several = same.copy()
    several[:-1] |= same[1:]
    lone_text, lone_offset = text[~several], offset[~several]
    text, offset, group = text[several], offset[several], group[several]
    by = np.lexsort(((start[text] + offset), th[text], did[text], group))
    text, offset, group = text[by], offset[by], group[by]
    again = np.zeros(len(text), bool)
    again[1:] = group[1:] == group[:-1]
    firsts = np.concatenate((lone_text, text[~again])), np.concatenate((lone_offset, offset[~again]))
    return (text[again], offset[again]), firsts


def _spans_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SPANS)], schema=_SPANS)


def _arrays(tables: list[pa.Table]):
    t = pa.concat_tables(tables).combine_chunks()
    return (*(t.column(c).to_numpy().astype(np.int64) for c in ("did", "th", "start")), t.column("text").to_pylist())


def _compare(batches):
    """Sorted by anchor: spans of repeated windows. Several anchors are sorted together; none is split."""

    def flush(tables):
        did, th, start, texts = _arrays(tables)
        (i, k), _ = repeats(did, th, start, texts)
        return _spans_batch(spans_by_doc(did[i], th[i], start[i] + k, start[i] + k + WINDOW) if len(i) else [])

    held, n = [], 0
    for t in grouped(batches, 1):
        if t.num_rows < 2:
            continue
        if held and n + t.num_rows > PART:
            yield flush(held)
            held, n = [], 0
        held.append(t)
        n += t.num_rows
    if held:
        yield flush(held)


_HOT = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("spans", pa.binary())])


def _windows(batches):
    """Parts of hot anchors: spans of windows repeated in the part, and the first of each class by 128-bit digest."""

    def flush(tables):
        did, th, start, texts = _arrays(tables)
        (i, k), (fi, fk) = repeats(did, th, start, texts)
        spans = spans_by_doc(did[i], th[i], start[i] + k, start[i] + k + WINDOW) if len(i) else []
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[x][y : y + WINDOW]) for x, y in zip(fi.tolist(), fk.tolist())), np.int64).reshape(-1, 2)
        n, m = len(fi), len(spans)
        column = lambda a, b, kind: pa.array([*a, *b], kind)
        return pa.RecordBatch.from_arrays(
            [
                column(d[:, 0].tolist(), [None] * m, pa.int64()), column(d[:, 1].tolist(), [None] * m, pa.int64()), column(did[fi].tolist(), (x[0] for x in spans), pa.int64()),
                column(th[fi].tolist(), (x[1] for x in spans), pa.int64()), column((start[fi] + fk).tolist(), [None] * m, pa.int64()), column([None] * n, (x[2] for x in spans), pa.binary()),
            ],
            schema=_HOT,
        )

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
        if n > PART // 2:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _pack(batches):
    for batch in batches:
        did, th, s = (batch.column(k).to_numpy() for k in range(3))
        yield _spans_batch(spans_by_doc(did, th, s, s + WINDOW))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether a doc_id occurs twice; nulls count as one id. Reads ids only."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def keyed(docs: DataFrame, repeated: bool, *more) -> DataFrame:
    """did, th: the corpus order of rows; text not null. Where ids don't repeat, th is 0 and costs nothing to move."""
    th = F.expr("xxhash64(text)") if repeated else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), th.alias("th"), F.coalesce("text", F.lit("")).alias("text"), *more)


def repeated_spans(docs: DataFrame, repeated: bool) -> DataFrame:
    """did, th, lists: the packed spans (int64 pairs) of each document that has bytes to remove."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, repeated)
    buckets = max(32, 4 * rows.rdd.getNumPartitions())
    parsed = rows.mapInArrow(_parse(buckets), "bucket int, entries binary, did long, th long, spans binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    told = parsed.repartition(max(parts, buckets // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(_dictionary, "did long, th long, spans binary, open binary")
    told = scratch.keep(told, "phrases")
    flush_shuffles(spark)
    need = told.where("open is not null").groupBy("did", "th").agg(F.collect_list("open").alias("open"))
    schema = "trig long, did long, th long, start long, text binary"
    around = scratch.keep(rows.join(need, ["did", "th"]).mapInArrow(_contexts, schema), "contexts")
    flush_shuffles(spark)
    hot = scratch.keep(around.groupBy("trig").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("trig"), "hot")
    n_hot = hot.count()
    cold, seen = around, None
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= SMALL else hot
        cold, seen = around.join(hot, "trig", "left_anti"), around.join(hot, "trig", "left_semi")
    spans = told.where("spans is not null").select("did", "th", "spans")
    spans = spans.unionByName(cold.repartition(parts, "trig").sortWithinPartitions("trig").mapInArrow(_compare, "did long, th long, spans binary"))
    if seen is not None:
        seen = scratch.keep(seen.mapInArrow(_windows, "w1 long, w2 long, did long, th long, s long, spans binary"), "windows")
        met = seen.where("spans is null")
        first = met.groupBy("w1", "w2").agg(F.min(F.struct("did", "th", "s")).alias("f"), F.count("*").alias("c")).where("c > 1")
        again = met.join(first, ["w1", "w2"]).where("struct(did, th, s) > f").select("did", "th", "s").mapInArrow(_pack, "did long, th long, spans binary")
        spans = spans.unionByName(again).unionByName(seen.where("spans is not null").select("did", "th", "spans"))
    return spans.groupBy("did", "th").agg(F.collect_list("spans").alias("lists"))


_KEPT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            cols = [[] for _ in _KEPT]
            for i, lists in enumerate(batch.column(2).to_pylist()):
                text = buf[offs[i] : offs[i + 1]]
                s = e = np.zeros(0, np.int64)
                if lists:
                    pairs = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
                    s, e = join_spans(pairs[:, 0], pairs[:, 1])
                keep, pos = [], 0
                for a, b in zip(s.tolist(), e.tolist()):
                    keep.append(text[pos:a].tobytes())
                    pos = b
                keep.append(text[pos:].tobytes())
                kept = b"".join(keep)
                for c, v in zip(cols, (len(text), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, _KEPT))], schema=pa.schema([("doc_id", pa.int64()), *_KEPT]))

    return run


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining text, null unless with_text).

    Characters cut by the edge of a removed run are left out of ``kept``; the digest is over the bytes.
    """
    repeated = ids_repeat(docs)
    spans = repeated_spans(docs, repeated)
    rows = keyed(docs, repeated).join(spans, ["did", "th"], "left").select(F.expr(f"nullif(did, {NO_ID})").alias("doc_id"), "text", "lists")
    return rows.mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")
