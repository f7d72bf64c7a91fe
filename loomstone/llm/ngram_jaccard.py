"""Operator 1: n-gram Jaccard join.

Sets of 5-word shingles, joined at 100*|A n B| >= 80*|A u B|, by size-banded tiles with hashed bitmap
signatures: bit counts bound the overlap from above before sorted arrays are intersected exactly.

1. Equal sets become one class (a 128-bit digest of the sorted set); only classes go on.
2. Two sets that link differ in at most floor(0.2 n) shingles of either, so their prefixes of floor(0.2 n) + 1 shingles
   in one fixed order share one. Nothing is lost by it. The order takes shingles found often last (a bounded table
   that changes the work, not the result) and the others by hash. Shingles in the prefix of one class alone lead nowhere and
   are dropped before anything else moves: packed pairs (shingle, class) meet in buckets; a shingle that a task
   finds in several classes is known to be shared and sends its bucket no more than a mark. Pairs are packed short: 44 bits of
   the shingle, sorted, as differences, and a tag of 40 bits for the class. Shingles that coincide so only add candidates;
   classes that share a tag meet under a shingle of their own.
3. Of shared shingles with the same classes one is kept. A class joins the tile (shared shingle, size band). Sets that link have
   sizes within a factor of 1.25, so they meet in one band or in neighbouring ones. Of tiles with the same members one is kept.
4. Every member meets one member of its tile, the hub. Bit counts come first and move signatures only; of the pairs that
   pass, texts move for the exact intersection: first one hub for each class, then the other hubs of classes that
   aren't in one component with them yet. Hubs with many members are copied to blocks of them, so what moves is in proportion
   to the members. Groups of near copies become components here, and tiles inside one component are done.
5. In the other tiles, dealt in pairs of blocks, members of different components are compared by bitmaps (4 or more bits
   a shingle), and pairs whose bound passes are verified exactly like those with hubs: first a spanning forest of the
   components, then a few pairs for two components, at last all that are left.

Components come from verified links only. Words are hashed by polynomials modulo two primes, shingles from these; links
are verified with other polynomials than the ones candidates were found with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, chunks, components, documents, flush_shuffles, mix, utf8

WORDS, NUM, DEN = 5, 80, 100
CHUNK = 1 << 20
HEAVY_ROWS = 1 << 20  # bound of the broadcast table of frequent shingles (16 bytes each)
HEAVY_LOCAL, HEAVY_LEAST = 4, 48
SMALL = 500_000  # rows of 24 bytes that are broadcast; above, the join shuffles
TILE_ROWS = 1024  # rows of a block of a tile, members of a block of a hub
ENTRIES = 1_000_000  # pairs (shingle, class) gathered before they are packed
BUCKET = 250_000  # pairs of a bucket, about
KEY_SHIFT = 20  # the upper 44 bits of a shingle are dealt
TAG = (1 << 40) - 1  # bits of a class's tag; the lowest is always set, 0 is a mark
PASSES = (1, 16, 0)  # pairs of two components that a pass over open tiles yields; the last yields all
FIND, VERIFY = 0, 1  # two hash functions of words
#: Two primes and a base for each: a word's hash is its polynomial modulo both (62 bits), finalised with its length.
MODULI = (2147483647, 2147483629)
BASES = ((1103515245, 1540483477), (1812433253, 668265263))
BLOCK = 1 << 18  # bytes of words that are hashed at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_C = [U64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


class Residues:
    """Powers of a base and of its inverse modulo a prime, grown on demand by doubling."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime = base, prime
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            size = len(self.tables[0])
            for k, root in enumerate((self.base, pow(self.base, -1, self.prime))):
                self.tables[k] = np.concatenate([self.tables[k], self.tables[k] * U64(pow(root, size, self.prime)) % U64(self.prime)])
        return self.tables


_RESIDUES = [[Residues(b, p) for b, p in zip(bases, MODULI)] for bases in BASES]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words at ``starts`` to ``ends``, block by block: memory grows with BLOCK or the longest word."""
    out, lo = np.zeros(len(starts), U64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        low, h = _LOWER[buf[a:b]].astype(U64) + U64(1), np.zeros(hi - lo, U64)
        for r in _RESIDUES[seed]:
            up, down = r.upto(b - a + 1)
            prime, total = U64(r.prime), np.zeros(b - a + 1, U64)
            for at in range(0, b - a, 1 << 22):  # sums stay below 2**64
                part = total[at + 1 : at + (1 << 22) + 1]
                np.cumsum(low[at : at + (1 << 22)] * up[at : min(at + (1 << 22), b - a)], out=part)
                part += total[at] % prime
            h = (h << U64(31)) ^ ((total[e] % prime + prime - total[s] % prime) % prime * down[s] % prime)
        out[lo:hi] = h
        lo = hi
    return mix(out ^ (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, seed: int = FIND) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a chunk: words are runs without ASCII white space, A-Z lower-cased."""
    n_docs = len(offs) - 1
    if len(buf) == 0:
        return [np.zeros(0, U64)] * n_docs
    inside = ~_SPACE[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = offs[:-1][offs[:-1] < len(buf)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offs[1:] - 1
    after[last[(last >= 0) & (last < len(buf))]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    word = word_hashes(buf, starts, ends, seed)
    first = np.searchsorted(starts, offs)
    if len(word) >= WORDS:
        m = len(word) - WORDS + 1
        sh = word[:m].copy()
        for k in range(1, WORDS):
            sh += word[k : k + m] * _C[k]
        sh = mix(sh)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(sh[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = word[a:b] * np.array(_C[: b - a]) + U64(b - a)
            out.append(mix(h.sum(keepdims=True)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _sets(batch: pa.RecordBatch, seed: int = FIND):
    """(row of the batch, set) for a batch with a column text."""
    buf, offs = utf8(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in chunks(offs, CHUNK):
        part = shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], seed)
        for i, s in enumerate(part):
            yield lo + i, s


def _frequent(batches):
    """Shingles found in several different sets of this partition, with their counts; at last, without a shingle, how many all prefixes hold."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])
    seen, held, size, pairs = set(), [], 0, 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c >= HEAVY_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], schema=schema)

    for batch in batches:
        for _, s in _sets(batch):
            d = xxhash.xxh3_64_intdigest(s)
            if len(s) and d not in seen:
                seen.add(d)
                held.append(s)
                size += len(s)
                pairs += prefix_size(len(s))
            if size > 2_000_000:
                yield flush()
                seen, held, size = set(), [], 0
    if held:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([pairs], pa.int64())], schema=schema)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """At most HEAVY_ROWS frequent shingles and their ranks, and about how many shingles all prefixes hold; only the order of
    prefixes and the number of buckets depend on them."""
    rows = (
        docs.select("text").mapInArrow(_frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where((F.col("c") >= HEAVY_LEAST) | F.col("h").isNull())
        .orderBy(F.col("h").isNotNull(), F.desc("c"), "h").limit(HEAVY_ROWS + 1).toArrow()
    )
    pairs = pc.sum(rows.filter(pc.is_null(rows["h"]))["c"]).as_py() or 0
    rows = rows.filter(pc.is_valid(rows["h"]))
    h, c = rows["h"].to_numpy().astype(np.int64).view(U64), rows["c"].to_numpy().astype(np.float64)
    rank = (1 + np.log2(np.maximum(c, 1))).astype(np.uint8)
    order = np.argsort(h)
    return h[order], rank[order], pairs


def band(n):
    """Sizes a <= b with 100 a >= 80 b are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.int32)


def width(n: int) -> int:
    """Bits of the signature: a power of two with 4 to 8 bits a shingle."""
    return max(64, 1 << int(4 * max(n, 1) - 1).bit_length())


def signature(s: np.ndarray) -> bytes:
    w = width(len(s))
    bits = np.zeros(w // 64, U64)
    at = s & U64(w - 1)
    np.bitwise_or.at(bits, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return bits.tobytes()


def prefix_size(n: int) -> int:
    return n * (DEN - NUM) // DEN + 1


def prefix(s: np.ndarray, heavy: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first floor(0.2 n) + 1 shingles in the fixed order (rank, hash); rank 0 for shingles that aren't in the table."""
    m = prefix_size(len(s))
    mixed = mix(s ^ U64(0x5851F42D4C957F2D))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        rank = np.where(heavy[at] == s, ranks[at], 0)
        return s[np.lexsort((mixed, rank))[:m]]
    return s[np.argsort(mixed)[:m]]


_ROWS = [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("band", pa.int32()), ("sig", pa.binary())]
_DEALT = [("bucket", pa.int32()), ("key", pa.int64()), ("tag", pa.int64()), ("packed", pa.binary())]
_PROFILE = pa.schema(_ROWS + _DEALT)
PROFILE = "doc_id long, th long, n long, d1 long, d2 long, band int, sig binary, bucket int, key long, tag long, packed binary"


def _part(columns: list, first: int) -> pa.RecordBatch:
    """A batch of _PROFILE of which only some columns are filled, from number ``first``."""
    n = len(columns[0])
    filled = {first + k: pa.array(c, _PROFILE.types[first + k]) for k, c in enumerate(columns)}
    return pa.RecordBatch.from_arrays([filled.get(k, pa.nulls(n, t)) for k, t in enumerate(_PROFILE.types)], schema=_PROFILE)


def _profile(heavy, buckets: int, shift: int, mask: int):
    """Rows as they are, without their texts, and the pairs (shingle of the prefix, class) of this task, dealt to buckets."""

    def run(batches):
        table, ranks = heavy.value
        pairs = Pairs(buckets, shift, mask)
        for batch in batches:
            known = batch.column(0).is_valid().to_pylist()
            n, d, sig = [], [], []
            for i, s in _sets(batch):
                n.append(len(s))
                x = xxhash.xxh3_128_digest(s)
                d.append(x)
                sig.append(signature(s) if len(s) else b"")
                if len(s) and known[i] and pairs.unseen(x):
                    pairs.add(prefix(s, table, ranks), x)
            both = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield _part([batch.column(0), batch.column(1), n, both[:, 0], both[:, 1], band(np.array(n, np.int64)), sig], 0)
            if pairs.size > ENTRIES:
                yield from pairs.flush()
        if pairs.size:
            yield from pairs.flush()

    return run


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) folded to ``words`` 64-bit words: position modulo a smaller power of two."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _halved(batches):
    """Signatures folded to half their bits (2 to 4 a shingle), for tiles: a class is in many."""
    for batch in batches:
        sig = [fold(np.frombuffer(b, U64)[None], max(1, len(b) // 16)).tobytes() for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.binary())], names=["node", "n", "sig"])


class Members:
    """Rows of a tile or block: sizes and signatures, kept by width, compared one against many."""

    def __init__(self, n: np.ndarray, sigs: list[bytes]):
        self.n = n
        self.words = np.array([len(s) // 8 for s in sigs])
        self.by = {int(w): (at := np.flatnonzero(self.words == w), np.frombuffer(b"".join(sigs[i] for i in at), U64).reshape(len(at), w)) for w in np.unique(self.words)}
        self.place = np.zeros(len(sigs), np.int64)
        for at, _ in self.by.values():
            self.place[at] = np.arange(len(at))

    def passing(self, x: int, open_: np.ndarray) -> np.ndarray:
        """Rows of the mask ``open_`` whose overlap with row x may reach the threshold, by sizes and bit counts."""
        found, w0 = [], int(self.words[x])
        mine = self.by[w0][1][self.place[x]][None, :]
        for w, (at, bits) in self.by.items():
            sel = open_[at] & (DEN * np.minimum(self.n[at], self.n[x]) >= NUM * np.maximum(self.n[at], self.n[x]))
            if not sel.any():
                continue
            at, theirs, own = at[sel], bits[sel], mine
            least = min(w, w0)
            theirs, own = fold(theirs, least), fold(own, least)
            over = np.minimum(self.n[x] - np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), self.n[at] - np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64))
            found.append(at[DEN * over >= NUM * (self.n[x] + self.n[at] - over)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def grouped(batches, keys: int):
    """Whole groups (runs of equal first ``keys`` columns) of sorted batches, as tables."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table])
        n = table.num_rows
        if not n:
            continue
        cols = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(n, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        table = table.combine_chunks()
        for a, b in zip(at[:-1], at[1:]):
            yield table.slice(a, b - a)
        held = table.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _several(key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of keys, and whether the key has several of them."""
    order = np.lexsort((tag, key))
    key, tag = key[order], tag[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    key, tag = key[new], tag[new]
    twin = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    return key, tag, twin


def planes(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of numbers: all first ones, all second ones and so on."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def packed(key: np.ndarray, tag: np.ndarray) -> bytes:
    """Pairs in the order of keys, the keys as differences of as many bytes as the largest needs."""
    step = np.diff(key, prepend=U64(0))
    width = max(1, -(-int(step.max()).bit_length() // 8))
    return bytes([width]) + planes(step, width) + planes(tag, 5)


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = b[0]
    rows = np.frombuffer(b, np.uint8, offset=1).reshape(width + 5, -1)
    out = np.zeros((2, rows.shape[1], 8), np.uint8)
    out[0, :, :width], out[1, :, :5] = rows[:width].T, rows[width:].T
    key, tag = out.view("<u8")[:, :, 0].astype(U64)
    return np.cumsum(key, dtype=U64), tag


class Pairs:
    """Pairs (key, tag of a class) of a task: those of keys found in several classes go as they are, with one mark (tag 0) for the
    key's bucket; the others packed by bucket."""

    def __init__(self, buckets: int, shift: int, mask: int):
        self.buckets, self.shift, self.mask = U64(buckets), U64(shift), U64(mask)
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen: set[bytes] = set()
        self.size = 0

    def unseen(self, digest: bytes) -> bool:
        new = digest not in self.seen
        self.seen.add(digest)
        return new

    def add(self, shingles: np.ndarray, digest: bytes) -> None:
        tag = (np.frombuffer(digest, U64)[:1] & self.mask) | U64(1)
        self.held.append((shingles >> self.shift, np.repeat(tag, len(shingles))))
        self.size += len(shingles)

    def flush(self):
        key, tag, twin = _several(np.concatenate([k for k, _ in self.held]), np.concatenate([t for _, t in self.held]))
        self.clear()
        for lo in range(0, int(twin.sum()), 1 << 16):
            k, t = (x[twin][lo : lo + (1 << 16)].view(np.int64) for x in (key, tag))
            yield _part([np.full(len(k), -1), k, t], len(_ROWS))
        marks = np.unique(key[twin])
        key, tag = np.concatenate([key[~twin], marks]), np.concatenate([tag[~twin], np.zeros(len(marks), U64)])
        home = key % self.buckets
        order = np.lexsort((key, home))
        key, tag, home = key[order] // self.buckets, tag[order], home[order].astype(np.int32)
        at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))).tolist()
        none = [None] * len(at)
        yield _part([home[at], none, none, [packed(key[a:b], tag[a:b]) for a, b in zip(at, [*at[1:], len(home)])]], len(_ROWS))


def _shared_keys(buckets: int):
    """Per bucket: pairs whose key has several classes, here or by a mark."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("tag", pa.int64())])
        for t in grouped(batches, 1):
            parts = [unpacked(b) for b in t.column("packed").to_pylist()]
            key, tag, twin = _several(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts]))
            keep = twin & (tag != 0)
            key = key[keep] * U64(buckets) + U64(t.column("bucket")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag[keep].view(np.int64))], schema=schema)

    return run


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _tiles(most: int):
    """Groups (key, band, i, j): pairs of members of different components whose bound passes.

    ``most`` 1: a spanning forest of the components, which merges them if its pairs link; above: so many pairs for two
    components; 0: all pairs. A tile without such a pair yields nothing and is done.
    """
    schema = pa.schema([*_EDGES, ("key", pa.int64()), ("band", pa.int32())])

    def run(batches):
        for t in grouped(batches, 4):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            own, role, blk, comp = t.column("node").to_numpy(), t.column("role").to_numpy() == 1, t.column("blk").to_numpy(), t.column("comp").to_numpy()
            if t.num_rows < 2 or not role.any():
                continue
            m = Members(t.column("n").to_numpy(), t.column("sig").to_pylist())
            _, comp = np.unique(comp, return_inverse=True)
            root, count = comp.copy(), {}
            a, b = [], []
            tile = [pa.scalar(t.column(k)[0].as_py(), f.type) for k, f in (("key", schema.field(2)), ("band", schema.field(3)))]
            place = np.arange(len(own))
            for x in np.flatnonzero(blk == i).tolist():
                # role 1: of this band; role 0: of the band below, compared with this band only.
                mask = (blk == j) & (root != root[x]) & (role | role[x])
                if i == j:
                    mask &= place > x
                got = m.passing(x, mask) if mask.any() else np.zeros(0, np.int64)
                if most == 1 and len(got):
                    met, first = np.unique(root[got], return_index=True)
                    got = got[first]
                    root[np.isin(root, met)] = root[x]
                elif most and len(got):
                    keep = []
                    for y in got.tolist():
                        pair = (min(comp[x], comp[y]), max(comp[x], comp[y]))
                        count[pair] = count.get(pair, 0) + 1
                        if count[pair] <= most:
                            keep.append(y)
                    got = np.array(keep, np.int64)
                a += [int(own[x])] * len(got)
                b += [int(own[y]) for y in got]
                if len(a) > 50_000:
                    yield pa.RecordBatch.from_arrays([*_edges(a, b).columns, *(pa.repeat(v, len(a)) for v in tile)], schema=schema)
                    a, b = [], []
            if a:
                yield pa.RecordBatch.from_arrays([*_edges(a, b).columns, *(pa.repeat(v, len(a)) for v in tile)], schema=schema)

    return run


def bound(n: int, a: bytes, m: int, b: bytes) -> int:
    """An upper bound of the overlap of two sets by their sizes and the bits the other's signature lacks."""
    x, y = np.frombuffer(a, U64)[None], np.frombuffer(b, U64)[None]
    least = min(x.shape[1], y.shape[1])
    x, y = fold(x, least), fold(y, least)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _bounded(batches):
    """Pairs (hub, node) whose bound reaches the threshold."""
    for batch in batches:
        hub, node, n, sig, hub_n, hub_sig = (c.to_pylist() for c in batch.columns)
        keep = []
        for k in range(batch.num_rows):
            over = bound(n[k], sig[k], hub_n[k], hub_sig[k])
            keep.append(DEN * over >= NUM * (n[k] + hub_n[k] - over))
        yield batch.select(["hub", "node"]).filter(pa.array(keep, pa.bool_()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _star(batches):
    """Sorted groups (hub, salt) of texts, the hub's own first: verified links. A row counts if its text has the class's digest."""
    here, mine = None, None
    for batch in batches:
        hub, salt, own, node, d1 = (batch.column(k).to_pylist() for k in range(5))
        found = _sets(batch, FIND)
        a, b = [], []
        for (i, check), (_, s) in zip(found, _sets(batch, VERIFY)):
            if len(check) and int.from_bytes(xxhash.xxh3_128_digest(check)[:8], "little", signed=True) != d1[i]:
                continue  # another text with the same doc_id
            if not own[i]:
                here, mine = (hub[i], salt[i]), s
            elif here == (hub[i], salt[i]) and linked(mine, s):
                a.append(hub[i])
                b.append(node[i])
        yield _edges(a, b)


def in_blocks(df: DataFrame, blocks: str) -> DataFrame:
    """Rows dealt to pairs (i, j), i <= j, of ``blocks`` blocks; blk is the row's own block."""
    return (
        df.withColumn("blk", F.expr(f"cast(pmod(xxhash64(node, 7), {blocks}) as int)"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
        .withColumn("i", F.least("blk", "other"))
        .withColumn("j", F.greatest("blk", "other"))
        .drop("other")
    )


def verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """The links among ``pairs`` (hub, node), a kept table: every hub's text meets the texts of its nodes, in blocks of TILE_ROWS of them."""
    blocks = pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {TILE_ROWS}) as int)").alias("nb"))
    members = pairs.join(blocks, "hub").select("hub", F.expr("cast(pmod(xxhash64(node, 11), nb) as int)").alias("salt"), F.lit(1).alias("own"), "node")
    hubs = blocks.select("hub", F.explode(F.expr("sequence(0, nb - 1)")).alias("salt"), F.lit(0).alias("own"), F.col("hub").alias("node"))
    rows = members.unionByName(hubs).join(texts, "node").select("hub", "salt", "own", "node", "d1", "text")
    out = scratch.keep(rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "own", "node").mapInArrow(_star, "a long, b long"), "links")
    del rows, members, hubs, blocks
    flush_shuffles(scratch.spark)
    return out


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, component per row: th is a hash of the text, component a name of the group that tells
    groups with the same least doc_id apart (null where the set is empty or the doc_id null)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    *table, pairs = frequent_shingles(docs)
    buckets = max(32, 2 * parts, pairs // BUCKET)
    heavy = spark.sparkContext.broadcast(tuple(table))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # One pass over the texts gives rows and dealt pairs; prefixes are never written.
    dealt = scratch.keep(rows.mapInArrow(_profile(heavy, buckets, KEY_SHIFT, TAG), PROFILE), "rows")
    rows = dealt.where("bucket is null").select("doc_id", "th", "n", "d1", "d2", "band", "sig")
    # A class is named by its least doc_id, or by a hash where ids repeat and so may name several classes.
    repeated = not rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n", "band").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes.select("*", (F.xxhash64("rep", "d1", "d2") if repeated else F.col("rep")).alias("node"), F.expr(f"d1 & {TAG}L | 1L").alias("tag")), "classes")
    flush_shuffles(spark)

    met = dealt.where("packed is not null").select("bucket", "packed").repartition(max(parts, buckets // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_keys(buckets), "key long, tag long")
    shared = scratch.keep(dealt.where("bucket = -1").select("key", "tag").unionByName(met), "shared")
    # Dealt pairs aren't read any more; they go before what they share is shuffled.
    rows = scratch.keep(rows.drop("band"), "rows")
    scratch.drop(dealt)
    del met, dealt
    flush_shuffles(spark)
    # Classes that share a tag look like one above: they meet under a key of their own.
    alike = classes.groupBy("tag").agg(F.count("*").alias("c")).where("c > 1").select((-F.col("tag")).alias("key"), "tag")
    whole, shared = shared, scratch.keep(shared.distinct().unionByName(alike), "shared")
    scratch.drop(whole)
    del alike, whole
    flush_shuffles(spark)

    def same(*c: str) -> list:
        """Rows of a group as a set: equal in number and in two sums modulo 2 of hashes."""
        return [F.count("*").alias("c"), F.bit_xor(F.xxhash64(*c)).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), *c)).alias("y")]

    keys = shared.groupBy("key").agg(*same("tag")).groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    keys = scratch.keep(keys, "keys")
    flush_shuffles(spark)
    keys = F.broadcast(keys) if keys.count() <= SMALL else keys
    sides = F.explode(F.expr("array(named_struct('band', band, 'role', 1), named_struct('band', band + 1, 'role', 0))"))
    tiled = shared.join(keys, "key", "left_semi").join(classes.select("tag", "node", "band"), "tag").select("key", "node", sides.alias("t")).select("key", "t.band", "t.role", "node")
    tiled = scratch.keep(tiled, "dealt")
    scratch.drop(shared)
    del shared, keys
    flush_shuffles(spark)
    hub = F.min(F.when(F.col("role") == 1, F.struct(F.xxhash64("node", F.lit(3)).alias("h"), F.col("node")))).alias("hub")
    tiles = tiled.groupBy("key", "band").agg(*same("node", "role"), hub)
    tiles = tiles.where("c > 1 and hub is not null").groupBy("c", "x", "y").agg(F.min(F.struct("key", "band", F.col("hub.node").alias("hub"))).alias("t"))
    tiles = tiles.select("t.key", "t.band", "t.hub")
    members = scratch.keep(tiled.join(tiles, ["key", "band"]), "members")
    scratch.drop(tiled)
    del tiled, tiles, hub
    flush_shuffles(spark)
    sigs = rows.join(classes.select("node", F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select("node", "n", "sig").dropDuplicates(["node"])
    sigs = scratch.keep(sigs.join(members.select("node").distinct(), "node", "left_semi"), "sigs")
    whole, rows = rows, scratch.keep(rows.select("doc_id", "th", "n", "d1", "d2"), "rows")
    scratch.drop(whole)
    del whole
    flush_shuffles(spark)

    def texts_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select("node").union(pairs.select("hub")).distinct()
        known = scratch.keep(classes.select("node", "rep", "d1").join(nodes, "node", "left_semi"), "nodes")
        known = F.broadcast(known) if known.count() <= SMALL else known
        return scratch.keep(docs.join(known, docs["doc_id"] == F.col("rep")).select("node", "d1", "text"), "texts")

    pairs = members.where("node <> hub").select("hub", "node").distinct().join(sigs.select("node", "n"), "node")
    pairs = pairs.join(sigs.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub").where(f"{DEN} * least(n, hub_n) >= {NUM} * greatest(n, hub_n)")
    pairs = pairs.join(sigs.select("node", "sig"), "node").select("hub", "node", "n", "sig", "hub_n", "hub_sig").mapInArrow(_bounded, "hub long, node long")
    pairs = scratch.keep(pairs, "pairs")
    texts = texts_of(pairs)
    flush_shuffles(spark)
    one = scratch.keep(pairs.groupBy("node").agg(F.min_by("hub", F.xxhash64("hub", F.lit(3))).alias("hub")).select("hub", "node"), "pairs")
    links = verified(scratch, one, texts, parts)
    comps = scratch.keep(components(scratch, links), "comps")

    def of(name: str) -> DataFrame:
        return comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))

    rest = pairs.join(one, ["hub", "node"], "left_anti").join(of("node"), "node", "left").join(of("hub"), "hub", "left")
    rest = scratch.keep(rest.where("coalesce(node_comp, node) <> coalesce(hub_comp, hub)").select("hub", "node"), "pairs")
    if not rest.isEmpty():
        links = scratch.keep(links.union(verified(scratch, rest, texts, parts)), "links")
        comps = scratch.keep(components(scratch, links), "comps")

    scratch.drop(texts)
    told = pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
    open_tiles = None
    slim = scratch.keep(sigs.mapInArrow(_halved, "node long, n long, sig binary"), "slim")
    for most in PASSES:
        open_ = members if open_tiles is None else members.join(open_tiles, ["key", "band"])
        open_ = open_.drop("hub").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        tiles = open_.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi and c > 2")
        tiles = tiles.select("key", "band", F.expr(f"cast(ceil(c / {TILE_ROWS}) as int)").alias("nb"))
        left = scratch.keep(open_.join(tiles, ["key", "band"]), "left")
        if left.isEmpty():
            break
        placed = in_blocks(left, "nb").join(slim if most == 1 else sigs, "node").select("key", "band", "i", "j", "role", "blk", "node", "comp", "n", "sig")
        found = placed.repartition(parts, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInArrow(_tiles(most), "a long, b long, key long, band int")
        found = scratch.keep(found, "found")
        scratch.drop(left)
        del left, placed, tiles
        flush_shuffles(spark)
        open_tiles = found.select("key", "band").distinct()
        found = found.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("node")).distinct()
        found = scratch.keep(found.join(told, ["hub", "node"], "left_anti"), "pairs")
        if found.isEmpty():
            continue
        texts = texts_of(found)
        links = scratch.keep(links.union(verified(scratch, found, texts, parts)), "links")
        scratch.drop(texts)
        comps = scratch.keep(components(scratch, links), "comps")
        told = told.union(found)
    named = classes.join(comps, "node", "left").select("d1", "d2", "n", "rep", F.coalesce("comp", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").drop("rep")
    out = rows.select("doc_id", "th", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    lone = F.expr("case when doc_id is null then null else coalesce(component_id, doc_id) end")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), lone.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text); other columns are ignored, whatever their names.

    Null or empty texts have n_shingles 0 and are their own component. Rows with a null doc_id get component_id null and
    take no part in links. Rows that repeat a doc_id are linked by their own texts: each has the component of its text, and
    sharing the id links nothing. Equal texts are one class. No rows give no rows.
    """
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
