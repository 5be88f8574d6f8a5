"""Exact substring deduplication: every byte covered by a string of LENGTH bytes that also starts in a document with a smaller id goes.

Texts are dealt into shards by hash. All equal strings of LENGTH bytes have the same smallest hash of their GRAM-byte
substrings (their key), so keys route the work, and a string can repeat only if its key does:

1. each shard sends its distinct keys (48 bits of each) to key buckets;
2. a bucket sends back the keys that occur in several documents: in one shard, or across shards;
3. a shard builds a suffix array over what the strings cover whose key several of its own documents have (Larsson-Sadakane
   refinement in numpy, from 8 bytes on by doubling, settled suffixes left out), takes Kasai's common prefixes in text order
   (stretches of the text side by side, only as far as LENGTH), and finds each string's smallest document in the shard; the
   strings it has first, which are all those of other keys, are cut into pieces of one key and sent to the key's bucket if
   the key occurs across shards;
4. a bucket takes equal pieces together (found by hash, verified byte by byte); keys with several distinct pieces get
   suffix arrays, of bounded size each, which are merged by binary search of one's strings in the other; what a smaller
   document also has goes back to the shard;
5. a shard removes the union of all spans.

A passage in a third of all documents is one piece per shard and key: about 100 bytes for each SHARD_BYTES of input come
to its bucket (25 MB at 1 TB). A key in over HOT_SHARDS shards is cut by a second key, exactly as by the first. A shard
sends a row for each bucket that it has keys for, never more rows than it has keys. The texts are shuffled once: all three
passes over them read the same exchange.

Defined results: a null text is empty; texts under LENGTH bytes keep everything; a null id is larger than any other and
equal ids are not smaller than each other, whatever their texts; rows keep their multiplicity; only the id and text
columns are read; ids are cast to long (one that is no number fails under ANSI mode and counts as null without it; the
largest long counts as null); an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import ship

LENGTH, GRAM = 50, 20
#: Bytes of text in a shard, on average, and of distinct pieces in one suffix array of a bucket.
SHARD_BYTES, ARRAY_BYTES = 4 << 20, 4 << 20
#: Bytes of text in a shuffle partition, and of text whose keys are in one key bucket (about one key in 16 bytes), on average.
PARTITION_BYTES, KEY_BUCKET_BYTES = 128 << 20, 32 << 20
#: A key in more shards than this is cut by a second key, so that its pieces spread over buckets.
HOT_SHARDS = 256
#: Positions that one lane of the common prefixes goes through.
STRETCH = 64
NO_ID = np.iinfo(np.int64).max
_A = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SECOND = np.uint64(0xA0761D6478BD642F)
_BYTE_STEPS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte substrings, by doubling."""
    h = {1: _BYTE[text]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
        if n != 4:
            del h[n]
    return _mix(h[16][: len(text) - GRAM + 1] * _power(4) + h[4][16:])


def window_keys(text: np.ndarray, block: int = 1 << 14, second: bool = False) -> np.ndarray:
    """The smallest gram hash of every string of LENGTH bytes of text; blocks of them stay in a processor's cache. second: of other hashes."""
    keys = np.empty(len(text) - LENGTH + 1, np.uint64)
    for a in range(0, len(keys), block):
        keys[a : a + block] = _block_keys(text[a : a + block + LENGTH - 1], second)
    return keys


def _block_keys(text: np.ndarray, second: bool) -> np.ndarray:
    m, width, want = gram_hashes(text), 1, LENGTH - GRAM + 1
    if second:
        m = _mix(m ^ _SECOND)
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < want:
        m = np.minimum(m[: -(want - width)], m[want - width :])
    return m


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as one number that orders like them (0 beyond the end)."""
    padded = np.concatenate([text, np.zeros(9, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel()[: len(text) + 1].astype(np.uint64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text with these words in the order of their next ``sorted_depth(depth)`` bytes (0 beyond the end), then of the positions."""
    n = len(words) - 1
    key = words[:n]
    order = np.argsort(key)
    ranked = key[order]
    heads = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start + 1, 0
    open_ = ~heads
    open_[:-1] |= ~heads[1:]
    at, h = np.flatnonzero(open_), 8  # places in order that aren't settled
    while h < depth and len(at):
        rows = order[at]
        group = rank[rows]
        both = group << 32 | rank[np.minimum(rows + h, n)]
        by = np.argsort(both)
        rows, both = rows[by], both[by]
        order[at] = rows  # groups are contiguous and in order, so places keep their group
        heads = np.concatenate(([True], both[1:] != both[:-1]))
        first = np.maximum.accumulate(np.where(heads, at, 0))
        rank[rows] = first + 1
        keep = ~heads
        keep[:-1] |= ~heads[1:]
        at, h = at[keep], 2 * h
    rows = order[at]
    order[at] = rows[np.argsort(rank[rows] << 32 | rows)]
    return order


def sorted_depth(depth: int) -> int:
    """Bytes that doubling from 8 on compares to reach depth."""
    return 8 << max(0, -(-depth // 8) - 1).bit_length()


#: Offsets of the words that cover LENGTH bytes; the last overlaps the one before it.
_OFFSETS = [*range(0, LENGTH - 7, 8), LENGTH - 8]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Kasai's common prefixes, up to depth, of the suffixes in order, each with the one before it (0 for the first).

    Positions are taken in text order, where a prefix is at most one byte shorter than the one of the position before;
    stretches of the text go side by side, each from 0 on, and a step compares 8 bytes at a time. The order is one of
    ``deep`` bytes, then of positions: what it says of two suffixes it says of their next ones too, unless they agree in
    deep bytes exactly or reach the end; there the prefix starts from 0 again.
    """
    n, deep = len(words) - 1, sorted_depth(depth)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    length = np.zeros(n, np.int32)
    step = max(1, min(STRETCH, n >> 10))
    start = np.arange(0, n, step)
    h = np.zeros(len(start), np.int64)  # at least as long as the prefix is
    for inside in range(step):
        i = start + inside
        if i[-1] >= n:
            start, h, i = start[:-1], h[:-1], i[:-1]
        j = before[i]
        most = np.where(j >= 0, np.minimum(deep + 1, n - np.maximum(i, j)), 0)
        h = np.minimum(h, most)
        lanes = np.flatnonzero(h < most)
        while len(lanes):
            at = h[lanes]
            equal = 8 - np.searchsorted(_BYTE_STEPS, words[i[lanes] + at] ^ words[j[lanes] + at], side="right")
            h[lanes] = np.minimum(at + equal, most[lanes])
            lanes = lanes[(equal == 8) & (h[lanes] < most[lanes])]
        length[i] = np.minimum(h, depth)
        h = np.where((h == deep) | (most <= deep), 0, np.maximum(h - 1, 0))
    return length[order]


class Shard:
    """Suffix array over strings of LENGTH bytes at ``starts`` of text, each with a document's id: groups of equal strings, in order, with their smallest id."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.words = _words(text)
        chosen = np.full(len(text), -1, np.int64)
        chosen[starts] = np.arange(len(starts))
        order = suffix_array(self.words, LENGTH)
        # strings stay together as long as no common prefix between them falls short
        string = np.cumsum(common_prefixes(self.words, order, LENGTH) < LENGTH)
        mine = chosen[order] >= 0
        order, string = order[mine], string[mine]
        self.at = order
        heads = np.ones(len(order), bool)
        heads[1:] = string[1:] != string[:-1]
        self.first = np.flatnonzero(heads)
        self.group = np.empty(len(starts), np.int64)  # of each start
        self.group[chosen[order]] = np.cumsum(heads) - 1
        self.low = np.minimum.reduceat(ids[chosen[order]], self.first) if len(order) else np.zeros(0, np.int64)

    def heads(self) -> np.ndarray:
        return self.at[self.first]

    def find(self, other: Shard) -> np.ndarray:
        """By binary search, the group here of each of the other's groups; -1 for none."""
        mine, theirs = self.heads(), other.heads()
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = np.zeros(len(open_), bool)
            tied = np.arange(len(open_))
            for off in _OFFSETS:
                a, b = self.words[mine[mid[tied]] + off], other.words[theirs[open_[tied]] + off]
                less[tied] = a < b
                tied = tied[a == b]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        found = np.minimum(low, max(0, len(mine) - 1))
        ok = low < len(mine)
        for off in _OFFSETS:
            ok &= self.words[mine[found] + off] == other.words[theirs + off] if len(mine) else False
        return np.where(ok, found, -1)


def merge(shards: list[Shard]) -> None:
    """Bring every group's smallest id to that over all shards."""
    for i, a in enumerate(shards):
        for b in shards[:i]:
            at = a.find(b)
            hit = np.flatnonzero(at >= 0)
            low = np.minimum(a.low[at[hit]], b.low[hit])
            a.low[at[hit]], b.low[hit] = low, low
    for i in range(len(shards) - 2, -1, -1):  # the last has seen all; carry back what came later
        for b in shards[i + 1 :]:
            at = b.find(shards[i])
            hit = np.flatnonzero(at >= 0)
            shards[i].low[hit] = np.minimum(shards[i].low[hit], b.low[at[hit]])


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob.as_py() if hasattr(blob, "as_py") else blob))


class Texts:
    """A shard's texts, one after the other in a fixed order, and the runs of strings with one key."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        rows = sorted((NO_ID if i is None else i, (t or "").encode("utf-8", "surrogatepass"), i) for i, t in zip(ids, texts, strict=True)) if len(ids) else []
        self.original = [r[2] for r in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.text = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        self.ends = np.cumsum([len(r[1]) for r in rows]).astype(np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(rows) else np.zeros(0, np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, key, row) of the runs of string starts with one key."""
        if len(self.text) < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        keys = window_keys(self.text)
        valid = np.zeros(len(keys) + 1, np.int8)
        long = np.flatnonzero(self.ends - self.starts >= LENGTH)
        fine = np.zeros(len(keys) + 1, np.int64)
        np.add.at(fine, self.starts[long], 1)
        np.add.at(fine, self.ends[long] - LENGTH + 1, -1)
        valid = np.cumsum(fine[:-1]) > 0
        begin = valid.copy()
        begin[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
        begin[self.starts[long]] = True
        first = np.flatnonzero(begin)
        stop = valid.copy()
        stop[:-1] &= begin[1:] | ~valid[1:]
        last = np.flatnonzero(stop)
        return first, last, keys[first] >> np.uint64(16), np.searchsorted(self.ends, first, side="right")


def _rows(name: str, numbers: list[int], blobs: list[bytes], more: dict | None = None) -> pa.Table:
    return pa.table({name: pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())} | (more or {}))


def _parts(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, its places in order) of the numbers that occur."""
    order = np.argsort(number, kind="stable")
    found, first = np.unique(number[order], return_index=True)
    for b, part in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(found) else ():
        yield b, part


def _send_keys(table: pa.Table, buckets: int) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    _, _, keys, rows = Texts(table).runs()
    order = np.argsort(keys, kind="stable")  # rows ascend within a key
    keys, rows = keys[order], rows[order]
    if not len(keys):
        return _rows("bucket", [], [], {"shard": pa.array([], pa.int32())})
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.concatenate((at[1:], [len(keys)])) - 1
    many, keys = rows[end] != rows[at], keys[at]
    out, numbers = [], []
    for b, part in _parts((keys % np.uint64(buckets)).astype(np.int64)):
        six = keys[part].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        out.append(pickle.dumps((six, np.packbits(many[part]).tobytes()), protocol=5))
        numbers.append(b)
    return _rows("bucket", numbers, out, {"shard": pa.array([shard] * len(out), pa.int32())})


def _keys(six: bytes) -> np.ndarray:
    wide = np.zeros((len(six) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _repeated(table: pa.Table, hot_shards: int) -> pa.Table:
    """The keys of a bucket -> for each shard those across shards, those repeated within it alone, and which of the former are in over hot_shards shards."""
    shards, keys, many = [], [], []
    for s, blob in zip(table.column("shard").to_pylist(), table.column("blob"), strict=True):
        six, bits = pickle.loads(blob.as_py())
        k = _keys(six)
        shards.append(np.full(len(k), s, np.int32))
        keys.append(k)
        many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).astype(bool))
    shard, key, multi = map(np.concatenate, (shards, keys, many))
    order = np.argsort(key)
    shard, key, multi = shard[order], key[order], multi[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.concatenate((first, [len(key)])))
    among = np.repeat(n, n)  # shards of each key
    kept = np.flatnonzero((among > 1) | multi)
    shard, key, among = shard[kept], key[kept], among[kept]
    numbers, out = [], []
    for s, part in _parts(shard):
        of, k = among[part], key[part]
        numbers.append(s)
        out.append(pickle.dumps([k[w].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for w in (of > 1, of == 1, of > hot_shards)], protocol=5))
    return _rows("shard", numbers, out)


def _shared(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which runs have a key that runs of other rows have too; rows ascend."""
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    head = np.flatnonzero(first)
    n = np.diff(np.concatenate((head, [len(key)])))
    several = np.empty(len(key), bool)
    several[order] = np.repeat(row[order[head + n - 1]] != row[order[head]], n)
    return several


def _within(texts: pa.Table, flagged: pa.Table, buckets: int) -> pa.Table:
    """A shard's own removals, and the pieces that other shards may have."""
    none = _rows("bucket", [], [], {"kind": pa.array([], pa.int32())})
    if not flagged.num_rows or not texts.num_rows:
        return none
    shard = texts.column("shard")[0].as_py()
    t = Texts(texts)
    first, last, key, row = t.runs()
    sent = [pickle.loads(b.as_py()) for b in flagged.column("blob")]
    across, alone, hot = (np.unique(np.concatenate([_keys(s[i]) for s in sent])) for i in (0, 1, 2))
    is_across = np.isin(key, across)
    kept = np.flatnonzero(is_across | np.isin(key, alone))
    if not len(kept):
        return none
    first, last, key, row, is_across = first[kept], last[kept], key[kept], row[kept], is_across[kept]
    n = last - first + 1
    run = np.repeat(np.arange(len(first)), n)
    start = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    edge = np.zeros(len(t.text) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + LENGTH, -1)
    covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    place = np.zeros(len(t.text), np.int64)
    place[covered] = np.arange(len(covered))
    ids = t.ids[row[run]]
    held = t.text[covered]
    route = None
    if len(hot) and (many := np.flatnonzero(np.isin(key, hot)[run])).size:
        # a key with too many pieces for one bucket is cut further, by a second key
        route = key[run]
        route[many] = _mix(route[many] ^ window_keys(held, second=True)[place[start[many]]])
    # equal strings have equal keys: only what several documents of the shard have under one key is compared here
    gone = np.zeros(len(start), bool)
    shared = _shared(key, row)
    if shared.any():
        met = np.flatnonzero(shared[run])
        edge = np.zeros(len(held) + 1, np.int32)
        np.add.at(edge, place[first[shared]], 1)
        np.add.at(edge, place[last[shared]] + LENGTH, -1)
        inner = np.cumsum(edge[:-1]) > 0
        at = (np.cumsum(inner) - 1)[place[start[met]]]
        made = Shard(held[inner], at, ids[met])
        gone[met] = ids[met] > made.low[made.group]
    numbers, out, kinds = [], [], []

    def spans(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, among the chosen starts, of stretches within one run."""
        at = np.flatnonzero(which)
        new = np.ones(len(at), bool)
        new[1:] = (run[at[1:]] != run[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)
        if route is not None:
            new[1:] |= route[at[1:]] != route[at[:-1]]
        head = np.flatnonzero(new)
        return at[head], at[np.concatenate((head[1:], [len(at)])) - 1] if len(at) else at

    a, z = spans(gone)
    if len(a):
        r = row[run[a]]
        numbers.append(shard % buckets)
        kinds.append(shard)
        out.append(_pack(r, start[a] - t.starts[r], start[z] + LENGTH - t.starts[r]))
    a, z = spans(~gone & is_across[run])
    way = key[run[a]] if route is None else route[a]  # of each piece
    for b, part in _parts((way % np.uint64(buckets)).astype(np.int64)):
        pa_, pz = a[part], z[part]
        r = row[run[pa_]]
        size = start[pz] - start[pa_] + LENGTH
        take = np.repeat(start[pa_] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        numbers.append(b)
        kinds.append(-1 - shard)
        rows, local = np.unique(r, return_inverse=True)
        # 32 more bits of the key: keys that agree in them share suffix arrays, no more
        low = (way[part] // np.uint64(buckets)).astype(np.uint32)
        out.append(_pack(low, t.ids[rows], rows.astype(np.int32), np.diff(local, prepend=0).astype(np.uint16 if len(rows) < 1 << 16 else np.uint32), (start[pa_] - t.starts[r]).astype(np.int32), size.astype(np.int32), t.text[take]))
    return _rows("bucket", numbers, out, {"kind": pa.array(kinds, pa.int32())})


def _slice_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(text)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _A, np.uint64))), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * power[:n], dtype=np.uint64)))
    inverse = np.uint64(pow(int(_A), -1, 1 << 64))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))), dtype=np.uint64)
    return _mix((total[start + size] - total[start]) * back[start])


def _unlike(text: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Places of the pieces that aren't, byte for byte, what begins at other."""
    look = np.flatnonzero(start != other)
    bad = []
    for part in np.split(look, np.flatnonzero(np.diff(np.cumsum(size[look]) // block)) + 1):
        if len(part):
            n = size[part]
            first = np.cumsum(n) - n
            step = np.arange(n.sum())
            differs = text[np.repeat(start[part] - first, n) + step] != text[np.repeat(other[part] - first, n) + step]
            bad.append(part[np.logical_or.reduceat(differs, first)])
    return np.concatenate(bad) if bad else look


def _across(table: pa.Table, array_bytes: int) -> pa.Table:
    """The pieces of a bucket -> what goes, by shard; a shard's own removals pass through."""
    numbers, out, parts, shards = [], [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
        if kind >= 0:
            numbers.append(kind)
            out.append(blob.as_py())
        else:
            key, held_ids, held_rows, steps, at, size, text = _unpack(blob)
            local = np.cumsum(steps.astype(np.int64))
            parts.append((key, held_ids[local], held_rows[local], at, size, text))
            shards.append(np.full(len(parts[-1][0]), -1 - kind, np.int32))
    if not parts:
        return _rows("shard", numbers, out)
    key, ids, row, at, size, text = (np.concatenate(c) for c in zip(*parts, strict=True))
    shard, size = np.concatenate(shards), size.astype(np.int64)
    start = np.cumsum(size) - size
    digest = _slice_hashes(text, start, size)
    order = np.lexsort((ids, size, digest, key))
    k, d, s = key[order], digest[order], size[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])))
    head = order[new]  # of each distinct piece its smallest id
    variant = np.empty(len(key), np.int64)
    variant[order] = np.cumsum(new) - 1
    per_key = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    varied = np.repeat(per_key > 1, per_key)  # of each distinct piece
    if len(bad := _unlike(text, start, size, start[head[variant]])):  # equal hashes of unequal pieces: each for itself, all of their key by suffix array
        number = np.repeat(np.arange(len(per_key)), per_key)  # of each distinct piece its key
        clash = number[variant[bad]]
        varied |= np.isin(number, clash)
        variant[bad] = len(head) + np.arange(len(bad))
        head, varied = np.concatenate((head, bad)), np.concatenate((varied, np.ones(len(bad), bool)))
    low = ids[head]
    a = [np.flatnonzero(~varied[variant] & (ids > low[variant]))]
    spans = [(a[0], at[a[0]].astype(np.int64), at[a[0]].astype(np.int64) + size[a[0]])]
    chosen = np.flatnonzero(varied)
    if len(chosen):
        sizes = size[head[chosen]]
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // array_bytes, prepend=0)) if sizes.sum() > array_bytes else np.zeros(0, np.int64)
        made, windows = [], []
        for part in np.split(chosen, cut):
            if not len(part):
                continue
            n = size[head[part]]
            take = np.repeat(start[head[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            count = n - LENGTH + 1
            base = np.cumsum(n) - n
            starts = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
            made.append(Shard(text[take], starts, np.repeat(low[part], count)))
            windows.append((part, count))
        merge(made)
        least = np.concatenate([m.low[m.group] for m in made])  # of each string of each distinct piece
        counts = np.concatenate([c for _, c in windows])
        offset = np.zeros(len(head), np.int64)
        offset[np.concatenate([p for p, _ in windows])] = np.cumsum(counts) - counts
        mine = np.flatnonzero(varied[variant])
        n = size[mine] - LENGTH + 1
        owner = np.repeat(mine, n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        gone = np.flatnonzero(ids[owner] > least[offset[variant[owner]] + inside])
        if len(gone):
            new = np.concatenate(([True], (owner[gone[1:]] != owner[gone[:-1]]) | (inside[gone[1:]] != inside[gone[:-1]] + 1)))
            h = np.flatnonzero(new)
            f, z = gone[h], gone[np.concatenate((h[1:], [len(gone)])) - 1]
            spans.append((owner[f], at[owner[f]] + inside[f], at[owner[z]] + inside[z] + LENGTH))
    who, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True))
    for s, part in _parts(shard[who]):
        numbers.append(s)
        out.append(_pack(row[who[part]].astype(np.int64), begin[part], end[part]))
    return _rows("shard", numbers, out)


def _removed(texts: pa.Table, spans: pa.Table) -> pa.Table:
    t = Texts(texts)
    edge = np.zeros(len(t.text) + 1, np.int32)
    for blob in spans.column("blob"):
        row, begin, end = _unpack(blob)
        np.add.at(edge, t.starts[row] + begin, 1)
        np.add.at(edge, t.starts[row] + end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed, n_spans, kept = [], [], []
    for a, z in zip(t.starts.tolist(), t.ends.tolist(), strict=True):
        g = gone[a:z]
        removed.append(int(g.sum()))
        n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0)
        kept.append(t.text[a:z][~g].tobytes())
    return pa.table({"id": pa.array(t.original, pa.int64()), "n_bytes": pa.array((t.ends - t.starts).tolist(), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, array_bytes: int = ARRAY_BYTES, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row."""
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    shards = max(1, -(-total // shard_bytes))
    key_buckets = max(4 * n, -(-total // KEY_BUCKET_BYTES))
    buckets = max(4 * n, shards // 4)  # small ones: a bucket is in one worker's memory at a time
    # rows alike in id and text go by the partition they come from
    number = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(shards)).cast("int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), number.alias("shard")).repartition(n, "shard")
    by_shard = texts.groupBy("shard")
    keys = by_shard.applyInArrow(lambda x: _send_keys(x, key_buckets), "bucket int, blob binary, shard int")
    flagged = keys.groupBy("bucket").applyInArrow(lambda x: _repeated(x, hot_shards), "shard int, blob binary")
    pieces = by_shard.cogroup(flagged.groupBy("shard")).applyInArrow(lambda x, y: _within(x, y, buckets), "bucket int, blob binary, kind int")
    spans = pieces.groupBy("bucket").applyInArrow(lambda x: _across(x, array_bytes), "shard int, blob binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return by_shard.cogroup(spans.groupBy("shard")).applyInArrow(_removed, schema).withColumnRenamed("id", id_col)



def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string by itself, as hexadecimal digits; ids are taken to be unique.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS pos, h FROM d),
w AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS string FROM s),
g AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY string) < doc_id AS gone FROM w),
a AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS fresh FROM g WHERE gone),
r AS (SELECT doc_id, pos, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM a),
p AS (SELECT doc_id, min(pos) AS first, max(pos) + 50 AS last FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS since FROM p),
c AS (SELECT doc_id, CAST(sum(last - first) AS BIGINT) AS n_removed, count(*) AS n_spans, max(last) AS rest,
             string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' ORDER BY first) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
