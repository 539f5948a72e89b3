"""Removal of repeated passages by a distributed merge sort of front-coded suffix runs.

A string of ``SPAN`` bytes holds ``SPAN - GRAM + 1`` grams of ``GRAM`` bytes; the one of least hash is its anchor, the
same in every copy of the string. Only suffixes that begin at anchors are sorted, and only those whose anchor is found
in two documents: each carries the bytes before it that its strings need.

1. Exact copies of a text: the smallest doc_id stands for all; the others' bytes are known to go.
2. Texts are gathered into compressed chunks. Each chunk tells the hashes of its anchors; those found twice come back.
3. Each task sorts the suffixes at such anchors and sends front-coded runs, dealt by the anchor's hash. A range holds what
   so many bytes of text give, so there are more ranges the more text there is; runs are dealt to at most ``FAN`` ranges at
   a time, and where there are more, each of these is dealt again, so a run keeps ``RUN / FAN`` suffixes at any size.
4. A loser tree merges the runs of a range. Suffixes that share the anchor's gram follow one another; in each such group
   every string of every suffix is compared, and those with a smaller doc_id elsewhere give intervals to remove.
5. An anchor that occurs more than ``HOT`` times would be one group without a bound: its different strings are hashed to
   128 bits instead, an aggregate finds each one's smallest doc_id, and the chunks that have it under a greater one hear.
6. Intervals go back to the chunks, whose texts are cut.

Nothing is held for a whole text but the text itself: anchors are counted, suffixes sent and intervals joined block by
block, so a very long text, or one that repeats a short period millions of times, needs no more memory than its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import as_bytes, materialise, table

SPAN, GRAM = 50, 16
GRAMS = SPAN - GRAM + 1
LEFT = GRAMS - 1
#: Bytes of a sort key: the suffix, the bytes before it, the least and greatest number of bytes its strings begin before it.
KEY = SPAN + LEFT + 2
#: Bytes of text in a chunk, window starts handled at once, suffixes in a run, suffixes compared at once.
CHUNK, BLOCK, RUN, GROUPS = 1 << 22, 1 << 16, 1 << 18, 1 << 15
#: Bytes of text whose suffixes make a range on average; occurrences from which on an anchor is dealt by its strings; ranges dealt to at a time.
PART, HOT, FAN = 1 << 23, 1 << 18, 256
#: Bits of a place in a block and of a document in a chunk; what is left of 64 is the hash.
PLACE = 17
#: How hard texts are compressed while they travel.
LEVEL = 5
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h >> np.uint64(PLACE)  # 47 bits are enough to tell grams apart; the place below them makes the leftmost one least


def _gram_hash(grams: np.ndarray) -> np.ndarray:
    """The hash of ``_windows`` for grams in rows."""
    h = grams.astype(np.uint64) + np.uint64(1)
    for n in (1, 2, 4, 8):
        h = h[:, ::2] * np.uint64(pow(_BASE, n, 1 << 64)) + h[:, 1::2]
    return _mixed(h[:, 0].copy())


def _windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram of ``x`` and the place of the anchor of each string (leftmost of equals)."""
    h = x.astype(np.uint64) + np.uint64(1)
    for n in (1, 2, 4, 8):
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
    h = _mixed(h)
    least = h << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
    for n in (1, 2, 4, 8, 16, GRAMS - 32):
        least = np.minimum(least[n:], least[:-n])
    return h, (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def anchors(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of anchors of texts laid end to end: place, first and last start of the strings it anchors, hash."""
    for at in range(0, len(data) - SPAN + 1, BLOCK):
        h, place = _windows(data[at : at + BLOCK + SPAN - 1])
        inside = np.ones(len(place), bool)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(place) + SPAN)].tolist():
            inside[max(0, e - SPAN + 1 - at) : max(0, e - at)] = False
        s = np.flatnonzero(inside)
        if len(s):
            a = place[s]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            last = np.r_[first[1:], len(s)] - 1
            a = a[first]
            yield a + at, s[first] + at, s[last] + at, h[a]


# ---- chunks of texts

_CHUNK = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary()), ("ends", pa.binary()), ("texts", pa.binary())])
_CHUNK_SQL = "chunk long, size long, ids binary, keys binary, ends binary, texts binary"
_TEXT = ("chunk", "ids", "keys", "ends", "texts")


def _squeeze(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in it:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack.compress(t) for t in batch.column(3).to_pylist()], pa.binary())], names=["doc_id", "t1", "t2", "z"])


def _gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def made() -> pa.RecordBatch:
        ids, t1, t2, texts = zip(*held)
        keys = np.array([t1, t2], np.int64).T
        return pa.RecordBatch.from_pylist([{"chunk": number, "size": size, "ids": np.array(ids, np.int64).tobytes(), "keys": keys.tobytes(), "ends": np.cumsum([len(t) for t in texts]).astype(np.int64).tobytes(), "texts": pack.compress(b"".join(texts))}], schema=_CHUNK)

    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((*row[:3], text := unpack.decompress(row[3])))
            size += len(text)
            if size >= CHUNK:
                yield made()
                number, held, size = number + 1, [], 0
    if held:
        yield made()


def _open(batch: pa.RecordBatch, i: int) -> tuple:
    """Chunk number, ids, text keys, ends and bytes of row ``i``."""
    number, ids, keys, ends, texts = (batch.column(c)[i].as_py() for c in range(5))
    data = zstandard.ZstdDecompressor().decompress(texts)
    return number, np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8)


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, chunk, docs, times): the anchors' hashes of each chunk once, how many of its documents have each, and how often it occurs."""
    for batch in it:
        for i in range(batch.num_rows):
            number, _, _, ends, data = _open(batch, i)
            pairs, times, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

            def count() -> tuple[np.ndarray, np.ndarray]:
                every, at = np.unique(np.concatenate([pairs, *fresh]), return_inverse=True)
                return every, np.bincount(at, np.r_[times, np.ones(size, np.int64)], len(every)).astype(np.int64)

            for a, _, _, h in anchors(data, ends):
                fresh.append(h << np.uint64(PLACE) | np.searchsorted(ends, a, "right").astype(np.uint64))
                size += len(a)
                if size >= max(RUN, len(pairs)):  # so each is counted a few times only, however long the text
                    pairs, times = count()
                    fresh, size = [], 0
            pairs, times = count()
            if len(pairs):
                h = (pairs >> np.uint64(PLACE)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                cols = [h[first], np.full(len(first), number), np.diff(np.r_[first, len(h)]), np.minimum(np.add.reduceat(times, first), 1 << 30)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "chunk", "docs", "times"])


# ---- sorted runs


def front_code(rows: np.ndarray, docs: np.ndarray, chunks: np.ndarray, ords: np.ndarray, places: np.ndarray) -> bytes:
    """A run: keys sorted, equal ones once; of each the length it shares with the key before and the rest; then who has it."""
    order = np.lexsort((docs, np.ascontiguousarray(rows).view(f"V{KEY}").ravel().view(f"S{KEY}")))
    rows, docs, chunks, ords, places = rows[order], docs[order], chunks[order], ords[order], places[order]
    differ = np.ones((len(rows), KEY), bool)
    differ[1:] = rows[1:] != rows[:-1]
    fresh = np.flatnonzero(differ.any(axis=1))
    differ[0, 0] = True
    shared = differ[fresh].argmax(axis=1).astype(np.uint8)
    shared[0] = 0
    rest = rows[fresh][np.arange(KEY) >= shared[:, None]]
    count = np.diff(np.r_[fresh, len(rows)]).astype(np.int32)
    # documents are listed once: id, chunk, place in the chunk (ids may repeat)
    _, chunk = np.unique(chunks, return_inverse=True)
    _, first, doc = np.unique(chunk * (1 << 32) + ords, return_index=True, return_inverse=True)
    head = np.array([len(fresh), len(rest), len(rows), len(first)], np.int64)
    parts = (head, docs[first], chunks[first], ords[first], count, doc.astype(np.int32), places.astype(np.int32), shared, rest)
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in parts))


class Run:
    """A front-coded run, read from its first key to its last."""

    def __init__(self, packed: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n, rest, total, known = np.frombuffer(raw, np.int64, 4).tolist()
        at = 32
        self.ids, self.of, self.ords = (np.frombuffer(raw, np.int64, known, at + 8 * k * known) for k in range(3))
        at += 24 * known
        self.count = np.frombuffer(raw, np.int32, n, at)
        self.doc, self.places = np.frombuffer(raw, np.int32, total, at + 4 * n), np.frombuffer(raw, np.int32, total, at + 4 * (n + total))
        at += 4 * (n + 2 * total)
        self.shared, self.rest = raw[at : at + n], raw[at + n : at + n + rest]
        self.single = (self.count == 1).tolist()
        self.n, self.i, self.at, self.key = int(n), -1, 0, b""

    def next(self) -> int:
        """Goes to the next key; the length it shares with the one before, or -1 at the end."""
        self.i += 1
        if self.i == self.n:
            return -1
        shared = self.shared[self.i]
        end = self.at + KEY - shared
        self.key = self.key[:shared] + self.rest[self.at : end]
        self.at = end
        return shared


class Owners:
    """Who has the keys of some runs: of key ``i`` of run ``r``, the documents and the places."""

    def __init__(self, runs: list[Run]) -> None:
        self.first = [np.r_[0, np.cumsum(r.count)] for r in runs]
        self.base = np.r_[0, np.cumsum([len(r.doc) for r in runs])]
        shift = np.r_[0, np.cumsum([len(r.ids) for r in runs])]
        self.doc = np.concatenate([r.doc + s for r, s in zip(runs, shift)])
        self.places = np.concatenate([r.places for r in runs])
        self.ids, self.of, self.ords = (np.concatenate([getattr(r, c) for r in runs]) for c in ("ids", "of", "ords"))

    def of_keys(self, runs: list[int], keys: list[int]) -> tuple[np.ndarray, ...]:
        """For each owner of the keys: number of the key in the list, row of the document, place."""
        r, i = np.array(runs), np.array(keys)
        begin, count = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
        for k in np.unique(r):
            own = r == k
            begin[own] = self.first[k][i[own]] + self.base[k]
            count[own] = self.first[k][i[own] + 1] - self.first[k][i[own]]
        entry = np.repeat(np.arange(len(r)), count)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + begin[entry]
        return entry, self.doc[at], self.places[at]


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """All keys in order: (length shared with the key before, number of the run, index in it, key).

    A loser tree whose nodes keep, with the run that lost there, the length it shares with the winner. Of two keys the
    one that shares more with the last winner is smaller, without a look at either; only equal lengths are compared,
    from that length on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    shares = [r.next() for r in runs] + [-1] * (k - len(runs))
    lost = [0] * k  # of each inner node; 0 holds the winner

    def beats(a: int, b: int) -> bool:
        x, y = shares[a], shares[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        p, q = runs[a].key, runs[b].key
        gap = int.from_bytes(p[x:], "big") ^ int.from_bytes(q[x:], "big")
        if not gap:
            shares[b] = KEY
            return True
        same = KEY - (gap.bit_length() + 7) // 8
        if p[same] < q[same]:
            shares[b] = same
            return True
        shares[a] = same
        return False

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        lost[node] = lose
        return win

    win = build(1) if k > 1 else 0
    while shares[win] >= 0:
        run = runs[win]
        yield shares[win], win, run.i, run.key
        shares[win] = run.next()
        node = (win + k) // 2
        while node:
            if not beats(win, lost[node]):
                win, lost[node] = lost[node], win
            node //= 2


def _numbers(lists: pa.Array, i: int) -> np.ndarray:
    """Entry ``i`` of an array of lists of integers."""
    return np.asarray(lists[i].values) if lists[i].is_valid else np.zeros(0, np.int64)


def _deal(held: list[tuple], parts: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Runs of the suffixes that are held, one for each ``wide`` ranges that have some."""
    rows, h, docs, chunks, ords, places = (np.concatenate(c) for c in zip(*held))
    part = (h % np.uint64(parts)).astype(np.int64) // wide
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield pa.RecordBatch.from_arrays([pa.array(part[own[:1]]), pa.array([front_code(rows[own], docs[own], chunks[own], ords[own], places[own])], pa.binary())], names=["part", "run"])


def _runs(parts: int, wide: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in it:
            for i in range(batch.num_rows):
                number, ids, _, ends, data = _open(batch, i)
                wanted = np.sort(_numbers(batch.column(5), i).view(np.uint64))
                if not len(wanted):
                    continue
                padded = np.r_[np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)]
                for a, lo, hi, h in anchors(data, ends):
                    known = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    a, lo, hi, h = a[known], lo[known], hi[known], h[known]
                    doc = np.searchsorted(ends, a, "right")
                    rows = np.empty((len(a), KEY), np.uint8)
                    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + SPAN)[a]
                    rows[:, :SPAN], rows[:, SPAN : SPAN + LEFT] = around[:, LEFT:], around[:, :LEFT]
                    # bytes that no string of this anchor has say nothing
                    reach = np.arange(SPAN)[None] >= (SPAN - (a - hi))[:, None]
                    rows[:, :SPAN][reach] = 0
                    rows[:, SPAN : SPAN + LEFT][np.arange(LEFT)[None] < (LEFT - (a - lo))[:, None]] = 0
                    rows[:, -2], rows[:, -1] = a - hi, a - lo
                    held.append((rows, h, ids[doc], np.full(len(a), number), doc, a - np.r_[0, ends][doc]))
                    size += len(a)
                    if size >= RUN:
                        yield from _deal(held, parts, wide)
                        held, size = [], 0
        if size:
            yield from _deal(held, parts, wide)

    return run


def _again(parts: int, wide: int):
    """Runs taken apart and dealt anew, to narrower ranges."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in it:
            for packed in batch.column(1).to_pylist():
                r = Run(packed)
                keys = [r.key for _ in iter(r.next, -1)]
                rows = np.repeat(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY), r.count, axis=0)
                held.append((rows, _gram_hash(rows[:, :GRAM]), r.ids[r.doc], r.of[r.doc], r.ords[r.doc], r.places.astype(np.int64)))
                size += len(rows)
                if size >= RUN:
                    yield from _deal(held, parts, wide)
                    held, size = [], 0
        if size:
            yield from _deal(held, parts, wide)

    return run


def _digests(data: np.ndarray, ends: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Start, document and number of the strings at the anchors in ``hot``, a block at a time and in order, and the 128-bit hash of each number.

    A block's equal strings have one number and are hashed once, so a period costs no more than its length.
    """
    for _, lo, hi, h in anchors(data, ends):
        known = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        lo, n = lo[known], (hi - lo)[known] + 1
        if not len(lo):
            continue
        s = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # at most BLOCK, as each string has one anchor
        rows = np.zeros((len(s), -(-SPAN // 8) * 8), np.uint8)
        rows[:, :SPAN] = np.lib.stride_tricks.sliding_window_view(data, SPAN)[s]
        whole = rows.view(np.uint64)
        mixed = np.zeros(len(s), np.uint64)
        for k in range(whole.shape[1]):
            mixed = (mixed ^ whole[:, k]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        _, first, number = np.unique(mixed, return_index=True, return_inverse=True)
        if (whole != whole[first[number]]).any():  # different strings met by chance: compare the strings themselves
            _, first, number = np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        raw = rows[first, :SPAN].tobytes()
        yield s, np.searchsorted(ends, s, "right"), number, [xxhash.xxh3_128_digest(raw[x : x + SPAN]) for x in range(0, len(raw), SPAN)]


def _strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, doc_id, chunk): hashes of the strings at the anchors that are dealt by their strings; one that has been sent lately under the same id is not sent again."""
    for batch in it:
        for i in range(batch.num_rows):
            number, ids, _, ends, data = _open(batch, i)
            sent: set[tuple] = set()
            for _, doc, of, digest in _digests(data, ends, np.sort(_numbers(batch.column(5), i).view(np.uint64))):
                which, who = np.divmod(np.unique(of * len(ids) + doc), len(ids))
                new = [x for x in dict.fromkeys(zip([digest[k] for k in which.tolist()], ids[who].tolist())) if x not in sent]
                sent.update(new)
                if len(sent) > RUN:
                    sent.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.binary()), pa.array([k for _, k in new], pa.int64()), pa.array(np.full(len(new), number))], names=["s", "doc_id", "chunk"])


def _marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, ord, lo, hi) of the strings whose hash a document of smaller id has (the last column: hash and that id), those that follow one another joined."""
    for batch in it:
        for i in range(batch.num_rows):
            number, ids, _, ends, data = _open(batch, i)
            known = batch.column(6)[i].values
            least = dict(zip(known.field("s").to_pylist(), known.field("least").to_pylist()))
            starts, top = np.r_[0, ends], np.iinfo(np.int64).max
            for s, doc, of, digest in _digests(data, ends, np.sort(_numbers(batch.column(5), i).view(np.uint64))):
                gone = ids[doc] > np.array([least.get(d, top) for d in digest], np.int64)[of]
                s, doc = s[gone], doc[gone]
                if len(s):
                    first = np.flatnonzero(np.r_[True, (np.diff(s) > 1) | (np.diff(doc) > 0)])
                    last = np.r_[first[1:], len(s)] - 1
                    cols = (np.full(len(first), number), doc[first], s[first] - starts[doc[first]], s[last] - starts[doc[first]] + SPAN)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["chunk", "ord", "lo", "hi"])


def _intervals(key: tuple, runs: pa.Table) -> pa.Table:
    """Merges the runs of a range and tells which bytes of which documents go."""
    out: list[tuple[np.ndarray, ...]] = []
    opened = [Run(r) for r in runs.column("run").to_pylist()]
    owners = Owners(opened)
    keys: list[bytes] = []
    of: list[int] = []
    at_: list[int] = []
    fresh = 0  # where the group that is being read begins
    owned = 0  # by how many documents the keys are had

    def compare(n: int) -> None:
        rows = np.frombuffer(b"".join(keys[:n]), np.uint8).reshape(-1, KEY)
        text = np.concatenate([rows[:, SPAN : SPAN + LEFT], rows[:, :SPAN]], axis=1)
        least, most = rows[:, -2], rows[:, -1]
        entry, doc, places = owners.of_keys(of[:n], at_[:n])
        docs = owners.ids[doc]
        smallest = docs[np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])]  # a key's owners are sorted
        gone = np.zeros((len(entry), GRAMS + 1), bool)
        for o in range(GRAMS):
            own = np.flatnonzero((least <= o) & (o <= most))
            if len(own):
                strings = np.ascontiguousarray(text[own, LEFT - o : LEFT - o + SPAN]).view(f"S{SPAN}").ravel()
                _, group = np.unique(strings, return_inverse=True)
                first = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, group, smallest[own])
                bar = np.full(n, np.iinfo(np.int64).max)
                bar[own] = first[group]
                gone[:, o] = docs > bar[entry]
        edge = np.diff(np.pad(gone, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        at, begin = np.nonzero(edge == 1)
        at2, stop = np.nonzero(edge == -1)
        assert (at == at2).all()
        out.append((owners.of[doc[at]], owners.ords[doc[at]], places[at] - (stop - 1), places[at] - begin + SPAN))

    for shared, run, i, k in merge(opened):
        if shared < GRAM:
            if len(keys) - fresh == 1 and opened[of[fresh]].single[at_[fresh]]:
                keys.pop(), of.pop(), at_.pop()  # nobody else has this anchor
            fresh = len(keys)
            if owned >= GROUPS:
                compare(fresh)
                keys, of, at_, fresh, owned = [], [], [], 0, 0
        owned += 1 if opened[run].single[i] else int(opened[run].count[i])
        keys.append(k)
        of.append(run)
        at_.append(i)
        # a group has at most HOT owners
    if keys:
        compare(len(keys))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["chunk", "ord", "lo", "hi"])


_KEPT = [("r_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Of each chunk, the counts of its texts and what is left of them."""
    for batch in it:
        for i in range(batch.num_rows):
            _, ids, keys, ends, data = _open(batch, i)
            lo = hi = np.zeros(0, np.int64)
            starts = np.r_[0, ends[:-1]]
            if batch.column(5)[i].is_valid:
                spans = batch.column(5)[i].values
                order, lo, hi = (np.asarray(spans.field(c)) for c in ("ord", "lo", "hi"))
                lo, hi = lo + starts[order], hi + starts[order]
                by = np.argsort(lo, kind="stable")
                lo, hi = lo[by], np.maximum.accumulate(hi[by])  # strings do not cross texts, so runs do not either
                # intervals that touch are one run, but not where one text ends and the next begins
                fresh = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (lo[1:] > lo[:-1]) & np.isin(lo[1:], starts)]) if len(lo) else np.zeros(0, np.int64)
                lo, hi = lo[fresh], hi[np.r_[fresh[1:], len(hi)] - 1] if len(fresh) else hi
            own = np.searchsorted(ends, lo, "right")
            removed, spans = (np.bincount(own, w, len(ends)).astype(np.int64) for w in (hi - lo, np.ones(len(lo))))
            edges, at = np.searchsorted(lo, np.r_[starts, ends[-1:]]), data
            kept = [b"".join([at[x:y].tobytes() for x, y in zip([a, *hi[p:q].tolist()], [*lo[p:q].tolist(), e])]) for a, e, p, q in zip(starts.tolist(), ends.tolist(), edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, keys[:, 0], keys[:, 1], removed, spans)], names=[n for n, _ in _KEPT]), kept


def _digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for counts, kept in _cut(it):
        yield counts.append_column("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))


def repeated_spans(docs: DataFrame, part: int = PART, hot: int = HOT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Chunks of the different texts that are long enough, and (chunk, ord, lo, hi): the bytes of the ord-th text of a chunk that repeat a document of smaller id.

    ``part``: bytes of text whose suffixes make a range; ``hot``: occurrences from which on an anchor is dealt by its
    strings; ``fan``: ranges that runs are dealt to at a time.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("body")).filter(F.col("doc_id").isNotNull() & (F.octet_length("body") >= SPAN))
    body = body.select("doc_id", F.xxhash64("body").alias("t1"), F.xxhash64(F.lit("text"), "body").alias("t2"), "body")
    chosen = body.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    texts = body.mapInArrow(_squeeze, "doc_id long, t1 long, t2 long, z binary").join(chosen, ["doc_id", "t1", "t2"], "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    made = materialise(texts.select("doc_id", "t1", "t2", "z").mapInArrow(_gather, _CHUNK_SQL), "chunks")
    parts = max(1, -(-(made.agg(F.sum("size")).first()[0] or 0) // part))
    # the filter is what the inner join below adds by itself: with it, all joins with texts share one exchange
    chunks = made.select(*_TEXT).filter("chunk is not null")

    # a hash has one row a chunk at most, so one for every CHUNK bytes of text; to count first and join then took twice the disk
    w = W.partitionBy("h")
    hashes = chunks.mapInArrow(_hashes, "h long, chunk long, docs int, times int").withColumns({"n": F.sum("docs").over(w), "times": F.sum("times").over(w)}).filter("n > 1")
    lists = hashes.groupBy("chunk").agg(F.collect_list(F.when(F.col("times") <= hot, F.col("h"))).alias("wanted"), F.collect_list(F.when(F.col("times") > hot, F.col("h"))).alias("hot"))
    lists = materialise(lists, "shared_anchors")  # at most the anchors of a chunk
    wide = 1
    while wide * fan < parts:
        wide *= fan
    runs = chunks.join(lists.select("chunk", "wanted"), "chunk").select(*_TEXT, "wanted").mapInArrow(_runs(parts, wide), "part long, run binary")
    while wide > 1:
        wide //= fan
        runs = runs.repartition("part").mapInArrow(_again(parts, wide), "part long, run binary")
    found = runs.groupBy("part").applyInArrow(_intervals, "chunk long, ord long, lo long, hi long")
    dealt = lists.select("chunk", "hot").filter("size(hot) > 0")
    if not dealt.isEmpty():
        strings = chunks.join(dealt, "chunk").select(*_TEXT, "hot").mapInArrow(_strings, "s binary, doc_id long, chunk long")  # hashed twice; the texts' exchange is that of the runs
        least = strings.groupBy("s").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("s", "least")
        told = strings.join(least, "s").filter("doc_id > least").select("chunk", "s", "least").distinct().groupBy("chunk").agg(F.collect_list(F.struct("s", "least")).alias("told"))  # at most the strings of a chunk
        marked = chunks.join(dealt, "chunk").join(told, "chunk").select(*_TEXT, "hot", "told").mapInArrow(_marked, "chunk long, ord long, lo long, hi long")
        found = found.unionByName(marked)
    return chunks, found


def drop_repeats(docs: DataFrame, part: int = PART, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """What is left of every text when each byte of a ``SPAN``-byte string that also starts in a document of smaller id is removed.

    Returns one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Strings are those of the input
    and never cross documents. Null texts count as empty; texts shorter than ``SPAN`` bytes stay. Very long and periodic texts
    take a few times their bytes in memory, and each block of one hashes its different strings only. A copy of a
    text under a greater id goes whole, and rows of the same id do not repeat each other. Rows without an id have no
    order: they stay whole and remove nothing. Ids must be integers or cast to such; others count as null. Other columns are neither read nor returned; an empty table gives an
    empty result.
    """
    chunks, found = repeated_spans(docs, part, hot, fan)
    spans = found.groupBy("chunk").agg(F.collect_list(F.struct("ord", "lo", "hi")).alias("gone"))  # at most the anchors of a chunk
    cut = chunks.join(spans, "chunk", "left").select(*_TEXT, "gone").mapInArrow(_digest, "r_id long, r1 long, r2 long, n_removed long, n_spans long, kept_sha256 string")
    body = docs.select("doc_id", as_bytes(F.col("text")).alias("body"))
    rows = body.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("t1"), F.xxhash64(F.lit("text"), "body").alias("t2"), F.sha2("body", 256).alias("whole"))
    j = rows.join(cut.filter("r1 is not null"), (rows.t1 == F.col("r1")) & (rows.t2 == F.col("r2")), "left")
    part = F.col("doc_id").isNotNull() & F.col("r_id").isNotNull()
    first, copy = part & (F.col("doc_id") == F.col("r_id")), part & (F.col("doc_id") != F.col("r_id"))

    def pick(own: str, all_: object, none: object, kind: str):
        return F.when(first, F.col(own)).when(copy, all_).otherwise(none).cast(kind)

    return j.select(
        "doc_id", "n_bytes",
        pick("n_removed", F.col("n_bytes"), F.lit(0), "long").alias("n_removed"),
        pick("n_spans", F.lit(1), F.lit(0), "long").alias("n_spans"),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("whole"), "string").alias("kept_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))
