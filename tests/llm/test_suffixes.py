"""Repeated passages at real block sizes, and anchors that are dealt by their strings."""

import hashlib
import re

import numpy as np
import pytest

from lodestruct.llm import suffixes

S = suffixes.SPAN


def gone_bytes(rows):
    """Of each (id, bytes): the bytes covered by a 50-byte string that starts in a row of smaller id; strings by a 64-bit hash of all their bytes."""
    marks, first = [], {}
    hashed = []
    for i, b in rows:
        x = np.frombuffer(b, np.uint8).astype(np.uint64)
        h = np.zeros(max(0, len(x) - S + 1), np.uint64)
        for k in range(S):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)] + np.uint64(1)
        hashed.append(h)
    every, owner = np.concatenate(hashed), np.concatenate([np.full(len(h), i) for (i, _), h in zip(rows, hashed)])
    order = np.lexsort((owner, every))
    start = np.r_[True, every[order][1:] != every[order][:-1]]
    least = np.empty(len(every), np.int64)
    least[order] = owner[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    at = 0
    for (i, b), h in zip(rows, hashed):
        depth = np.zeros(len(b) + 1, np.int64)
        bad = np.flatnonzero(least[at : at + len(h)] < i)
        np.add.at(depth, bad, 1)
        np.add.at(depth, bad + S, -1)
        marks.append(np.cumsum(depth[:-1]) > 0)
        at += len(h)
    return marks


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, b.decode()) for i, b in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.drop_repeats(docs, **how).collect())
    want = []
    for (i, b), off in zip(rows, gone_bytes(rows)):
        edge = np.diff(np.r_[0, off.astype(np.int8)])
        want.append((i, len(b), int(off.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~off].tobytes()).hexdigest()))
    assert got == sorted(want)
    return got


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 20_000, n))


def test_more_than_a_chunk_block_run_and_group(spark):
    """Two texts of over a chunk that share nearly everything: several blocks, runs and comparisons in a range, two chunks."""
    rng = np.random.default_rng(3)
    base = words(rng, 800_000).encode()
    assert len(base) > suffixes.CHUNK
    other = bytearray(base)
    for at in range(5_000, len(other), 50_000):
        other[at : at + 9] = b"unlike me"
    rows = [(7, base), (9, bytes(other)), (1, base[100_000:100_400]), (12, words(rng, 300).encode())]
    got = check(spark, rows)
    assert got[0][2] == 0 and got[1][2] > 0.99 * 300 and got[2][2] > 0.9 * len(base)


@pytest.mark.parametrize("part, hot, fan", [(1 << 25, 1 << 16, 256), (2_000, 1 << 16, 256), (1 << 25, 3, 256), (500, 10, 4), (500, 1 << 16, 3)])
def test_ranges_and_hot_anchors(spark, part, hot, fan):
    """A passage in every third text, exact copies, repeats inside a text; few or many ranges, dealt at once or step by step; anchors of more than a few occurrences dealt by their strings."""
    rng = np.random.default_rng(11)
    passage, rows = words(rng, 60), []
    for k in range(90):
        t = words(rng, 40)
        if k % 3 == 0:
            t = f"{t} {passage} {words(rng, int(rng.integers(0, 30)))}"
        if k % 10 == 1:
            t = "ab" * 200 + t
        if k % 15 == 2:
            t = rows[k // 2][1].decode()
        rows.append((int(1000 - k if k % 2 else k), t.encode()))
    rows += [(2000, b"short"), (2001, b"x" * 49), (2002, b"x" * 500), (2003, b"x" * 300), (2004, b"")]
    check(spark, rows, part=part, hot=hot, fan=fan)


def test_anchor_is_the_leftmost_of_least_hash():
    rng = np.random.default_rng(5)
    x = np.frombuffer(b"abababababababab" * 20 + bytes(rng.integers(97, 100, 400).tolist()), np.uint8)
    h, place = suffixes._windows(x)
    assert place.tolist() == [s + int(np.argmin(h[s : s + suffixes.GRAMS])) for s in range(len(x) - S + 1)]
    assert len({g: 0 for g in h.tolist()}) == len({bytes(x[i : i + suffixes.GRAM]) for i in range(len(x) - suffixes.GRAM + 1)})
    assert re.fullmatch(b"[a-c]+", x.tobytes())


@pytest.mark.parametrize("hot", [1 << 16, 1 << 22])
def test_long_periodic_texts(spark, monkeypatch, hot):
    """Texts that repeat a short period half a million times, and one that has a piece of them."""
    rng = np.random.default_rng(2)
    rows = [(1, b"a" * 600_000), (2, b"start " + b"a" * 500_000 + b" end"), (3, b"abcdefg" * 70_000), (4, b"xyz" + b"defgabc" * 60_000), (5, b"b" * 70 + b"a" * 70 + b"c" * 60), (6, words(rng, 50).encode()), (7, b"a" * 600_000)]
    got = check(spark, rows, hot=hot)
    assert [r[2] for r in got] == [0, 500_000, 0, 420_000, 70, 0, 600_000]


def test_runs_dealt_again_are_the_same_suffixes():
    rng = np.random.default_rng(4)
    data = np.frombuffer(words(rng, 3000).encode() * 2, np.uint8)
    ends = np.array([len(data) // 2, len(data)])
    a, lo, hi, h = next(suffixes.anchors(data, ends))
    grams = np.lib.stride_tricks.sliding_window_view(data, suffixes.GRAM)[a]
    assert (suffixes._gram_hash(grams) == h).all()


def strings_of(data, ends, hot):
    return [(int(s), int(d), digest[k]) for at, doc, of, digest in suffixes._digests(data, ends, hot) for s, d, k in zip(at, doc, of)]


@pytest.mark.parametrize("mix", [int(suffixes._MIX), 0])
def test_equal_strings_are_hashed_once(monkeypatch, mix):
    """A period costs its length in each block, and strings that meet under one mixed number are still told apart."""
    rng = np.random.default_rng(6)
    texts = [b"abc" * 60_000, words(rng, 2_000).encode(), b"a" * 60]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    every = np.unique(np.concatenate([h for _, _, _, h in suffixes.anchors(data, ends)]))
    if not mix:
        # only the mixing of whole strings goes wrong, not the anchors' hashes
        known = list(suffixes.anchors(data, ends))
        monkeypatch.setattr(suffixes, "anchors", lambda *_: iter(known))
        monkeypatch.setattr(suffixes, "_MIX", np.uint64(0))
    got = strings_of(data, ends, every)
    raw, starts = data.tobytes(), np.r_[0, ends[:-1]]
    want = [(s, d) for d, (a, e) in enumerate(zip(starts.tolist(), ends.tolist())) for s in range(a, e - S + 1)]
    assert [g[:2] for g in got] == want
    assert all(h == suffixes.xxhash.xxh3_128_digest(raw[s : s + S]) for s, _, h in got)
    hashed = [len(digest) for _, _, _, digest in suffixes._digests(data[: ends[0]], ends[:1], every)] if mix else []
    assert all(n == 3 for n in hashed)


def test_no_hot_anchor_gives_no_string():
    data, ends = np.frombuffer(b"a" * 400, np.uint8), np.array([200, 400])
    assert strings_of(data, ends, np.array([1], np.uint64)) == []
