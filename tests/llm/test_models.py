"""The trained scorers and the schedule against naive versions, and texts that cross their blocks."""

import zlib

import numpy as np
import pytest

from lodestruct.llm import mixing, quality, simhash, tokens, toxicity
from lodestruct.llm._train import labelled_sample

RNG = np.random.default_rng(17)
WORDS = [f"w{k}" for k in range(400)]


def some(n, *more):
    return " ".join([*RNG.choice(WORDS, n), *more])


@pytest.fixture(scope="module")
def sample():
    texts = [some(30, "vile") if k % 2 else some(30) for k in range(120)] + ["", "one", "two words"]
    return texts, np.array([float(k % 2) for k in range(120)] + [0.0, 0.0, 0.0])


def naive_toxic(model, text):
    p, words = model.params, toxicity.words_of(text)
    emb = [sum(p["E"][i].astype(float) for i in toxicity.features(w)) for w in words]
    total, k, f = float(p["c"][0]), 0, 0
    for width in toxicity.WIDTHS:
        for n in range(toxicity.FILTERS):
            found = [sum(float(emb[at + j] @ p["W"][:, k + j, n]) for j in range(width)) for at in range(len(words) - width + 1)]
            total += max(max(found, default=-np.inf) + float(p["b"][f]), 0.0) * float(p["v"][f])
            f += 1
        k += width
    return 1 / (1 + np.exp(-(total - model.cuts[toxicity.language(words)])))


def test_toxicity_is_the_convolution(sample):
    model = toxicity.fit(*sample)
    for t in [*sample[0][:8], "", "one", "two words", "der die das vile", some(200)]:
        assert model.score(t) == pytest.approx(naive_toxic(model, t), abs=1e-4)
    long = some(toxicity.BLOCK + 50)
    assert model.score(long) == pytest.approx(naive_toxic(model, long), abs=1e-3)
    assert model.score(" ".join(WORDS * 100) + " vile") >= model.score(" ".join(WORDS * 100))


def naive_quality(model, text):
    p, h = model.params, []
    for x in (row for block in quality.passages(text) for row in block):
        h.append(np.tanh(x.astype(float) @ p["W"] + p["b"]))
    gate = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
    a = np.exp(np.array(gate) - max(gate))
    z = sum(w * v for w, v in zip(a / a.sum(), h))
    x = float(z @ p["v"] + p["c"][0]) - model.cut + np.log(quality.ACCEPT / (1 - quality.ACCEPT))
    return 1 / (1 + np.exp(-x))


def naive_passage(words, lines):
    b = b" ".join(words) + b" "
    shares = np.sqrt([b.count(bytes([k])) / len(b) for k in range(256)])
    same = sum(x == y for x, y in zip(words, words[1:]))
    return np.r_[shares, same / len(words), len(set(words)) / len(words), len(b) / len(words) / 10, min(lines, 1.0), len(words) / quality.PASSAGE]


def test_quality_is_gated_attention_over_passages(sample):
    model = quality.fit([t.encode() for t in sample[0]], sample[1])
    for t in [*sample[0][:6], "", "one", some(500), "a a a b\n" * 40]:
        assert model.score(t.encode()) == pytest.approx(naive_quality(model, t.encode()), abs=1e-5)
    words = (b"x yy yy z " * 50).split()
    got = np.concatenate(list(quality.passages(b" ".join(words) + b"\n\n")))
    assert len(got) == -(-len(words) // quality.PASSAGE)
    first = naive_passage(words[: quality.PASSAGE], 2 / len(words))
    assert got[0] == pytest.approx(first, abs=1e-5)
    long = " ".join(WORDS * 330)  # more words than a block holds
    assert len(long.split()) > quality.PASSAGE * quality.BLOCK
    assert model.score(long.encode()) == pytest.approx(naive_quality(model, long.encode()), abs=1e-4)


def test_fingerprint_over_blocks():
    words = RNG.choice(WORDS, simhash.BLOCK + 500).tolist()
    import xxhash

    ones, n = np.zeros(64, int), len(words) - 2
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    assert simhash.fingerprint(" ".join(words).encode()) == sum(1 << b for b in range(64) if ones[b] * 2 > n)


def test_token_counts_over_real_chunks(spark):
    long = [" ".join(RNG.choice(["word", "two words", "é", "12345", "\n\n", "  ", "'ll", "日本語", "x" * 50], 40_000)), "z" * 200_000, "a b " * 60_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    from public_tokenizers import path

    tok = tokens.tokenizer(path("byte_bpe_50k.json"))
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(long)}


def test_schedule_in_plain_python(spark):
    sources = [(0, 5, 7), (1, 3, 0), (2, 10, 23), (3, 1, 2)]
    got = sorted((r["slot"], r["sid"], r["rank"], r["epoch"]) for r in mixing.schedule(spark.createDataFrame(sources, "sid long, blocks long, quota long")).collect())
    total, taken, want = sum(q for _, _, q in sources), {s: 0 for s, _, _ in sources}, []
    for t in range(total):
        u, lo = sum(((t >> b) & 1) / 2 ** (b + 1) for b in range(20)), 0
        for s, _, q in sources:
            if lo <= u * total < lo + q:
                want.append((t, s, taken[s], q))
                taken[s] += 1
            lo += q
    kept = [(t, s, k, k // dict((a, b) for a, b, _ in sources)[s]) for t, s, k, q in want if k < q]
    for s, blocks, q in sources:
        kept += [(total + k, s, k, k // blocks) for k in range(taken[s], q)]
    assert got == sorted(kept)
    assert {s: sum(1 for x in got if x[1] == s) for s, _, q in sources if q} == {s: q for s, _, q in sources if q}


def test_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (3, "c"), (3, None)] + [(1, f"t{k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    held = {i for i in (1, 3) if zlib.crc32(str(i).encode()) % 5 == 0}
    one, two = labelled_sample(docs, labels, "toxic"), labelled_sample(docs.orderBy("text"), labels.orderBy("toxic"), "toxic")
    assert len(one[0]) == 2 - len(held) and one[0] == two[0] and one[1].tolist() == two[1].tolist()
    if 1 not in held:
        assert 1.0 in one[1].tolist()
