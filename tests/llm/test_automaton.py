"""The token automaton against plain merging, against the tokenizers library, and on awkward tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lodestruct.llm import automaton

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
AWKWARD = [
    None, "", "   ", "\n\t", "it's 3 o'clock", "<|endoftext|>", "a<|endoftext|> b<|startoftext|><|endoftext|>c", "<|ENDOFTEXT|>", "é ́a", "日本語 text — ok",
    "a" * 5000, "ab" * 3000 + " " + "ba" * 3000, "ǄİſÅß ﬁ ½ ٣", "\x00\x01 \x7f", "x 　 y", "🙂👩‍👩‍👧", "word " * 40000, "日本 " * 30000,
]


def merged(word, merges):
    """The first k merges for every k, by replacing pairs from left to right, in order."""
    out = list(word)
    for a, b in merges:
        at, new = 0, []
        while at < len(out):
            if out[at : at + 2] == [a, b]:
                new.append(a + b)
                at += 2
            else:
                new.append(out[at])
                at += 1
        out = new
    return out


@pytest.mark.parametrize("seed", range(12))
def test_automaton_is_merging(seed):
    rnd = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 12:
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    ids = {t: k for k, t in enumerate(tokens)}
    made = automaton.Automaton(ids, merges)
    for _ in range(400):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))
        assert [tokens[t] for t in made.encode(word)] == merged(word, merges)
    # exactly the sequences of the merging have a path
    for _ in range(400):
        path = [rnd.choice(tokens) for _ in range(rnd.randint(1, 4))]
        state, fits = 0, True
        for t in path:
            fits = fits and made.arc(state, ids[t])
            state = made.after[ids[t]]
        assert fits == (merged("".join(path), merges) == path)


@pytest.mark.parametrize("name", FILES)
def test_like_the_library(spark, sf, name):
    path = public_tokenizers.path(name)
    rnd = random.Random(7)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + AWKWARD
    texts += ["".join(rnd.choice(" aeéthsn'日1\n") for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids long")
    got = {r["doc_id"]: r for r in automaton.decode(automaton.encode(docs, path), path).collect()}
    tok = automaton.tokenizer(path)
    for k, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == want
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_rows_stay(spark):
    docs = spark.createDataFrame([(None, "same"), (None, "same"), (1, "same"), (1, "same"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in automaton.encode(docs).collect()) == [(-1, 1), (-1, 1), (1, 0), (1, 1), (1, 1)]
    assert automaton.decode(automaton.encode(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 1, np.array([344, 1 << 31], "<u4").tobytes())], "doc_id long, n_tokens long, ids binary")
    assert [r["decoded"] for r in automaton.decode(odd).orderBy("doc_id").collect()] == ["", "y</w>"]


def test_query(spark, sf):
    tok = automaton.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = automaton.op13_bpe_automaton(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
