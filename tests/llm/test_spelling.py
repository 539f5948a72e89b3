"""Spelling variants against plain loops on small tables, and against their SQL."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestruct.llm import spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=2):
    out = []
    for word, n in words.items():
        near = sorted((-words[b], b) for b in words if b != word and is_near(word, b))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out.append([word, n, form, len(near), words[form] if form else None])
    forms = {o[0]: o[2] for o in out}
    rows = []
    for word, n, form, n_near, form_n in out:
        root = word
        while forms[root]:
            root = forms[root]
        rows.append((word, n, form, root, n_near, form_n))
    return sorted(rows)


def variants(seed):
    rnd = random.Random(seed)
    words = {}
    for _ in range(12):
        base = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 11)))
        for _ in range(20):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randint(0, len(w))
                w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "ÿ"])
            if w:
                words["".join(w)] = rnd.choice([3, 3, 5, 6, 10, 12, 40, 90, 200])
    return words


@pytest.mark.parametrize("seed,crowd", [(1, 1), (2, 1), (3, 3), (4, 32), (5, 10**6)])
def test_like_loops(spark, monkeypatch, seed, crowd):
    words = variants(seed)
    found = spelling.near_words.__defaults__
    monkeypatch.setattr(spelling.near_words, "__defaults__", (crowd,))
    got = spelling.variant_forms(spark.createDataFrame([(w, n, 1, "x") for w, n in words.items()], "word string, n long, m int, head string")).collect()
    assert sorted(tuple(r) for r in got) == brute(words)
    assert found == (32,)


def test_crowded_chunks_are_not_paired(spark):
    words = [("abcdef" + a + b + c,) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame(words, "word string")).collect()}
    assert got == {(a, b) for (a,) in words for (b,) in words if is_near(a, b)}


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = [(None, "Éclair éclair ECLAIR-eclair's"), (1, None), (2, ""), (3, "  "), (4, "naïve " * 4 + "x" * 3000), *((k, "common Words of a-text à la carte number%d " % k * 2) for k in range(300)), (7, "words words"), (7, "words words")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, spelling.slipped).collect()} == counted(rows)


def test_empty_tables(spark):
    assert spelling.variant_forms(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    got = spelling.variant_forms(spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "word string, n long")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "b", "b", 1, 2), ("b", 2, None, "b", 1, None)]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    names = "word, n, form, root, n_near, form_n"
    got = sorted(map(tuple, spelling.op11_spelling_variants(spark, sf).select(*names.split(", ")).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {names} FROM ({spelling.ORACLE})").fetchall(), key=repr)
    assert got == sorted(brute(counted([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])), key=repr) or len(got) > 6000
