"""Ranked search against plain loops on a small table, and against its SQL."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

from lodestruct.llm import ranking

DOCS = [
    (1, "the cat sat on the mat"), (2, "The CAT, the dog; the end."), (3, None), (4, ""), (5, " .,-\n"), (6, "the cat sat on the mat"), (None, "cat mat"), (None, "cat mat"),
    (7, "éclair naïve 日本 x2 cat"), (8, "mat " * 3000 + "cat"), (8, "another of the same id cat"), (9, "the"), (10, "dog\x00cat"), *((100 + k, "cat sat" + " pad" * (k % 5)) for k in range(60)),
]
ITEMS = [(1, "the cat"), (2, "cat cat CAT mat"), (3, None), (4, "nowhere"), (5, "naïve-日本?"), (2, "cat cat CAT mat"), (None, "dog"), (6, " ")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        asked, found = words(text), []
        for i, w, c in bags:
            m = 75 + 25 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [8, 1 << 20])
@pytest.mark.parametrize("block", [1, 256])
def test_like_loops(spark, piece, block):
    # extra columns with names that the operator uses inside
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in DOCS], "doc_id long, text string, n int, m int")
    items = spark.createDataFrame([(i, t, 1.0) for i, t in ITEMS], "item_id long, text string, query double")
    got = ranking.search(ranking.build_index(docs, piece), items, block=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search(ranking.build_index(docs.limit(0)), items).count() == 0
    assert ranking.search(ranking.build_index(docs), items.limit(0)).count() == 0


def test_index_keeps_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index, many, total = ranking.build_index(docs)
    bags = {r["doc_id"]: Counter(words(r["text"])) for r in docs.collect()}
    assert many == sum(bool(c) for c in bags.values()) and total == sum(sum(c.values()) for c in bags.values())
    seen = {}
    for r in index.collect():
        tfs, at = iter(zip(r["tf"], r["sizes"])), 0
        for term, groups in zip(r["terms"], r["groups"]):
            for _ in range(groups):
                tf, size = next(tfs)
                for slot in r["slots"][at : at + size]:
                    seen.setdefault(r["documents"][slot]["id"], Counter())[term] += tf
                at += size
    assert seen == {i: c for i, c in bags.items() if c}


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = ranking.op12_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({ranking.ORACLE})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
