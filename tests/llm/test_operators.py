"""Each operator against a brute-force version on small, awkward inputs, and on empty ones."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestruct.llm import linededup, media, mixing, nearest, packing, quality, simhash, suffixes, tokens, toxicity
from lodestruct.llm._train import best_threshold

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potent potion near the old mill "
TEXTS = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "ONE  two"), (5, PASSAGE), (6, PASSAGE), (7, "lead in " + PASSAGE + "tail"), (8, "x" * 400), (9, "x" * 120 + "y"),
    (10, "é" * 300 + " ok <|endoftext|> " + PASSAGE * 3), (11, PASSAGE.upper()), (12, "a\nB \n\na\n"), (13, "\n".join(f"line {k % 3}" for k in range(50))), (14, "日本語 text — with “quotes” it's 3 o'clock"),
    (None, PASSAGE), (None, "no id"), (15, PASSAGE + PASSAGE), (15, PASSAGE + PASSAGE), (15, "other text of the same id " + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", 1, "k", 3) for k, (i, t) in enumerate(TEXTS)]
    # extra columns with names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lines string, fp int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(16)] + [(None, None, 1)], "doc_id long, quality int, toxic int")


def text(i):
    return dict((k, t) for k, t in TEXTS[::-1] if k is not None)[i] or ""


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    fps = sorted(brute_fingerprint(t) for _, t in TEXTS)
    assert sorted(r["fp"] % (1 << 64) for r in got) == fps
    by = {}
    for r in got:
        by.setdefault(r["component_id"], set()).add(r["fp"] % (1 << 64))
    for a in by:
        for b in by:
            if a != b:
                assert min(bin(x ^ y).count("1") for x in by[a] for y in by[b]) > 2
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}


@pytest.mark.parametrize("max_bits", [1, 2])
@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_dense_clusters(spark, max_bits, bucket):
    rng = np.random.default_rng(3)
    fps = {0}
    for base in rng.integers(0, 1 << 62, 4).tolist():
        for _ in range(60):
            x = base
            for b in rng.choice(64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), max_bits, bucket)
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.connected_components(links).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in fps:
        for y in fps:
            if bin(x ^ y).count("1") <= max_bits:
                parent[find(x)] = find(y)
    for x in fps:
        for y in fps:
            assert (find(x) == find(y)) == (x == y or (x in roots and y in roots and roots[x] == roots[y]))


def test_line_dedup(docs, spark):
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, f"own {k}\n  Shared LINE\t\nend {k}") for k in range(10)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in linededup.drop_common_lines(many).filter("doc_id >= 100").collect()}
    assert got[103]["text"] == "own 3\nend 3" and got[103]["n_lines"] == 3 and got[103]["n_dropped"] == 1
    every = linededup.drop_common_lines(docs, min_docs=1).collect()
    assert len(every) == len(TEXTS)
    assert {r["text"] for r in every if r["doc_id"] in (0, 1)} == {""} and all(r["n_lines"] == (t or "").count("\n") + 1 for r, t in zip(sorted(every, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), [t for i, t in TEXTS if i is not None][:15]) if r["doc_id"] not in (None, 15))
    assert linededup.drop_common_lines(docs, carry=("lang", "lines")).select("carried.lines").distinct().count() == 1


def test_token_counts(docs):
    tok = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    for chunk, overlap in ((1 << 15, 256), (64, 40), (97, 33)):
        got = tokens.token_counts(docs, chunk=chunk, overlap=overlap).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_fast_pieces_equal_the_library():
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x100)]] + list("  '''aaa111\n")
    for _ in range(4000):
        t = "".join(rng.choice(letters, rng.integers(0, 14))) + str(rng.choice(["", "'ll", "'S ", "  x", "\n\n "]))
        assert counter.count(t) == len(counter.tok.encode(t, add_special_tokens=False).ids)
        assert encoder.ids(t) == np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_and_counter_follow_the_file(name):
    encoder, counter = packing.Encoder(public_tokenizers.path(name)), tokens.Counter(public_tokenizers.path(name))
    for t in ["Hello World 2024", "a  b", " x\n\n y ", "<|ENDOFTEXT|> a", "it's 'LL", "ÀÉ straße", *[t or "" for _, t in TEXTS]]:
        want = encoder.tok.encode(t, add_special_tokens=False).ids
        assert encoder.ids(t) == np.array(want, "<u4").tobytes() and counter.count(t) == len(want)


@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 70_000)])
def test_packing_other_files_and_large_ids(docs, name, end):
    """Whole documents rebuilt from their pieces, with an id that does not fit into 16 bits."""
    tok = packing.tokenizer(public_tokenizers.path(name))
    got, built = packing.pack(docs, public_tokenizers.path(name), length=64, end=end).collect(), {}
    for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        if r["doc_id"] is not None and r["doc_id"] != 15:
            assert r["start"] * 4 == len(built.get(r["doc_id"], b"")) and r["length"] * 4 == len(r["ids"])
            built[r["doc_id"]] = built.get(r["doc_id"], b"") + bytes(r["ids"])
    for i in built:
        assert built[i] == np.array([*tok.encode(text(i), add_special_tokens=False).ids, end], "<u4").tobytes()
    with pytest.raises(ValueError):
        packing.pack(docs, end=-1)


def test_packing(docs):
    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs, length=64).collect()
    want = sorted(b"".join(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _ in [0]) for _, t in TEXTS)
    pieces, sequences = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sum(len(w) for w in want) == sum(4 * r["length"] for r in got)
    for i in (3, 8, 10, 13, 14):
        ids = b"".join(bytes(r["ids"]) for r in sorted(pieces[i], key=lambda r: r["start"]))
        assert ids in want and all(r["doc_tokens"] * 4 == len(ids) for r in pieces[i])


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512)) and np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=5)]) for k in range(70)] + [(70 + k, [1.0, 0.0, 0.0, 2.0, 1.0]) for k in range(30)]
    rows += [(None, [1.0] * 5), (200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.array(x) for i, x in rows if i is not None and i < 200}
    got = {}
    for r in nearest.nearest(v, v.filter("vec_id % 20 = 0"), k=6, rows=16, query_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80}
    for q, found in got.items():
        exact = sorted((-float(np.cumsum(good[q] * x)[-1]), i) for i, x in good.items() if i != q)[:6]
        assert [(i, s) for _, i, s in sorted(found)] == [(i, -s) for s, i in exact]
    assert nearest.nearest(v.limit(0), v).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    total = {}
    for r in got:
        assert r["size"] >= 0 and r["taken"] <= 3 * r["size"]
        s, t, k = total.get(r["source"], (0, r["target"], 0))
        total[r["source"]] = (s + r["size"], t, k + r["taken"])
    assert sum(t for _, t, _ in total.values()) == pytest.approx(sum(s for s, _, _ in total.values()))
    for s, t, k in total.values():
        assert abs(k - t) <= 1 and t <= 3 * s
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a stops at 3, b at 30, the rest is c's
    assert got == {"a": 3.0, "b": 30.0, "c": 78.0, None: 0.0}


def test_interleaving_keeps_order_and_captions():
    html = "<body>Hello <b>bold</b><script>no()</script><figure><img src='a'><img src=b alt='own'><figcaption>Both <i>of</i> them</figcaption></figure>after<img alt=x><p>end"
    items = media.interleave_html(html)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("text", "Hello bold", None), ("media", "a", "Both of them"), ("media", "b", "Both of them"), ("text", "after", None), ("text", "end", None)]
    assert [i["position"] for i in items] == list(range(5))
    assert media.interleave_html(None) == [] and media.interleave_html("<<p") is not None


def test_suffix_dedup(docs, spark):
    extra = spark.createDataFrame([(50, "z" * 49), (51, "ab" * 200), (52, "pre " + "ab" * 100), (53, PASSAGE[:50]), (54, PASSAGE[1:50])], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    rows = [(i, (t or "").encode()) for i, t in TEXTS] + [(r[0], r[1].encode()) for r in extra.collect()]
    first = {}
    for i, b in rows:
        for s in range(len(b) - 49) if i is not None else ():
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49) if i is not None else ():
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i is None, i or 0, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffixes.drop_repeats(every).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


def test_loser_tree_merges_runs():
    rng = np.random.default_rng(4)
    runs, keys = [], []
    for n in (1, 7, 40, 3, 25):
        rows = rng.integers(0, 3, (n, suffixes.KEY)).astype(np.uint8)
        rows[:, 3:] = rows[:, :1]
        keys += {bytes(r) for r in rows}
        zero = np.zeros(n, np.int64)
        runs.append(suffixes.Run(suffixes.front_code(rows, np.arange(n), zero, np.arange(n), zero)))
    merged = [(shared, k) for shared, _, _, k in suffixes.merge(runs)]
    assert [k for _, k in merged] == sorted(keys)
    for (_, a), (shared, b) in zip(merged, merged[1:]):
        assert shared == next((i for i in range(suffixes.KEY) if a[i] != b[i]), suffixes.KEY)


def test_classifiers_on_awkward_rows(docs, labels, spark):
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        got = scores(docs, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["score"] == 0.5 for r in scores(docs, labels.limit(0)).collect())
        assert all(r["score"] == 1 for r in scores(docs, labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic")).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r[0]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, column, least in ((toxicity.op1_toxicity, 2, 0.9), (quality.op10_quality, 1, 0.97)):
        rows = [r for r in query(spark, sf).filter("held_out").collect() if r["doc_id"] in known]
        assert np.mean([r["predicted"] == known[r["doc_id"]][column] for r in rows]) >= least


def test_threshold():
    assert best_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0
    assert best_threshold(np.zeros(0), np.zeros(0)) == 0.0


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    for made in (simhash.near_duplicates(none), linededup.drop_common_lines(none), tokens.token_counts(none), packing.pack(none), mixing.mix(none), media.describe(media.store_payloads(none)), suffixes.drop_repeats(none), toxicity.toxicity_scores(none, labels), quality.quality_scores(none, labels)):
        assert made.count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for query, sql in ((linededup.op6_line_dedup, linededup.ORACLE), (nearest.op5_nearest, nearest.ORACLE)):
        got, want = query(spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_pipeline(docs, spark, sf):
    labels_dir = sf
    stage = docs
    for name, fn in corpus_pipeline.STAGES:
        stage = fn(spark, stage, labels_dir)
        if name != "packing":
            assert stage.columns == list(corpus_pipeline.COLUMNS)
            stage = corpus_pipeline.materialise(stage, name)
    assert stage.agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.run(spark, sf).count() > 0
