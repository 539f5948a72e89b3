"""The pipeline's stages, each on its own input, against plain Python: nulls, repeats, clashing columns, empty tables."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_models import naive_quality
from test_near_copies import roots, shingle_set

import corpus_pipeline
from lodestruct.llm import _train, mixing, packing, quality

RNG = np.random.default_rng(23)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, times int, lines string, body string"


def words(n):
    return " ".join(f"w{k}" for k in RNG.integers(0, 300, n))


def rows():
    same = words(40)
    texts = [(k, words(int(RNG.integers(1, 60))) + "\n Common LINE \t\n" + words(3)) for k in range(60)]
    texts += [(None, words(20)), (None, words(20)), (70, None), (71, ""), (72, " \n\t"), (73, words(5)), (73, words(6))]
    texts += [(80, same)] * 4 + [(81, same), (None, same), (None, same)]
    texts += [(90 + k, f"common line\nrare {k}") for k in range(3)] + [(95, "few\nend")] * 12
    return [(i, t, "en", None if (i or 0) % 9 == 0 else f"s{(i or 0) % 4}", len(t or "")) for i, t in texts]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, "l", "b") for r in ROWS], SCHEMA)


def kept(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted(map(tuple, df.collect()), key=repr)


def write_labels(spark, folder, known):
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


BAD = [(200 + k, "zz zz zz " * int(RNG.integers(5, 40)), "en", "s1", 1) for k in range(60)]


def with_bad(spark, docs, folder):
    """The documents with some of poor quality, and the folder with labels of both."""
    every = docs.unionByName(spark.createDataFrame([(*r, 9, "l", "b") for r in BAD], SCHEMA))
    return every, write_labels(spark, folder, [(k, 1, 0) for k in range(60)] + [(200 + k, 0, 0) for k in range(60)] + [(None, 0, 1)])


def plain_quality(spark, every, folder):
    texts, y = _train.labelled_sample(every, spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    model = quality.fit([t.encode() for t in texts], y)
    score = {t: naive_quality(model, (t or "").encode()) for t in {r[1] for r in ROWS + BAD}}
    return [r for r in ROWS + BAD if score[r[1]] >= quality.ACCEPT]


def test_quality_keeps_what_the_model_accepts(spark, docs, tmp_path):
    every, folder = with_bad(spark, docs, tmp_path)
    want = plain_quality(spark, every, folder)
    assert kept(corpus_pipeline.quality(spark, every, folder)) == sorted(want, key=repr)
    assert sum(r[0] is not None and r[0] < 60 for r in want) > 55 and not any(r[0] is not None and r[0] >= 200 for r in want)


def common_lines(rows):
    """Documents by line key, and how a line becomes its key."""
    found = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            found.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    return found


def plain_lines(rows):
    found, want = common_lines(rows), []
    for i, t, lang, source, _ in rows:
        keys = [(x, x.strip(" \t\n\x0b\x0c\r").lower()) for x in (t or "").split("\n")]
        left = "\n".join(x for x, key in keys if not key or len(found[key]) < 10)
        want.append((i, left, lang, source, len(left)))
    return want


def test_line_dedup_drops_common_lines(spark, docs):
    found = common_lines(ROWS)
    assert {len(found["common line"]) >= 10, len(found["few"]) < 10} == {True}
    assert kept(corpus_pipeline.line_dedup(spark, docs, "")) == sorted(plain_lines(ROWS), key=repr)


def plain_near(rows):
    """Of each class of near copies the row of least id, nulls last; here no class has two different rows of that id."""
    best = {}
    for row, root in zip(rows, roots([shingle_set(r[1]) for r in rows])):
        best.setdefault(root, []).append(row)
    return [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in best.values()]


def plain_mix(spark, rows):
    """Words taken from each row (id, text, source): targets by sharing the excess, streams cut into blocks, blocks read in turn."""
    hashed = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(rows)], "k int, doc_id long, text string")
    hashed = {r[0]: r[1:] for r in hashed.select("k", F.xxhash64(F.lit(7), F.struct("doc_id", F.xxhash64("text"))), F.xxhash64("text")).collect()}
    size = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = {}, float(sum(size)), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * total[s]]
        for s in full or free:
            target[s] = 3.0 * total[s] if full else weight[s] * level
            left -= target[s]
        free = [s for s in free if s not in target]
    taken = [0] * len(rows)
    for sid, s in enumerate(names):
        if not total[s]:
            continue
        blocks = max(1, total[s] // max(1, min(mixing.MAX_BLOCK_WORDS, total[s] // mixing.MIN_BLOCKS)))
        quota = min(3 * blocks, math.floor(target[s] * blocks / total[s] + 0.5))
        turns = {r[0]: r[1] for r in spark.range(4).select("id", F.pmod(F.xxhash64(F.lit(sid).cast("int"), "id"), F.lit(blocks))).collect()}
        reads = Counter((rank + turns[rank // blocks]) % blocks for rank in range(quota))
        order = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (hashed[k][0] % mixing.BUCKETS, hashed[k][0], hashed[k][1], size[k]))
        stream = [k for k in order for _ in range(size[k])]
        b, r = divmod(len(stream), blocks)
        at = 0
        for block in range(blocks):
            n = b + (block < r)
            for k in stream[at : at + n]:
                taken[k] += reads[block]
            at += n
    return size, taken


def plain_times(spark, rows):
    size, taken = plain_mix(spark, [(r[0], r[1], r[3]) for r in rows])
    group = {}
    for r, n, t in zip(rows, size, taken):
        g = group.setdefault((r[0], r[1], r[3]), [0, 0])
        g[0], g[1] = g[0] + n, g[1] + t
    want = []
    for r in rows:
        n, t = group[r[0], r[1], r[3]]
        want += [r] * (math.floor(t / n + 0.5) if n else 0)
    return want


def test_mixing_against_plain_python(spark, docs):
    want = plain_times(spark, ROWS)
    assert any(r[0] == 80 for r in want) and max(Counter(want).values()) <= 3 * 12
    assert kept(corpus_pipeline.mixing(spark, docs, "")) == sorted(want, key=repr)


def check_packed(rows, pieces):
    """The pieces hold each id of the rows once, and the sequences are full up to a power of two."""
    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, packing.END])
    covered, sequences = Counter(), {}
    for r in pieces:
        part = slice(r["start"], r["start"] + r["length"])
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[part], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered.update((r["doc_id"], r["doc_tokens"], k) for k in range(part.start, part.stop))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter((i, len(x), k) for i, many in ids.items() for x in many for k in range(len(x)))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and (ends[-1] & (ends[-1] - 1)) == 0 and ends[-1] <= packing.LENGTH


def test_packing_holds_every_id_once(spark, docs):
    check_packed(ROWS, corpus_pipeline.packing(spark, docs, "").collect())


def test_five_stages_in_a_row(spark, docs, tmp_path):
    """The whole pipeline over tables with nulls, repeats, near copies and poor texts: what plain Python keeps, and as often."""
    every, folder = with_bad(spark, docs, tmp_path)
    every.write.parquet(f"{folder}/documents.parquet")
    rows = plain_quality(spark, every, folder)
    for stage in (plain_lines, plain_near, lambda r: plain_times(spark, r)):
        before, rows = rows, stage(rows)
        assert rows and Counter(rows) != Counter(before)
    pieces = corpus_pipeline.run(spark, folder).collect()
    check_packed(rows, pieces)
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in rows)


def test_stages_of_empty_tables(spark, docs, tmp_path):
    folder = write_labels(spark, tmp_path, [(1, 1, 0), (2, 0, 0)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
