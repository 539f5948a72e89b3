"""Media columns: every column of the query and the order of the pages, against plain Python."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestruct.llm import media

TEXTS = [
    (1, "plain"), (2, ""), (3, None), (4, "a < b & c > d \"quoted\" 'single' &amp; <b>bold</b>\x00\r end"), (5, "\n".join(f"line {k} of a longer text with words" for k in range(90))),
    (5, "same id, other text"), (None, "no id"), (7, "plain"), (7, "plain"), (8, "x" * 192), (9, "x" * 193), (10, "é日本 “q” " * 400), (11, "\n" * 30), (12, "w " * 400_000),
]


def plain_feature(p):
    a = np.frombuffer(p, np.uint8).astype(float)
    cuts = [64 * 0 + k * len(a) // 64 for k in range(65)]
    level = np.array([a[x:y].mean() for x, y in zip(cuts, cuts[1:])])
    bits = sum(1 << (63 - k) for k in range(64) if level[k] > level.mean())
    shares = bytes(int((a // 16 == k).sum()) * 255 // len(a) for k in range(16))
    return f"{a.mean():.4f}:{a.std():.4f}:{shares.hex()}:{bits:016x}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "d", 3, "m") for i, t in TEXTS], "doc_id long, text string, digest string, position int, media string")


def test_columns_of_the_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op8_media_columns(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        stored = media.encode_image(p)
        assert media.decode_image(stored) == p
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(p)))
    keys = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(map(repr, (tuple(r[k] for k in keys) for r in got))) == sorted(map(repr, want))


def test_pages_interleave_texts_and_media(docs):
    seqs = media.sequences(media.text_pages(docs), "id")
    rows = media.resolve(seqs, media.describe(media.store_payloads(docs))).collect()
    by = {}
    for r in rows:
        by.setdefault((r["id"]["doc_id"], r["id"]["n_bytes"]), []).append(r)
    for i, t in TEXTS:
        own = sorted(by[i, len((t or "").encode())], key=lambda r: r["position"])[:: 2 if i == 7 else 1]
        assert [r["position"] for r in own] == list(range(len(own)))
        words = " ".join(r["text"] for r in own if r["kind"] == "text").split()
        assert words == (t or "").split()
        at = [r["position"] for r in own if r["kind"] == "media"]
        texts = len(own) - 2
        assert at == [min(media.LEAD, texts), len(own) - 1]
        assert own[at[0]]["payload_bytes"] >= 192 and own[at[0]]["caption"].startswith("all of it") and own[at[1]]["caption"] == "poster" and own[at[1]]["payload_bytes"] is None
        assert all(r["digest"] is None for r in own if r["position"] != at[0])


def test_damaged_and_foreign_images(spark):
    p = bytes(range(256)) * 3
    good = (hashlib.sha256(p).hexdigest(), media.encode_image(p))
    make = lambda *rows: spark.createDataFrame([(d, bytearray(m)) for d, m in rows], "digest string, media binary")
    assert media.describe(make(good, good)).count() == 1
    for bad in (("0" * 64, good[1]), (good[0], good[1][:-20]), (good[0], b"GIF89a")):
        with pytest.raises(Exception):
            media.describe(make(bad)).count()


def test_empty_tables(docs):
    none = docs.limit(0)
    described = media.describe(media.store_payloads(none))
    assert described.count() == 0 and media.text_pages(none).count() == 0
    some = media.resolve(media.sequences(media.text_pages(docs), "id"), described)
    assert some.filter("payload_bytes is not null").count() == 0 and some.filter(F.startswith("ref", F.lit("sha256:"))).count() == len(TEXTS)


def test_pages_table(spark, sf):
    """The texts of all real pages, in order, against a reading by regular expressions."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["id"]: r["items"] for r in media.sequences(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<(script|style|template|noscript)\b.*?</\1>|<!--.*?-->", " ", r["html"] or "")
        words = html.unescape(re.sub(r"</?(b|i|em|a|strong|span)\b[^>]*>", "", re.sub(r"<(?!/?(?:b|i|em|a|strong|span)\b)[^>]*>", " ", body))).split()
        assert " ".join(x["text"] or "" for x in got[r["page_id"]] if x["kind"] == "text").split() == words
    found = media.page_sequences(spark, sf)
    assert found.count() == pages.count() and found.filter("n_items > 0").count() > 0


def test_page_sequences_by_reading_them_again(spark, sf):
    """Items, references and the digest of all of them against a plain walk over every page with the standard parser."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.refs = []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in media.MEDIA and a.get("src"):
                self.refs.append(a["src"])

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    items = {r["id"]: r["items"] for r in media.sequences(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    found = {r["page_id"]: r for r in media.page_sequences(spark, sf).collect()}
    assert set(found) == set(pages)
    for k, text in pages.items():
        walk = Walk()
        walk.feed(re.sub(r"(?s)<(script|style|template|noscript)\b.*?</\1>", " ", text))
        own = [i for i in items[k] if i["kind"] == "media"]
        assert [i["ref"] for i in own] == walk.refs and found[k]["n_media"] == len(walk.refs), k
        assert found[k]["n_items"] == len(items[k])
        whole = "\x1e".join("\x1f".join(x for x in (i["kind"], i["text"], i["ref"], i["caption"]) if x is not None) for i in items[k])
        assert found[k]["items_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
