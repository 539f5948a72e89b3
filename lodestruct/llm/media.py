"""Interleaved sequences of texts and media, with payloads resolved by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, batches, materialise, table, values

#: Samples in a row of a stored image; payloads are padded with spaces to a positive multiple of it.
WIDTH = 192
#: Fixed value: the first eight bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
#: Paragraphs of a page before its payload's figure, and characters from which on the next line begins another paragraph.
LEAD, PARAGRAPH = 2, 400
#: Digests that a task remembers, so that copies are not decoded again.
SEEN = 1 << 17
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
#: Elements that start a new block of text, and those whose content is not text.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style template noscript".split())
MEDIA = frozenset("audio embed img source video".split())


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def encode_image(payload: bytes) -> bytes:
    """8-bit grey PNG whose samples, row by row, are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made; anything else is an error."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, width, packed = 8, 0, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("unexpected row filter")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, share of each sixteenth of the range, and a 64-bit mean hash along the samples."""
    a = np.frombuffer(payload, np.uint8)
    cuts = np.arange(64) * len(a) // 64
    level = np.add.reduceat(a.astype(np.int64), cuts) / np.diff(np.r_[cuts, len(a)])
    mean = int.from_bytes(np.packbits(level > level.mean()).tobytes(), "big")
    shares = np.bincount(a >> 4, minlength=16) * 255 // len(a)
    return f"{a.mean():.4f}:{a.std():.4f}:{bytes(shares.tolist()).hex()}:{mean:016x}"


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.flush()
            self.caption = []
        a = dict(attrs)
        if tag in MEDIA and a.get("src"):
            self.flush()
            self.figure.append(len(self.items))
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")})

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure if text else []:
                self.items[i]["caption"] = text
            self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def interleave_html(page: str | None) -> list[dict]:
    """Texts and media references of a page in reading order; a figure's caption goes with each of its media."""
    parser = _Interleaver()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def _sequences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleave_html(h) for h in values(batch.column(1))], pa.list_(_ITEM))], names=["id", "items"])


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items): the interleaved sequence of every page, one row for each row of ``pages``.

    Null and empty pages and pages without content have an empty one; broken markup is read as far as it goes. Ids may be
    null, repeat, or be structs; other columns are neither read nor returned; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(_sequences, f"id {kind}, items {SEQUENCE}")


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item of ``seqs`` (id, items): id, position, kind, text, ref, caption, digest and the columns of ``media``.

    ``media`` has a unique digest column and no other of these names; references ``sha256:<digest>`` find their row there
    by a shuffled equi-join, whose hot digests Spark's skew join splits if ``media`` is a table. Other references, those
    whose digest is unknown, and texts get nulls; these and texts do not go through the join. No item is lost or moved,
    and rows that repeat stay. Only what is asked of ``media`` travels, so features can be resolved without their
    payloads. An empty side gives no rows or no columns but nulls.
    """
    items = seqs.select("id", F.explode("items").alias("i")).select("id", "i.*")
    digest = F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    items = items.withColumn("digest", F.coalesce(digest, F.lit("")))
    found = items.filter("digest <> ''").join(media, "digest", "left")
    others = items.filter("digest = ''").withColumn("digest", F.lit(None).cast("string"))
    return found.unionByName(others, allowMissingColumns=True)


def page(text: str, digest: str) -> str:
    """A page of a text: paragraphs of whole lines, the payload as a captioned figure after the first ones, and a reference of another kind with a caption of its own at the end."""
    paragraphs, held, size = [], [], 0
    for line in text.split("\n"):
        held.append(line)
        size += len(line) + 1
        if size > PARAGRAPH:
            paragraphs.append("\n".join(held))
            held, size = [], 0
    if size:
        paragraphs.append("\n".join(held))
    body = [f"<p>{html.escape(p, quote=False)}</p>" for p in paragraphs]
    figure = f'<figure><img src="{SCHEME}{digest}" alt="payload"><figcaption>all of it, after {min(LEAD, len(body))} of {len(body)} paragraphs</figcaption></figure>'
    return f'<article>{"".join(body[:LEAD])}{figure}{"".join(body[LEAD:])}<video src="poster:{len(body)}" title="poster"></video></article>'


def _pages(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        made = [page(t.decode("utf-8", "replace"), hashlib.sha256(pad(t)).hexdigest()) for t in values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "html"])


def text_pages(docs: DataFrame) -> DataFrame:
    """(id, html): a page for each document, which refers to its payload by digest; id is (doc_id, n_bytes).

    A null text counts as empty. Ids may be null or repeat; repeated rows stay; other columns are neither read nor
    returned; an empty table gives an empty result.
    """
    ids, body = docs.schema["doc_id"].dataType.simpleString(), as_bytes(F.col("text"))
    rows = docs.select(F.struct("doc_id", F.octet_length(body).cast("long").alias("n_bytes")).alias("id"), body.alias("body"))
    return rows.mapInArrow(_pages, f"id struct<doc_id:{ids},n_bytes:bigint>, html string")


def _store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        payloads = [pad(t) for t in values(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([encode_image(p) for p in payloads], pa.binary())], names=["digest", "media"])


def store_payloads(docs: DataFrame) -> DataFrame:
    """(digest, media) in a table of the shared folder: the digest of each text's padded bytes and the image of them.

    One row for each row of ``docs``, so copies repeat; a null text counts as empty; other columns are not read; an
    empty table gives an empty one.
    """
    return materialise(docs.select(as_bytes(F.col("text")).alias("body")).mapInArrow(_store, "digest string, media binary"), "media")


def _describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for batch in batches(it):
        rows = []
        for digest, image in zip(*(values(c) for c in batch.columns)):
            if digest in seen:
                continue
            if len(seen) == SEEN:
                seen.clear()
            seen.add(digest)
            payload = decode_image(image)
            own = hashlib.sha256(payload).hexdigest()
            if own != digest:
                raise ValueError("an image does not hold what its digest says")
            rows.append({"digest": digest, "payload_bytes": len(payload), "payload_sha256": own, "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature(payload)})
        yield pa.RecordBatch.from_pylist(rows, schema=_DESCRIBED)


_DESCRIBED = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def describe(stored: DataFrame) -> DataFrame:
    """One row for every different digest of ``stored`` (digest, media), from the stored bytes read back: digest, sizes, hashes, feature.

    A task decodes a copy once; a row whose image is damaged or holds something else is an error. Null media are an
    error too. Other columns are not read; an empty table gives an empty result. The result is a table in the shared
    folder.
    """
    found = stored.select("digest", "media").mapInArrow(_describe, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return materialise(found.dropDuplicates(["digest"]), "described")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the item of its page that is its payload. Null texts count as empty; ids may be null or repeat, and each row gives one row."""
    docs = table(spark, sf_dir, "documents")
    described = describe(store_payloads(docs))
    payloads = F.filter("items", lambda i: F.startswith(i["ref"], F.lit(SCHEME)))
    seqs = sequences(text_pages(docs), "id").select(F.struct("id.*", F.size("items").alias("n_items")).alias("id"), payloads.alias("items"))
    return resolve(seqs, described).select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "id.n_items", "caption")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page of ``pages``: how many items its sequence has, how many refer to media, and a digest of all of them in order."""
    items = sequences(table(spark, sf_dir, "pages"))
    line = F.transform("items", lambda i: F.concat_ws("\x1f", i["kind"], i["text"], i["ref"], i["caption"]))
    media = F.size(F.filter("items", lambda i: i["kind"] == "media"))
    return items.select(F.col("id").alias("page_id"), F.size("items").alias("n_items"), media.alias("n_media"), F.sha2(F.array_join(line, "\x1e").cast("binary"), 256).alias("items_sha256"))
