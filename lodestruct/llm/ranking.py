"""Ranked lexical search over an index of strata: documents of equal length normaliser, postings by term frequency."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import LOWER, UPPER, batches, materialise, table

#: A term is a maximal run of anything but ASCII that is no letter or digit; the same in Java, Python and RE2.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = re.compile(TERM)
#: Terms and documents of a piece of a stratum, items of a block of queries, and pieces that a task searches together.
PIECE, DOCUMENTS, ITEMS, TOGETHER = 1 << 20, 1 << 11, 256, 8
_INDEX = "m long, piece long, documents array<struct<id:{0}>>, terms array<string>, groups array<int>, tf array<int>, sizes array<int>, slots array<int>"


def terms(text: bytes) -> list[str]:
    """Terms of a text in UTF-8 in order, only A-Z lower-cased."""
    return _TERMS.findall(text.lower().decode())


#: Whether each byte is part of a term.
_INSIDE = np.array([b >= 0x80 or bool(_TERMS.fullmatch(chr(b))) for b in range(256)])


def _count(text: pa.Array) -> np.ndarray:
    """Number of terms of each text of a binary column without nulls: places where a term starts, found over the whole column at once."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(len(text), np.int64)
    inside = _INSIDE[np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    starts[first] = inside[first]
    before = np.r_[0, np.cumsum(starts)]
    return before[ends[1:]] - before[ends[:-1]]


def _lengths(keep: bool):
    """n, the number of terms of each text (the last column, as bytes), alone or beside what there is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                n = pa.array(_count(batch.column(batch.num_columns - 1)), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, n] if keep else [n], names=[*batch.schema.names, "n"] if keep else ["n"])

    return run


def _build(kind: pa.DataType):
    names = ["m", "piece", "documents", "terms", "groups", "tf", "sizes", "slots"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("id", kind)])), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 4]

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        found = []
        for slot, text in enumerate(docs.column("text")):
            count = Counter(terms(text.as_py()))
            at = [known.setdefault(t, len(known)) for t in count]
            found.append(np.array([at, list(count.values()), [slot] * len(at)], np.int64))
        term, tf, slot = np.concatenate(found, axis=1)
        order = np.lexsort((slot, tf, term))
        term, tf, slot = term[order], tf[order], slot[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(tf) != 0)])
        groups = np.bincount(term[starts], minlength=len(known))
        row = [key[0].as_py(), key[1].as_py(), [{"id": d} for d in docs.column("doc_id").to_pylist()], list(known), groups.astype(np.int32), tf[starts].astype(np.int32), np.diff(np.r_[starts, len(tf)]).astype(np.int32), slot.astype(np.int32)]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    return run


def build_index(docs: DataFrame, piece: int = PIECE) -> tuple[DataFrame, int, int]:
    """An index of all documents with at least one term, the number N of those documents, and the number L of their terms.

    Documents of equal m = 75 + (25 * n * N) div L (n: terms of the document) are a stratum. A row holds a piece of one:
    m, its documents, its terms, and for each term its documents grouped by tf (``groups`` of a term, their ``tf`` and
    ``sizes``, and ``slots``, positions in ``documents``). A piece has about ``piece`` terms and DOCUMENTS documents at most, so a stratum with a third of
    all documents is many pieces; one longer document is a piece of its own. Null texts and texts without terms are in no
    stratum. Repeated rows and ids are documents each; a null id is kept. Other columns are not read. An empty table
    gives an empty index.
    """
    kind = docs.schema["doc_id"].dataType
    body = docs.filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    # counted twice, which costs less than to keep the texts
    lengths = materialise(body.select("text").mapInArrow(_lengths(False), "n long").groupBy("n").agg(F.count("*").alias("docs")).filter("n > 0"), "lengths")
    sized = body.mapInArrow(_lengths(True), f"doc_id {kind.simpleString()}, text binary, n long").filter("n > 0")
    many, total = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("docs") * F.col("n")), F.lit(0))).first()
    m = F.expr(f"75L + (25L * n * {many}L) div {max(total, 1)}L")
    strata = lengths.withColumn("m", m).groupBy("m").agg(F.sum(F.expr("docs * n")).alias("words"), F.sum("docs").alias("docs"))
    strata = strata.select("m", F.ceil(F.greatest(F.col("words") / piece, F.col("docs") / DOCUMENTS)).alias("pieces"))
    dealt = sized.withColumn("m", m).join(strata, "m").withColumn("piece", F.pmod(F.xxhash64("doc_id", "text"), "pieces"))
    index = dealt.select("m", "piece", "doc_id", "text").groupBy("m", "piece").applyInArrow(_build(to_arrow_type(kind)), _INDEX.format(kind.simpleString()))
    return materialise(index, "index"), many, total


def _asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        rows = [(k, t, n) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms(text.encode())).items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["query", "term", "times"])


def _search(top: int):
    """Best documents of each query of a block in the pieces of a task."""

    def run(pieces: pa.Table, asked: pa.Table) -> pa.Table:
        kind = pieces.schema.field("documents").type.value_type.field("id").type
        names = {q: k for k, q in enumerate(dict.fromkeys(asked.column("query").to_pylist()))}
        of = np.array([names[q] for q in asked.column("query").to_pylist()], np.int64)
        word, weight = asked.column("term").to_pylist(), asked.column("weight").to_numpy()
        wanted: dict[str, list[int]] = {}
        for k, t in enumerate(word):
            wanted.setdefault(t, []).append(k)
        wanted = {t: np.array(k) for t, k in wanted.items()}
        plans = []
        for row in range(pieces.num_rows if names else 0):
            m = pieces.column("m")[row].as_py()
            here = [(k, wanted[t]) for k, t in enumerate(pieces.column("terms")[row].as_py()) if t in wanted]
            if not here:
                continue
            ends = np.cumsum(pieces.column("groups")[row].values.to_numpy())
            tf = pieces.column("tf")[row].values.to_numpy().astype(np.int64)
            sizes = np.r_[0, np.cumsum(pieces.column("sizes")[row].values.to_numpy())]
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)  # once for each tf of a stratum
            bound = np.zeros(len(names), np.int64)
            for k, q in here:
                bound[of[q]] += weight[q] * impact[ends[k] - 1]  # the greatest tf of a term comes last
            plans.append((int(bound.max()), row, here, ends, impact, sizes, bound))
        plans.sort(key=lambda p: (-p[0], p[1]))
        best: list[list[tuple]] = [[] for _ in names]
        least = np.zeros(len(names), np.int64)  # a document must reach this score, and more than 0
        for _, row, here, ends, impact, sizes, bound in plans:
            live = bound >= np.maximum(least, 1)
            if not live.any():
                continue
            slots = pieces.column("slots")[row].values.to_numpy()
            ids = pieces.column("documents")[row].values.field("id").to_pylist()
            at = np.cumsum(live) - 1
            score = np.zeros((int(live.sum()), len(ids)), np.int64)
            for k, q in here:
                q = q[live[of[q]]]
                if len(q):
                    lo, hi = (ends[k - 1] if k else 0), ends[k]
                    value = np.repeat(impact[lo:hi], np.diff(sizes[lo : hi + 1]))
                    where = slots[sizes[lo] : sizes[hi]]
                    for row_of, w in zip(at[of[q]].tolist(), weight[q].tolist()):
                        score[row_of, where] += w * value  # a document is at most once in a term's list
            for query in np.flatnonzero(live).tolist():
                line = score[at[query]]
                keep = np.flatnonzero(line >= max(least[query], 1))
                if len(keep) > 4 * top:  # all that reach the top-th score, ties too
                    edge = np.partition(line[keep], len(keep) - top)[len(keep) - top]
                    keep = keep[line[keep] >= edge]
                pairs = best[query] + [(int(line[d]), ids[d]) for d in keep]
                pairs.sort(key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0))
                best[query] = pairs[:top]
                if len(pairs) >= top:
                    least[query] = pairs[top - 1][0]
        found = [(q, d, s) for q, k in names.items() for s, d in best[k]]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), kind, pa.int64()))], names=["query", "doc_id", "score"])

    return run


def search(index: tuple[DataFrame, int, int], items: DataFrame, top: int = 20, block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of an index for each row of ``items`` (item_id, text).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums weight * ((10^9 tf) div (1000 tf +
    12 m)) over the item's terms, repeats included. Only scores above 0 count; equal ones go by doc_id, nulls last. Each
    task holds a few pieces and a block of items, visits the pieces by the greatest score that they can give, and leaves
    out those whose bound for an item is below its top-th score so far. Blocks of items go to every task as a stated
    query set; nothing is broadcast. Items without terms, or whose terms are in no document, have no rows; repeated items
    are ranked each; a null item_id is kept. Other columns are not read. An empty index or no items give an empty result.
    """
    pieces, many, _ = index
    asked = materialise(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("query", F.monotonically_increasing_id()), "items")
    numbers = materialise(asked.select("query", "item_id"), "item_ids")
    wanted = materialise(asked.select("query", "text").mapInArrow(_asked, "query long, term string, times long"), "asked")
    counted = pieces.select("terms", "groups", "sizes").mapInArrow(_frequencies, "term string, df long")
    df = counted.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * many + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
    ready = materialise(wanted.join(df, "term").select("query", "term", weight.alias("weight")), "weights")
    groups = max(1, -(-pieces.count() // TOGETHER))
    blocks = max(1, -(-asked.count() // block))
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("m", "piece"), F.lit(groups)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = ready.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = dealt.groupBy("task", "block").cogroup(sent.groupBy("task", "block")).applyInArrow(_search(top), f"query long, doc_id {pieces.schema['documents'].dataType.elementType['id'].dataType.simpleString()}, score long")
    w = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.join(numbers, "query").select("item_id", "rank", "doc_id", "score")


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each piece: the documents of all its groups."""
    for batch in batches(it, 1):
        groups, sizes = batch.column(1)[0].values.to_numpy(), batch.column(2)[0].values.to_numpy()
        df = np.add.reduceat(sizes, np.r_[0, np.cumsum(groups)[:-1]]) if len(groups) else sizes
        yield pa.RecordBatch.from_arrays([batch.column(0)[0].values, pa.array(df.astype(np.int64))], names=["term", "df"])


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM_SQL}') AS terms FROM documents
), s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM t WHERE len(terms) > 0),
docs AS (SELECT d, doc_id, 75 + (25 * len(terms) * docs) // words AS m, terms FROM t, s WHERE len(terms) > 0),
tf AS (SELECT d, any_value(doc_id) AS doc_id, any_value(m) AS m, term, count(*) AS tf FROM (SELECT d, doc_id, m, unnest(terms) AS term FROM docs) GROUP BY d, term),
df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM s) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM_SQL}')) AS term FROM benchmark),
hit AS (
  SELECT item_id, d, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) GROUP BY item_id, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= 20
"""
