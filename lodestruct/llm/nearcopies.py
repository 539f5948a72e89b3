"""Near copies by the similarity of their word shingles: SimHash fingerprints and MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, materialise
from .components import connected_components
from .simhash import SEED, folded, near_links, shingle_hashes

#: Four minima make a band. Sets of similarity 0.8 share one of the 16 bands in all but (1 - 0.8^4)^16 = 0.02% of cases.
BANDS, ROWS = 16, 4
LANES = BANDS * ROWS
#: Sets of one tile are compared where half of their minima agree, six standard deviations below similarity 0.8.
AGREE = LANES // 2
#: Hashes that go through the minima at once.
STEP = 2048
_RNG = np.random.default_rng(SEED)
MASKS = _RNG.integers(0, 1 << 64, (LANES, 1), dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 64, (LANES, 1), dtype=np.uint64) | np.uint64(1)
MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different ASCII-lower-cased word shingles; a shorter text is one shingle, no words none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(LANES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[None, at : at + STEP] ^ MASKS) * FACTORS).min(axis=1))
    return least


def _mark(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            nodes, sigs, keys, prints = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                blocks = list(shingle_hashes((text or "").encode(), words))
                prints.append(folded(blocks))
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                least = minima(found)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sigs.append(least.astype(np.uint8).tobytes())
                keys.append((least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64) if len(found) else [])
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "node", "sig", "keys", "fp"])

    return run


def _sets(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = [shingles((t or "").encode(), words).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.int64()))], names=["node", "mark", "sig", "hashes"])

    return run


def _compare(least: float):
    """Links between the sets of a tile (sides 0 and 1) that are not connected yet; each link joins two classes, so links stay fewer than sets."""

    def run(tile: pa.Table) -> pa.Table:
        node, side = tile.column("node").to_numpy(), tile.column("side").to_numpy()
        sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint8).reshape(-1, LANES)
        sets = [np.asarray(x.values) for x in tile.column("hashes")]
        sizes = np.array([len(x) for x in sets])
        label = np.unique(tile.column("root").to_numpy(), return_inverse=True)[1]
        right, links = np.flatnonzero(side != 0), []
        for i in np.flatnonzero(side != 1).tolist():
            agree = (sig[right] == sig[i]).sum(axis=1)
            fits = np.minimum(sizes[right], sizes[i]) / np.maximum(np.maximum(sizes[right], sizes[i]), 1) >= least
            near = np.flatnonzero((agree >= AGREE) & fits & (label[right] != label[i]))
            for j in right[near[np.argsort(-agree[near], kind="stable")]].tolist():
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both / (sizes[i] + sizes[j] - both) >= least:
                    links.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a > b) of nodes whose fingerprints differ in at most two bits, enough of them to connect all such nodes: by the least node of each fingerprint."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    same = nodes.join(least.filter("n > 1"), "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    one, two = (least.select(F.col("fp").alias(n), F.col("least").alias(f"{n}_node")) for n in "ab")
    near = near_links(nodes.select("fp")).join(one, "a").join(two, "b").select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    return same.unionByName(near).filter("a > b")


def _tiles(rows: DataFrame, sets: DataFrame, keys: list[str], least: float) -> DataFrame:
    return rows.join(sets, "node").select(*keys, "node", "root", "side", "sig", "hashes").groupBy(*keys).applyInArrow(_compare(least), "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, bucket: int = 32, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Classes of documents whose shingle sets have a Jaccard similarity of ``least`` or more, and all that such links connect.

    ``docs`` holds doc_id and text. Returns its rows with node (hash of the shingle set) and mark (hash of id and text),
    and a table (node, root, best) with one row per different set: root names the class, best is the class's first row
    as (no id, doc_id, mark, node). Texts without words are one class. Equal sets are one node, whatever their number.

    Candidates have SimHash fingerprints within two bits, as op2 finds them, or share a band, which most sets of that
    similarity do whose fingerprints are further apart. Bands of up to ``bucket`` sets give pairs. Larger ones give no pairs: their sets meet in
    blocks of ``block``, each in the largest band it is in; then, in every band that is still of several classes, the
    sets outside the largest class meet all others, tile by tile. A pair in one class already is not compared.
    """
    made = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", node long, sig binary, keys array<long>, fp long"
    marked = materialise(made.mapInArrow(_mark(words), schema), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "node")
    nodes = materialise(marked.groupBy("node").agg(F.min(first).alias("first"), F.first("keys").alias("keys"), F.min("fp").alias("fp")), "nodes")

    keyed = nodes.select("node", F.posexplode("keys").alias("slot", "key"))
    stats = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(keyed.join(stats, ["slot", "key"]), "bands")
    small = met.filter(F.col("n") <= bucket).groupBy("slot", "key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    pairs = small.select(F.explode(F.expr("flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> named_struct('a', y, 'b', x))))")).alias("p")).select("p.a", "p.b")
    pairs = materialise(pairs.unionByName(fingerprint_pairs(nodes.filter("size(keys) > 0"))).distinct(), "pairs")
    hot = met.filter(F.col("n") > bucket)

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()
    asked = nodes.join(asked, "node", "left_semi").select("node", F.col("first.mark").alias("mark"))
    texts = marked.join(asked, ["node", "mark"], "left_semi").select("node", "mark", "text", "sig")
    sets = materialise(texts.mapInArrow(_sets(words), "node long, mark long, sig binary, hashes array<long>").dropDuplicates(["node", "mark"]), "sets").drop("mark")

    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_set")) for n in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    checked = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sum"))
    links = checked.filter(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b")

    own = hot.groupBy("node").agg(F.max(F.struct("n", "slot", "key")).alias("k")).select("node", "k.slot", "k.key")
    own = own.join(own.groupBy("slot", "key").agg(F.count("*").alias("m")), ["slot", "key"])
    own = own.withColumn("part", F.expr(f"pmod(xxhash64(node), ceil(m / {block}))")).withColumn("root", F.col("node")).withColumn("side", F.lit(2))
    links = materialise(links.unionByName(_tiles(own, sets, ["slot", "key", "part"], least)), "near")

    roots = connected_components(links)
    members = materialise(hot.join(roots, "node", "left").select("node", "slot", "key", F.coalesce("root", "node").alias("root")), "members")
    held = members.groupBy("slot", "key", "root").agg(F.count("*").alias("c")).groupBy("slot", "key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    open_ = members.join(held.select("slot", "key", F.col("main.root").alias("main"), F.expr(f"ceil((n - main.c) / {block})").alias("left"), F.expr(f"ceil(n / {block})").alias("right")), ["slot", "key"])
    at = F.xxhash64("node", F.lit(1))
    lefts = open_.filter("root <> main").select("slot", "key", "node", "root", F.lit(0).alias("side"), F.pmod(at, "left").alias("i"), F.explode(F.expr("sequence(0L, right - 1)")).alias("j"))
    rights = open_.select("slot", "key", "node", "root", F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, left - 1)")).alias("i"), F.pmod(at, "right").alias("j"))
    more = materialise(_tiles(lefts.unionByName(rights), sets, ["slot", "key", "i", "j"], least), "more")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))

    classes = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    best = classes.groupBy("root").agg(F.min("first").alias("best"))
    return marked.drop("sig", "keys", "fp"), classes.join(best, "root").select("node", "root", "best")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, by id with nulls last, ties by a hash of id and text; repeated rows once."""
    marked, classes = near_copies(docs, words, least)
    best = classes.select("best.node", "best.mark").distinct()
    return marked.join(best, ["node", "mark"], "left_semi").dropDuplicates(["node", "mark"]).select(*docs.columns)
