"""Grouping of spelling variants: words one edit apart found by asymmetric q-chunks, and the frequent form each goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, batches, materialise, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One of so many runs of a document loses a code point, as the contract of the query asks.
SLIPS = 97
#: Words that a task counts before it passes their counts on.
HELD = 1 << 18
#: Words that share a chunk in one role, at most, before the rest of the word is cut into chunks too.
CROWD = 32


def slipped(doc_id: object, run: str) -> str:
    """The run as the corpus has it, or, where the checksum of document and run is divisible by SLIPS, without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % SLIPS else run[:at] + run[at + 1 :]


def _count(change) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches(it):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # lower-casing UTF-8 bytes changes A-Z alone
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    held[change(doc_id, word)] += n
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return run


def word_counts(docs: DataFrame, change=lambda doc_id, run: run, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences, for words of at least ``min_chars`` code points and ``min_count`` occurrences.

    A word is a maximal run of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, as ``change(doc_id, run)``
    gives it. Null and empty texts have none; rows of equal id are counted each. Each task adds up what it has seen
    before the shuffle, so a word in every document is one row a task. Other columns are not read.
    """
    found = docs.filter("text is not null").select("doc_id", "text").mapInArrow(_count(change), "word string, n long")
    return found.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _windows(roles: DataFrame) -> DataFrame:
    """Roles (word, long, m, lo, hi) whose window is cut in two: each chunk of it joins what is known to be equal, the other is the window left.

    ``m`` is the length of the shorter word of a pair, whose chunks lie at fixed places; in a longer word (``long`` is 1)
    what follows the window stands one further. All but the window is the key, so each half of the old window that
    becomes part of the key is a q-chunk of the shorter word, or the positional gram of the longer one within shift one.
    """
    mid = F.expr("(lo + hi) div 2")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))))
    return roles.withColumn("w", halves).select("word", "long", "m", "w.lo", "w.hi").filter("lo < hi")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): all pairs of different words, in both orders, that differ by exactly one inserted, deleted or replaced code point.

    ``words`` has unique words in column ``word``; other columns are not read; no words, no pairs. Of a pair, the shorter word
    (either, if equally long) gives two disjoint chunks, its halves, and the other one its positional grams; one edit leaves
    one chunk whole, at the same place or, behind an insertion, one place on, so words meet on (length, place, chunk): of
    all grams only those at a shift that can belong to a chunk are made. A pair that meets is verified. Where more than
    ``crowd`` words of a role share a chunk, they are not paired: the edit lies in the rest of the word, which is cut into two
    chunks again, until few words meet or the rest is one code point. So no common chunk, whatever its number of words,
    is paired within itself.
    """
    base = words.select("word", F.char_length("word").alias("m"))
    roles = base.select("word", F.lit(0).alias("long"), "m").unionByName(base.filter("m > 1").select("word", F.lit(1).alias("long"), (F.col("m") - 1).alias("m")))
    open_ = roles.withColumns({"lo": F.lit(0), "hi": F.col("m")})
    pairs, last = None, False
    while not last:
        cut = _windows(open_)
        head, tail = F.expr("left(word, lo)"), F.expr("substring(word, hi + long + 1)")
        keyed = materialise(cut.withColumns({"head": head, "tail": tail}), "chunks")
        keys = ["m", "lo", "hi", "head", "tail"]
        crowds = keyed.groupBy(*keys).agg(F.count("*").alias("words"), F.sum("long").alias("longer"), F.max(F.col("hi") - F.col("lo")).alias("width")).filter("words > 1 and words > longer")
        met = materialise(keyed.join(crowds, keys), "met")
        full = (F.col("words") > crowd) & (F.col("width") > 1)
        few = met.filter(~full)
        short = few.filter("long = 0").select(*keys, F.col("word").alias("a"))
        other = few.select(*keys, F.col("word").alias("b"), F.col("long"))
        found = short.join(other, keys).filter("long = 1 or a < b").filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        open_ = met.filter(full).select("word", "long", "m", "lo", "hi")
        last = open_.isEmpty()
    pairs = materialise(pairs.distinct(), "near_words")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variant_forms(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for unique words with their counts (word, n).

    ``n_near`` is the number of words one edit away; ``form`` the most frequent of them (ties: the first in code-point order)
    if it occurs at least ``factor`` times as often, else null; ``root`` where the forms lead in the end, the word itself
    without a form. Counts grow by ``factor`` (2 or more) with every step, so chains end and are followed by doubling.
    Null words are left out; no words, no rows.
    """
    words = materialise(words.filter("word is not null").select("word", "n"), "words")
    near = near_words(words)
    best = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("first")
    )
    linked = words.join(best, words.word == best.a, "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("first.form").alias("form"), (-F.col("first.less")).alias("form_n"))
    enough = F.col("form_n") >= factor * F.col("n")
    linked = materialise(linked.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}), "forms")
    chain = linked.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("at"), F.col("root").alias("next"))
        chain = materialise(chain.join(on, chain.root == on["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if chain.filter("moved").isEmpty():
            break
        chain = chain.drop("moved")
    return linked.join(chain.select("word", "root"), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(word_counts(table(spark, sf_dir, "documents"), slipped))


# the checksum by a table of 256 entries, made from its rule; pairs through the texts left by each deletion
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY x) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS x)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY ALL
), bytes AS (
  SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS b FROM runs
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) AS h FROM bytes, crc
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {SLIPS} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), d AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word
), best AS (
  SELECT a, count(*) AS n_near, min(struct_pack(less := -n, form := b)) AS f FROM near JOIN w ON w.word = b GROUP BY a
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.less >= 2 * n THEN f.form END AS form, CASE WHEN -f.less >= 2 * n THEN -f.less END AS form_n
  FROM w LEFT JOIN best ON a = word
), walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next
)
SELECT word, forms.form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk USING (word) WHERE walk.next IS NULL
"""
