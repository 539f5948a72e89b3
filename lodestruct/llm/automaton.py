"""BPE encoding and decoding by a deterministic automaton over tokens, compiled from the merges of a tokenizer file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batches, table, values
from ._pieces import LETTERS, WORD_RULES, Memo, Splitter, letters, tokenizer

#: Longer pieces are encoded each time, not remembered; longer texts are pre-split in parts that end at spaces.
REMEMBERED, PART = 64, 1 << 16
#: Transitions that are remembered; the table starts anew beyond.
TRANSITIONS = 1 << 20
#: Stands for the suffix that marks the end of a word.
MARK = "\ue000"


class Automaton:
    """Accepts exactly the token sequences that BPE gives, and so has one path for each word.

    It starts as one state with an arc for each basic token that leads back to it. Each merge (a, b) -> ab, in order, adds
    its gadget: where an arc a leads to a state with an arc b, an arc ab bypasses the two, and the state after a loses its
    arc b, in a copy of its own if other arcs lead to the state too. All arcs of one token lead to the same state, before
    and after every gadget, so ``after[token]`` is the target. ``ab`` may stand wherever ``a`` may at that time, so its
    column of the transition table is a's column so far; a copy's row is the row copied. Both are kept as such references
    with the merge they date from, and a cell is looked up through them once (``arc``) and remembered.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str | None = None) -> None:
        self.suffix = suffix
        size = max(vocabulary.values(), default=-1) + 1
        self.after, self.cleared, self.copied = [0] * size, [{}], [(-1, -1)]
        self.left, self.made, self.table = [-1] * size, [-1] * size, {}
        entered, self.lost, self.lineage = {0: size}, set(), None
        for k, (one, two) in enumerate(merges):
            a, b, c = vocabulary[one], vocabulary[two], vocabulary[one + two]
            if a in self.lost or b in self.lost or not self._open(self.after[a], b):
                self.lost.add(c)  # the pair never stands side by side at this point, so the merge never happens
                continue
            old = self.after[a]
            self.left[c], self.made[c] = a, k
            entered[self.after[c]] -= 1
            self.after[c] = old if a == b else self.after[b]
            entered[self.after[c]] += 1
            if entered[old] > 1:
                self.cleared.append({})
                self.copied.append((old, k))
                self.after[a] = len(self.copied) - 1
                entered[old] -= 1
                entered[self.after[a]] = 1
            self.cleared[self.after[a]][b] = k
        self.lineage = {}  # of states, from here on fixed
        #: Every prefix of a token's spelling, with the token that ends there or -1.
        self.spelled: dict[str, int] = {}
        for text, t in vocabulary.items():
            if t not in self.lost:
                text = self.marked(text)
                for n in range(1, len(text)):
                    self.spelled.setdefault(text[:n], -1)
                self.spelled[text] = t

    def marked(self, text: str) -> str:
        return text[: -len(self.suffix)] + MARK if self.suffix and text.endswith(self.suffix) else text

    def _rows(self, state: int) -> list[tuple[dict[int, int], int]]:
        """The arcs that a state has lost: its own, and those of the states it was copied from, up to the merge that copied it."""
        out, until = [], len(self.left) + 1
        while state >= 0:
            if self.cleared[state]:
                out.append((self.cleared[state], until))
            state, until = self.copied[state][0], min(until, self.copied[state][1])
        return out

    def _open(self, state: int, token: int) -> bool:
        rows = self._rows(state) if self.lineage is None else self.lineage.get(state)
        if rows is None:
            rows = self.lineage[state] = self._rows(state)
        alive = len(self.left) + 1
        while token >= 0:
            for cleared, until in rows:
                k = cleared.get(token)
                if k is not None and k <= alive and k <= until:
                    return False
            token, alive = self.left[token], self.made[token]
        return True

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``."""
        at = state << 32 | token
        found = self.table.get(at)
        if found is None:
            if len(self.table) >= TRANSITIONS:
                self.table.clear()
            found = self.table[at] = token not in self.lost and self._open(state, token)
        return found

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word in the vocabulary's letters.

        Every prefix of the word has one path, so a place is reached by one arc only and in one state. The longest token
        that the state allows is tried first; a place from which no arc leads on is left for good, so the time is linear.
        """
        if self.suffix and word:
            word += MARK
        n, spelled, table, after = len(word), self.spelled, self.table, self.after
        out, ends, tries = [], [], []
        i, state, ways = 0, 0, None
        while i < n:
            if ways is None:
                ways = []
                for j in range(i + 1, n + 1):
                    t = spelled.get(word[i:j])
                    if t is None:
                        break
                    if t >= 0:
                        ways.append((t, j))
            while ways:
                t, j = ways.pop()
                found = table.get(state << 32 | t)
                if self.arc(state, t) if found is None else found:
                    out.append(t)
                    ends.append(i)
                    tries.append(ways)
                    i, state, ways = j, after[t], None
                    break
            else:
                if not out:
                    raise ValueError("a letter that is not in the vocabulary")
                out.pop()
                i, ways = ends.pop(), tries.pop()
                state = after[out[-1]] if out else 0
        return out


class Coder:
    """Encodes and decodes texts as a BPE file says: its normalizer and splitting rules, then the automaton."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        rules = json.loads(self.tok.to_str())
        model = rules["model"]
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in rules["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or odd or rules["post_processor"] or (rules["decoder"] or {"type": "ByteLevel"})["type"] != "ByteLevel":
            raise ValueError(f"not a plain BPE file: {odd}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or None)
        self.split = Splitter(self.tok)
        self.spaced = (rules["normalizer"], rules["pre_tokenizer"]) == WORD_RULES
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in rules["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Memo(lambda piece: self._word(letters(piece)))
        self.spelt = Memo(self._word)
        # the label of every arc: letters for a file without a decoder, else bytes
        self.bytewise = rules["decoder"] is not None
        named = {**{v: k for k, v in model["vocab"].items()}, **{t["id"]: t["content"] for t in rules["added_tokens"]}}
        back = {c: b for b, c in enumerate(LETTERS)}
        self.labels = {t: (bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()) if self.bytewise else text for t, text in named.items()}

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.encode(word), "<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """The text, or parts of about PART characters that end at spaces, which no piece crosses under the word rules."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PART) + 1 if self.spaced else 0
            yield text[at : end or None]
            at = end or len(text)

    def _other(self, text: str) -> Iterator[bytes]:
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    yield self.spelt[piece] if len(piece) <= REMEMBERED else self._word(piece)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers."""
        out = bytearray()
        self.known, self.spelt = self.known.turned(), self.spelt.turned()
        for part in self._parts(text):
            pieces = self.split.pieces(part)
            if pieces is None:
                out += b"".join(self._other(part))
            else:
                out += b"".join([self.known[p] if len(p) <= REMEMBERED else self._word(letters(p)) for p in pieces])
        return bytes(out)

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs one after the other; ids that the file does not have say nothing."""
        found = map(self.labels.get, ids.tolist())
        if self.bytewise:
            return b"".join([x for x in found if x is not None]).decode("utf-8", "replace")
        return " ".join([x for x in found if x is not None])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """Compiled once in each worker process."""
    return Coder(path)


def _encode(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches(it):
            ids = [c.encode(t) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches(it):
            texts = [c.decode(np.frombuffer(i or b"", "<u4")) for i in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of every whole text by the automaton of the BPE file at ``path`` (word-end BPE by default).

    Returns (doc_id, n_tokens, ids), one row per row of ``docs``; ``ids`` are little-endian unsigned 32-bit numbers, as the
    tokenizer gives them without truncation, padding or added ends. Special strings inside a text are its special tokens.
    Null and empty texts have no tokens. Very long texts are encoded part by part, very long words in linear time.
    Repeated rows and ids are encoded each; other columns are neither read nor returned; an empty table gives an empty
    result. The file must lie at ``path`` on every executor. Nothing is shuffled.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode(path), f"doc_id {ids}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the labels of the ids' arcs, joined as the file's decoder joins them.

    A file without a decoder puts spaces between labels. Null or empty ids give an empty text; ids that the file does not
    have are passed over; special tokens stay. Repeated rows stay; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    ids = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path), f"doc_id {ids}, n_tokens long, ids binary, decoded string")


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
