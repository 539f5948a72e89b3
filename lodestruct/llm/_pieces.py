"""Splitting plain texts into the pieces that a tokenizer file's own rules give, so that each piece is tokenized once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

from ._common import byte_letters

#: Texts of these characters are split by the expressions below exactly as the tokenizers split them: no character
#: changes under NFC, lower case is one to one, and letters, digits and spaces are those named.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: The rules, as they stand in tokenizer files, that these expressions are equal to.
BYTE_RULES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: The character that stands for each byte in a byte-level vocabulary.
LETTERS = byte_letters()
#: Pieces whose tokens a task remembers, twice over.
CACHE = 400_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pieces of a text, or None where the tokenizer must see it whole: other characters, special strings, or a file with other rules."""

    def __init__(self, tok) -> None:
        rules = json.loads(tok.to_str())
        own = (rules["normalizer"], rules["pre_tokenizer"]) if rules["post_processor"] is None and rules["truncation"] is None and rules["padding"] is None else None
        self.lower = own == WORD_RULES
        self.expression = WORD_PIECES if self.lower else BYTE_PIECES if own == BYTE_RULES else None
        self.special = [t["content"].lower() if self.lower else t["content"] for t in rules["added_tokens"]]

    def pieces(self, text: str) -> list[str] | None:
        if self.expression is None or not PLAIN.fullmatch(text):
            return None
        if self.lower:
            text = text.lower()
        return None if any(s in text for s in self.special) else self.expression.findall(text)


def letters(piece: str) -> str:
    return "".join([LETTERS[b] for b in piece.encode()])


class Memo(dict):
    """What ``make`` gives for each piece, remembered for the last and the last but one CACHE of them."""

    def __init__(self, make: Callable[[str], object], older: dict | None = None) -> None:
        self.make, self.older = make, older or {}

    def __missing__(self, piece: str) -> object:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found

    def turned(self) -> Memo:
        """Itself, or a new one that knows it as the older one if it is full."""
        if len(self) <= CACHE:
            return self
        self.older = {}
        return Memo(self.make, self)
