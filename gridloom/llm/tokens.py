"""Token ids of whole texts by the tokenizers library, memoised by piece.

Both public tokenizers first split a text into pieces by a fixed pattern and then encode each piece
alone, so a piece's ids can be kept. The split is done here only for texts of plain Latin
characters, where the classes below equal the pattern's; any other text, and one that may hold
a special token, goes to the library whole. So the ids are always the library's.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the two tokenizers' split patterns, for characters of PLAIN.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼½¾"
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-įı-ňŊ-ſ]*")
SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(f"{SUFFIX}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")
WORD_PIECES = re.compile(f"{SUFFIX}|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")


# Normaliser and splitter of the two tokenizers (fixed values); any other tokenizer is left to the library. On
# characters of PLAIN, NFC changes nothing and white space is not part of a piece.
BYTE_SPEC = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_SPEC = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves,
    the others follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class _Memo(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; emptied when it holds ``most``.
    A piece goes to the tokenizer's model alone: normalising and splitting are done."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.model, self.most = tokenizer.model, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))
        self[piece] = ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class Encoder:
    """``encode(text)``: ids of a whole text as little-endian unsigned 32-bit integers (null: none)."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, self.lower, self.pieces = spec["pre_tokenizer"], False, None
        if spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]:
            if (spec["normalizer"], pre) == BYTE_SPEC:
                self.pieces = BYTE_PIECES
            elif (spec["normalizer"], pre) == WORD_SPEC:
                self.pieces, self.lower = WORD_PIECES, True
        self.memo = _Memo(self.tokenizer, most)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or not PLAIN.fullmatch(text) or ("<" in text and any(s in text for s in self.special)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, self.pieces.findall(text.lower() if self.lower else text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker and path."""
    return Encoder(path)
