"""Texts cut into the pieces that a tokenizer encodes one by one, exactly as the tokenizers library cuts them.

Almost every text goes through one regular expression of Python; a text that the library may see otherwise (see ``plain``)
goes through the library's own normalizer and pre-tokenizer."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

#: The pre-token pattern of the tokenizers that the fast path serves (a fixed value, from the tokenizer's file), and the
#: same for Python's re on texts without odd characters, where the two differ.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
ODD = "\x1c\x1d\x1e\x1f\u03a3\u0130"


def odd(c: str) -> bool:
    """A character that Python may hold for something else than the library does: one that Python's Unicode has not assigned
    (the library's may be newer), a numeral that is no decimal digit, a separator that only Python counts as blank, the letter
    whose lower case depends on its place, or the one that becomes two characters."""
    return c in ODD or unicodedata.category(c) in ("Cn", "Nl", "No")


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies (a fixed rule of that format): printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Cutter:
    """Pieces of texts for the tokenizer in a file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.told = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.told["added_tokens"]}
        self.among = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        patterns = [p["pattern"].get("Regex") for p in (self.told.get("pre_tokenizer") or {}).get("pretokenizers", ()) if p["type"] == "Split"]
        steps = [n["type"] for n in (self.told.get("normalizer") or {}).get("normalizers", ())]
        self.fast = patterns == [PATTERN] and steps == ["NFC", "Replace", "Lowercase"]
        self.fine: set[str] = set()

    def plain(self, text: str) -> bool:
        """Python's expression cuts this text as the library does."""
        if not self.fast or any(x in text for x in self.special):
            return False
        new = set(text) - self.fine
        if any(map(odd, new)):
            return False
        self.fine |= new
        return text.isascii() or unicodedata.is_normalized("NFC", text)

    def words(self, text: str) -> list[str]:
        """Of a plain text: what stands between blanks, which no piece holds. Each of them can be cut by itself."""
        return text.lower().split()

    def cut(self, word: str) -> list[str]:
        return PIECE.findall(word)

    def cut_any(self, text: str) -> list[bytes | int]:
        """Of any text, by the library: pieces as bytes, special tokens as their ids."""
        out: list[bytes | int] = []
        for at, part in enumerate(self.among.split(text) if self.among else [text]):
            if at % 2:
                out.append(self.special[part])
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                out += [bytes(map(byte_letters().__getitem__, piece)) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out
