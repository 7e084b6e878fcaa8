"""Token ids of whole texts from a public tokenizer, inside a task.

A text is cut at ASCII white space, which this kind of tokenizer drops and never
reads across, so a text's ids are those of its chunks in a row. Chunks repeat a
great deal, so their ids are remembered. A new chunk of plain Latin letters, digits
and signs is cut into words as the tokenizer cuts it; words are remembered too, and
only a new word goes through the byte-pair merges. Any other chunk is given to the
tokenizer as it is.
"""

from __future__ import annotations

import re
import struct

import regex

# Entries that a memory takes before it starts anew; as many older ones stay.
REMEMBERED = 250_000
# Longer chunks hardly repeat.
LONGEST_REMEMBERED = 64

ID_BYTES = 4

# The tokenizer's pattern of words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same on ASCII text in lower case, where it is faster.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
# Characters that the tokenizer's normalizer changes in no way but to lower case.
_PLAIN = regex.compile(r"[\x21-\x7EÀ-ÿ]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memory(dict):
    """A dict that works out missing values and forgets those long unused."""

    def __init__(self, work_out):
        self._work_out = work_out
        self._older: dict = {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._work_out(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _PACKERS[n](*ids) if n < len(_PACKERS) else struct.pack(f"<{n}I", *ids)


class TextIds:
    """Texts -> ids as little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merge = tokenizer.model.tokenize
        characters = _byte_characters()

        def word_ids(word: str) -> bytes:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(characters)
            return _packed([token.id for token in merge(word)])

        plain, cut, cut_ascii = _PLAIN.fullmatch, _WORDS.findall, _ASCII_WORDS.findall
        words = _Memory(word_ids).__getitem__
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def chunk_ids(chunk: bytes) -> bytes:
            text = chunk.decode()
            in_ascii = text.isascii()
            if text.isprintable() if in_ascii else plain(text):
                if text.isalpha():
                    return words(text.lower())
                if not any(s in text for s in specials):
                    return b"".join(map(words, (cut_ascii if in_ascii else cut)(text.lower())))
            return _packed(tokenizer.encode(text, add_special_tokens=False).ids)

        self._chunk = _Memory(chunk_ids).__getitem__

    def of_text(self, text: str | None) -> bytes:
        """All ids of a text; none for null or an empty text."""
        return b"".join(map(self._chunk, (text or "").encode().split()))
