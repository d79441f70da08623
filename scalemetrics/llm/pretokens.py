"""Token ids of white-space separated chunks, from a table of chunks already seen.

Splitting at white space is safe for the two tokenizers used: no pre-token spans a space that
follows a word. A chunk of plain Latin letters, digits and ASCII signs goes straight to the BPE
model; every other chunk, and every text with white space or special strings that this module
does not treat itself, goes through the whole library tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Lower-case Latin letters that lower-casing and NFC leave alone, and their capitals.
LOWER = "a-zß-öø-ÿ"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = "!-&(-/:-@\\[-`{-~"  # ASCII signs without the apostrophe, which starts contractions

# Unicode white space beyond the ASCII kind, control separators and the special strings' start
UNUSUAL = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf|<\|"
)

# Every byte that cannot begin a match of UNUSUAL. Taking them out leaves nothing of most texts, and costs a fiftieth of the search.
PLAIN = bytes(b for b in range(256) if not (0x1C <= b <= 0x1F or b in b"<\xc2\xe1\xe2\xe3\xef"))
SIGN_BYTES = re.compile(f"[{SIGNS}]".encode())


def is_unusual(text: bytes) -> bool:
    """Whether UNUSUAL is found in a text."""
    return bool(text.translate(None, PLAIN)) and UNUSUAL.search(text) is not None


def byte_chars() -> dict[int, str]:
    """Printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class Memo(dict):
    """Bounded memo: a full one starts again from what it was given first."""

    def __init__(self, fill: Callable[[bytes], object], bound: int, first: dict[bytes, object] | None = None) -> None:
        super().__init__(first or {})
        self.fill, self.bound, self.first = fill, bound, first or {}

    def __missing__(self, key: bytes) -> object:
        if len(self) >= self.bound + len(self.first):
            self.clear()
            self.update(self.first)
        value = self.fill(key)
        if len(key) <= 64:  # so that the bound on entries is one on bytes
            self[key] = value
        return value


class ChunkEncoder:
    """Ids of one chunk. ``cased``: byte-level vocabulary with leading spaces; else lower case with word ends."""

    def __init__(self, tokenizer_json: str, cased: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.cased, self.chars = self.tokenizer.model, cased, byte_chars()
        if cased:
            self.parts = re.compile(f" ?[{LETTER}]+| ?[0-9]+| ?[{SIGNS}]+|\\n(?=[^\\s])")
        else:
            self.parts = re.compile(f"[{LOWER}]+|[0-9]|[{SIGNS}]+")
        self.memo: dict[str, list[int]] = Memo(self.part_ids, 200_000)

    def part_ids(self, part: str) -> list[int]:
        # printable ASCII characters stand for themselves
        known = part if part.isascii() and part.isalnum() else "".join(map(self.chars.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(known)]

    def whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def chunk(self, chunk: bytes) -> list[int]:
        if not self.cased:  # a word, or a word and a sign: its ids serve both
            word = chunk if chunk.isalpha() else chunk[:-1]
            if word.isalpha() and word.islower():
                if word is chunk:
                    return self.memo[word.decode()]
                if SIGN_BYTES.match(chunk, len(word)):
                    return self.memo[word.decode()] + self.memo[chr(chunk[-1])]
        text = chunk.decode("utf-8", "replace")
        parts = self.parts.findall(text)
        if sum(map(len, parts)) != len(text):  # a character of another kind
            return self.whole(chunk)
        if len(parts) == 1:
            return self.part_ids(parts[0])
        return [i for p in parts for i in self.memo[p]]
