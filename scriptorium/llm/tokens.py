"""Token ids of whole texts, equal to the tokenizers library's, through a cache of words.

Both vocabularies used here split a text into words by a pattern before any merge, and no merge crosses a word.
So the ids of a text are those of its words in order, and each distinct word needs the library once.  Splitting
is done by Python's ``re`` with explicit character classes, for texts made only of characters whose class is
known; any other text goes to the library whole, and so does one that holds a special token's string, which the library
as loaded gives that token's id.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

#: Characters that the fast way knows: Latin, general punctuation and currency signs.  U+0130 has a lower case of two
#: characters and goes the slow way.
_KNOWN = [chr(c) for lo, hi in ((0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for c in range(lo, hi) if c != 0x130]
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def _class(characters: list[str] | str) -> str:
    """A character class, by ranges, without its brackets."""
    codes, out, k = sorted(map(ord, characters)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[k]:08x}" + (f"-\\U{codes[j]:08x}" if j > k else ""))
        k = j + 1
    return "".join(out)


_L = _class([c for c in _KNOWN if unicodedata.category(c)[0] == "L"])
_N = _class([c for c in _KNOWN if unicodedata.category(c)[0] == "N"])
_S = _class(_SPACES)
#: What sends a text the slow way, by whether it is lowered first: then characters whose lower case is not known, too.
_SLOW = {lowered: re.compile(f"[^{_class([c for c in _KNOWN if not lowered or c.lower() in _KNOWN])}]") for lowered in (False, True)}

#: How each vocabulary splits a text into words.
_SPLIT = {
    "byte_bpe_50k.json": re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word_bpe_49k.json": re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+"),
}
_LOWERED = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}

#: The printable stand-in of each byte in both vocabularies (bytes without one take U+0100 and on, in order).
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: (b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}


class _Words(dict):
    """word -> its ids as bytes; a word not held yet is given to the library's model."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.tokenize, self.limit = model.tokenize, limit

    def __missing__(self, word: str) -> bytes:
        found = self.tokenize(word.encode().decode("latin-1").translate(_BYTES))
        ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts with a vocabulary file.

    path: the vocabulary file.  cache_words: at so many cached words the cache starts anew.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = [x.content for x in self.library.get_added_tokens_decoder().values()]
        name = os.path.basename(path)
        self.split, self.lowered = _SPLIT.get(name), _LOWERED.get(name, False)
        self.slow = _SLOW[self.lowered]
        self.words = _Words(self.library.model, cache_words)

    def vocabulary_size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        plain = text.lower() if self.lowered else text
        if self.split is None or self.slow.search(text) or any(x in text or x in plain for x in self.whole):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = self.split.findall(plain)
        return b"".join(map(self.words.__getitem__, found))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
