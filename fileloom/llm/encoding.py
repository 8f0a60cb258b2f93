"""Tokenizer encoding with a cache of words.

The ids are always the library's own. A text of plain Latin characters is cut into words, numbers and runs of signs
whose ids don't depend on their neighbours, and each distinct piece is encoded once per worker; any other text (other
scripts, unusual white space, special tokens) goes to the library whole. The cache is emptied when it is full, so a
worker's memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from struct import pack

import numpy as np

from fileloom.llm.common import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_L = "A-Za-zÀ-ÖØ-öø-ɏªµº"  # letters of the plain range
_N = "0-9²³¹¼-¾"  # its digits and numbers
PLAIN = re.compile("[\n\x20-\x7e¡-įı-ɏ]*")
#: Quotes beside which a piece's ids could depend on what stands there.
QUOTED = re.compile(" '|'[A-ZÀ-ɏ]")
PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}\\s]+|[ \n]")
FORMATS = {code: [f"<{n}{code}" for n in range(64)] for code in "HI"}


def odd(x: str) -> bool:
    """Whether a piece's ids could depend on what stands beside it. Plain searches are twice as fast as one pattern."""
    return "  " in x or " \n" in x or "\n " in x or "\n\n\n" in x or x.endswith("\n\n") or ("'" in x and QUOTED.search(x) is not None)


def byte_letters() -> dict[int, str]:
    """How byte-level models write the bytes that aren't printable ASCII: the others in order, from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Known(dict):
    """Ids of pieces met; a new one is looked for among those kept before, then learned."""

    def __init__(self, learn: Callable[[str], bytes], old: dict[str, bytes]):
        self.learn, self.old = learn, old

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        self[piece] = found = self.learn(piece) if found is None else found
        return found


class CachedEncoder:
    """Encodes texts to little-endian ids of ``dtype``, as bytes.

    Two generations of at most about ``limit`` pieces are kept: when the young one is full it becomes the old one, and what
    is met again in the old one moves to the young, so frequent words stay.
    """

    def __init__(self, tokenizer_path: str, limit: int = 220_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        self.limit, self.letters, self.model = limit, byte_letters(), self.tokenizer.model
        # A lone word can go to the library's model directly, in the form that its pre-tokenizer would give it.
        self.form = next((f for f in (self._spaced, self._lowered) if all(self._by_model(f, w) == self._by_library(w) for w in (" hello", " The", " Größe", " été", " thntti", " Ángel", " ŷñ"))), None)
        self.known = Known(self._learn, {})

    def _by_library(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _spaced(self, word: str) -> str:
        return "\u0120" + word[1:] if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _lowered(self, word: str) -> str:
        word = word[1:].lower()
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _by_model(self, form: Callable[[str], str], word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(form(word))]
        return pack(FORMATS[self.code][len(ids)], *ids) if len(ids) < 64 else np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, piece: str) -> bytes:
        return self._by_model(self.form, piece) if piece[0] == " " and piece[1:].isalpha() and self.form is not None else self._by_library(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for x in texts:
            if PLAIN.fullmatch(x) and not odd(x) and not self.special.search(x):
                out.append(b"".join(map(self.known.__getitem__, PIECES.findall(x))))
            else:
                out.append(self._by_library(x))
            if len(self.known) > self.limit:
                self.known.old = {}
                self.known = Known(self._learn, self.known)
        return out


_encoders: dict[str, CachedEncoder] = {}
CACHES.append(_encoders.clear)


def encoder(tokenizer_path: str) -> CachedEncoder:
    """This worker's encoder."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = CachedEncoder(tokenizer_path)
    return _encoders[tokenizer_path]
