"""Token ids of whole texts, by the words of a text: a word's ids are found once and kept.

The tokenizer splits at white space before anything else, so the ids of a text are those of its words in order."""

from __future__ import annotations

import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: The pre-tokenizer's pattern, as in the vocabulary file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile(r"[\x21-\x7e¡-ɏ]+")
#: Texts that can be lower-cased as a whole, and punctuation that is a piece of its own after a letter and before white space.
_COMMON, _CLOSING = re.compile(r"[\x00-\x7e¡-įı-ɏ]*"), re.compile(r"[.,;:!?](?<=[a-z].)(?=\s)")
#: Separators of Python's split() that the tokenizer doesn't take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words and pieces of them that a generation of the cache holds. A full one becomes the old one, from which what is met again is taken over.
MAX_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """ids(text): little-endian unsigned 32-bit token ids as bytes."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.whole.model.tokenize, byte_letters()
        self.names = [k.to_bytes(4, "little") for k in range(max(self.whole.get_vocab(with_added_tokens=True).values()) + 1)]
        self.known, self.old = {}, {}  # a piece by itself is a word of the same ids

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tokens(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join([self.names[t.id] for t in self.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece) or self.old.get(piece)
        return self._kept(piece, self._tokens(piece) if found is None else found)

    def _word(self, word: str) -> bytes:
        """A word with special tokens, rare scripts or combining marks goes to the tokenizer itself; the others are composed
        already, and their lower case depends on no neighbour."""
        if word.isascii() and word.isalpha():
            low = word.lower()
            return self._tokens(word) if low == word else self._piece(low)
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._encode(word)
        low = word.lower()
        if low.isalpha():
            return self._tokens(low) if low == word else self._piece(low)
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return self._piece(low[:-1]) + self._piece(low[-1])
        return b"".join(map(self._piece, _PIECES.findall(low)))

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self._encode(text)
        if _COMMON.fullmatch(text) and "<|" not in text:  # fewer different words: lower case, and closing punctuation apart
            text = _CLOSING.sub(r" \g<0>", text.lower())
        words = text.split()
        out = list(map(self.known.get, words))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    out[k] = self._met(words[k])
        return b"".join(out)

    def _met(self, word: str) -> bytes:
        """The ids of a word that is not among the latest ones."""
        found = self.known.get(word) or self.old.get(word)
        if found is None:
            if word.islower() and word.isascii() and word.isalpha():  # most of them: all that _word() would do
                names = self.names
                found = b"".join([names[t.id] for t in self.tokenize(word)])
            else:
                found = self._word(word)
        return self._kept(word, found)

    def _kept(self, word: str, found: bytes) -> bytes:
        if len(word) <= 40:
            if len(self.known) >= MAX_WORDS:
                self.known, self.old = {}, self.known
            self.known[word] = found
        return found
