"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

#: Entries that a worker remembers before it starts anew, and bytes of the longest word that it remembers; both bound its memory.
MEMO, MEMO_BYTES = 250_000, 64
#: Entries of one of a memo's two generations.
GENERATION = 200_000

#: Words for which normaliser and splitter are the identity but for lower case: printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Whether the machine's unsigned int is that of the file format.
_U4 = array("I").itemsize == 4 and sys.byteorder == "little"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    if _U4:
        return array("I", ids).tobytes()  # several times faster on a few ids
    return np.array(ids, "<u4").tobytes()


class _Memo(dict):
    """Values by key in two generations: a full one becomes the old one, from which only what is asked for again moves on."""

    def __init__(self, make, generation: int = GENERATION):
        self.make, self.generation = make, generation
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_BYTES:
            if len(self) >= self.generation:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordVocabulary:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit integers.

    The vocabulary's normaliser and splitter never look across ASCII white space, so a text is the sequence of its
    words. Words that both leave alone but for lower case go to the library's model piece by piece; all others,
    and words that may hold a special token, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.words, self.pieces = _Memo(self._word), _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        # of printable ASCII each byte stands for itself
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
        return packed([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one piece
            return self.pieces[word.lower().decode()]
        text = word.decode()
        if "<|" not in text and _PLAIN.match(text):
            pieces = _PIECES.findall(text.lower())
            return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


_loaded: dict[str, WordVocabulary] = {}


def word_vocabulary(path: str) -> WordVocabulary:
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = WordVocabulary(path)
    return _loaded[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
