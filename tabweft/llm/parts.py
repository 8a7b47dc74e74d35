"""Texts as parts that start at single spaces, which vocabularies with a mark for the space encode independently.

A part is a space with what follows up to the next space. It ends where the next one starts whatever the neighbours
are, if every space is followed by a character other than white space. Texts for which this does not hold
are *odd* and go through the library whole. New parts of many texts are encoded in one call of the library and told
apart by the tokens that start with a space; each distinct part is encoded once per worker while it is remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np

from tabweft.llm.bpe import split_pattern
from tabweft.llm.vocabulary import GENERATION, MEMO_BYTES, byte_symbols, packed

#: A space that white space or the end follows.
_ODD = re.compile(rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
#: Bytes of new parts for one call of the library; bounds its memory.
CALL_BYTES = 1 << 17


def odd(text: bytes) -> bool:
    return _ODD.search(text) is not None


class Remembered:
    """Values by part in two generations; a full one becomes the old one, from which only what is asked for again moves on."""

    def __init__(self, make: Callable[[list[bytes]], list], generation: int = GENERATION):
        self.make, self.generation = make, generation
        self.now: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.brief: list[bytes] = []

    def hold(self, wanted: set[bytes]) -> dict[bytes, object]:
        """A dictionary with a value for every wanted part, until the next call."""
        for part in self.brief:
            del self.now[part]
        if len(self.now) > self.generation:
            self.old, self.now = self.now, {}
        new = []
        for part in wanted.difference(self.now):
            value = self.old.get(part)
            if value is None:
                new.append(part)
            else:
                self.now[part] = value
        self.brief = [p for p in new if len(p) > MEMO_BYTES]
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size < CALL_BYTES:
                size += len(new[end]) + 1
                end += 1
            self.now.update(zip(new[at:end], self.make(new[at:end]), strict=True))
            at = end
        return self.now


class ByteVocabulary:
    """A byte-level vocabulary file of the tokenizers library. ``plain``: strings of special tokens are ordinary text.

    A merge's rank is the id of what it makes, if the file numbers its merges in order; then tiktoken, which merges by
    rank, gives the library's ids several times faster. Texts with a special token go through the library.
    """

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = split_pattern(spec)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.specials = [] if plain else list(special.values())
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.token_bytes: list[bytes] = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, i in chain(((t, i) for t, i in ranks.items()), ((t, i) for i, t in special.items())):
            self.token_bytes[i] = token
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        self.spaced = np.fromiter((t[:1] == b" " for t in self.token_bytes), bool, len(self.token_bytes))
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        in_order = all(x < y for x, y in pairwise(made)) and len(made) + 256 == len(ranks)
        self.engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        return np.frombuffer(self.packed(text), "<u4")

    def packed(self, text: bytes) -> bytes:
        """Ids of a text as bytes, little-endian."""
        if self.engine is None or any(s in text for s in self.specials):
            return packed(self.library.encode(text.decode(), add_special_tokens=False).ids)
        return packed(self.engine.encode_ordinary(text.decode()))


_loaded: dict[tuple[str, bool], ByteVocabulary] = {}


def byte_vocabulary(path: str, plain: bool = False) -> ByteVocabulary:
    """The vocabulary at ``path``, loaded once per worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = ByteVocabulary(path, plain)
    return _loaded[path, plain]


def runs_of(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about ``size`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > size:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
