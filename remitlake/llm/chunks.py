"""Cuts texts where no token of a space-splitting tokenizer can cross, so that chunks can be encoded once.

A cut lies at a single space between two characters that are no white space. Byte-level and
piece tokenizers attach such a space to what follows, and nothing joins what stands before it
to it; a text's ids are then those of its chunks, one after the other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_EDGES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "] + ["▁"]
# The split of byte-level BPE into words, written for printable ASCII, line breaks, Latin letters and common marks.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLAIN = re.compile(rf"[\t\n\r -~{_LATIN}‐-…]*\Z")


def _written() -> dict[int, int]:
    """How byte-level BPE writes bytes: visible ones as themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}


def _uneven(text: str) -> bool:
    """Whether a space of the text has white space or a mark beside it, or an end of the text is white space."""
    if text[0].isspace() or text[-1].isspace() or "  " in text:
        return True
    return any(c in text and (f" {c}" in text or f"{c} " in text) for c in _EDGES)


class ChunkCache:
    """Results of ``encode`` by chunk.

    Two generations bound the memory: a full one becomes the old one, and what is met again
    moves back, so that frequent chunks stay.
    """

    def __init__(self, encode: Callable[[list[str]], list], space: str = " ", limit: int = 250_000):
        """``space``: what chunks but the first start with when they are encoded; none if ``encode`` adds it."""
        self.encode, self.space, self.limit = encode, space, limit
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {} if space else self.first
        self.old: dict[str, object] = {}

    def _learn(self, seen: dict[str, object], met: set[str], prefix: str) -> None:
        missing = met.difference(seen)
        if prefix == self.space and self.old:
            known = [t for t in missing if t in self.old]
            seen.update((t, self.old[t]) for t in known)
            missing.difference_update(known)
        if missing:
            new = list(missing)
            seen.update(zip(new, self.encode([prefix + t for t in new] if prefix else new), strict=True))

    @staticmethod
    def cut(text: str) -> list[str]:
        return _CUT.split(text) if _uneven(text) else text.split(" ")

    def many(self, texts: list[str]) -> list[list]:
        """Results of each text's chunks, in order; an empty text has none."""
        cuts = [self.cut(t) if t else [] for t in texts]
        heads = [c.pop(0) if c else None for c in cuts]
        if len(self.first) > self.limit:
            self.first.clear()
        if len(self.later) > self.limit:
            self.old = dict(self.later)
            self.later.clear()
        self._learn(self.first, {h for h in heads if h is not None}, "")
        self._learn(self.later, set().union(*cuts), self.space)
        first, later = self.first, self.later.__getitem__
        return [[first[h], *map(later, c)] if h is not None else [] for h, c in zip(heads, cuts, strict=True)]


class _Words(dict):
    """Ids of single words of byte-level BPE, as bytes."""

    def __init__(self, model, code: str):
        self.model, self.code, self.written = model, code, _written()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            written = word.replace(" ", chr(self.written[32]))
        else:
            written = word.encode().decode("latin-1").translate(self.written)
        ids = self[word] = array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids


class ByteLevel:
    """Ids of texts, as bytes of ``width`` each, by a byte-level BPE of the tokenizers library.

    Chunks are encoded once. A plain chunk is split into words here, and the library's model
    encodes those; others, and texts that hold special tokens, go through the whole library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = tok = Tokenizer.from_file(path)
        self.width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.words = _Words(tok.model, self.code)
        self.cache = ChunkCache(self._chunks, limit=400_000)

    @staticmethod
    def fits(tok) -> bool:
        """Whether a tokenizer splits as this class does: byte-level, by words, with nothing before or in between."""
        pre = str(tok.pre_tokenizer)
        return tok.normalizer is None and pre.startswith("ByteLevel") and "add_prefix_space=False" in pre and "use_regex=True" in pre and type(tok.model).__name__ == "BPE"

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        words, find, plain = self.words, _WORD.findall, _PLAIN.match
        if len(words) > self.cache.limit:
            words.clear()
        get, other = words.__getitem__, [x for x in chunks if not plain(x)]
        held = dict(zip(other, self.whole(other), strict=True)) if other else {}
        return [held[x] if x in held else b"".join(map(get, find(x))) for x in chunks]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        even = list(texts)
        for i in odd:
            even[i] = ""
        out = [b"".join(x) for x in self.cache.many(even)]
        for i, x in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = x
        return out
