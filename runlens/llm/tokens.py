"""Whole texts to token ids with a public tokenizer file, in tasks.

A text is cut at single spaces and newlines between two characters that are not
white space. The pre-tokenizers of both supported kinds (byte-level with a
leading space, and words with white space dropped) always cut there, so the ids
of the parts, encoded alone, joined, are the ids of the whole text. Parts are
kept in a cache of two generations, each bounded by its bytes; ids come from the ``tokenizers``
library only. A part of plain letters is one pre-token, so the tokenizer's model
is asked for it directly, if probes show that it agrees with the whole tokenizer. Letters
and the signs behind them are cut apart too, if probes show that for these signs.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that some engine takes for white space, besides space and newline.
_EXOTIC = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎    　​﻿" + "".join(
    map(chr, range(0x2000, 0x200B)))
_SAFE = re.compile(rf"(?<=[^ \n{_EXOTIC}])(?=[ \n][^ \n{_EXOTIC}])")
_RUNS = ("  ", " \n", "\n ", "\n\n")
#: Bytes per generation of the cache, as a rule: a full one becomes the old one, which is asked once more before it goes.
CACHE = 80 << 20
#: What an entry takes besides its characters and ids: two objects and a place in the table.
ENTRY = 190
#: Different runs of signs behind words that are remembered.
TAILS = 10_000
#: Bytes of a generation of the cache per character of the texts that are encoded together (or one longer text).
GROUP = 20
#: Longer parts are not kept.
CACHED_CHARS = 64


#: Words that the model must encode as the tokenizer does before it is asked directly.
_SIGNED = re.compile(r"(\n?[^\W\d_]+)([^\w\s']+)")
PROBES = ("a", "I", "the", "The", "UPPER", "camelCase", "Überall", "straße", "élan", "ÉCOLE", "ñandú", "ciónes", "œuvre", "żółw", "xqzjvw" * 4)


def _byte_letters() -> str:
    """The letters by which byte-level models write the bytes 0 to 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class Encoder:
    """Parts are words behind a space, written without it, or behind a newline, written with it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        #: two bytes hold the ids of a vocabulary of up to 65,536
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._kind = "H" if self.dtype.itemsize == 2 else "I"
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._size, self.cache = 0, CACHE
        self._tails: dict[str, bytes | None] = {}
        self._model, self._letters, self._direct = self._tokenizer.model, _byte_letters(), None
        self._space = {"": "", " ": " ".translate(self._letters)}
        whole = self._ids([f" {w}" for w in PROBES])
        for form in ((" ", False), (" ", True), ("", False), ("", True)):
            if [self._of_model(w, *form) for w in PROBES] == whole:
                self._direct = form
                break
        #: what a newline before a word adds to the word's ids without a space, or None if it depends on the word
        self._line, lower = self._ids(["\n"])[0], bool(self._direct and self._direct[1])
        if self._ids([f"\n{w}" for w in PROBES]) != [self._line + self._of_model(w, "", lower) for w in PROBES]:
            self._line = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self._kind, e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_model(self, word: str, lead: str, lower: bool) -> bytes:
        raw = lead + (word.lower() if lower else word)
        return array(self._kind, [t.id for t in self._model.tokenize(raw.encode().decode("latin-1").translate(self._letters))]).tobytes()

    def _words(self, parts: Iterable[str]) -> dict[str, bytes]:
        got, rest = {}, []
        if self._direct:
            (lead, lower), line = self._direct, self._line
            space, tokenize, kind = self._space[lead], self._model.tokenize, self._kind
            for p in parts:
                if p.isascii() and p.isalpha():
                    # the letters of ASCII stand for themselves
                    got[p] = array(kind, [t.id for t in tokenize(space + (p.lower() if lower else p))]).tobytes()
                elif p.isalpha() and max(p) < "\u0250" and p.lower().isalpha():
                    got[p] = self._of_model(p, lead, lower)
                elif line is not None and p[0] == "\n" and (word := p[1:]).isalpha() and max(word) < "\u0250" and word.lower().isalpha():
                    got[p] = line + self._of_model(word, "", lower)
                else:
                    rest.append(p)
        else:
            rest += parts
        if rest:
            got |= zip(rest, self._ids([p if p[0] == "\n" else " " + p for p in rest]), strict=True)
        return got

    def _parts(self, text: str) -> tuple[str, list[str] | None, str]:
        """The first part, and the others: as a list, or as a string that has them behind spaces."""
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or any(c in text for c in _EXOTIC):
            # other white space or runs of it: cut at the safe places only
            first, *parts = _SAFE.split(text)
            return first, [p[1:] if p[0] == " " else p for p in parts], ""
        first, space, rest = text.replace("\n", " \n").partition(" ")
        return first, None, space + rest

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian integers of ``dtype``; null is empty."""
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; a part is looked up once for all of them."""
        firsts, lists, joined, n = [], [], [], []
        for text in texts:
            first, parts, rest = self._parts(text) if text else ("", None, "")
            firsts.append(first)
            if parts is None:
                joined.append(rest)
                n.append((True, rest.count(" ")))
            else:
                lists += parts
                n.append((False, len(parts)))
        # the first part of the split lies before the first space
        words = pc.split_pattern(pa.array(["".join(joined)]), " ").values[1:]
        words = pa.concat_arrays([words, pa.array(lists, pa.string())]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self._new.get, distinct))
        if None in ids:
            at = [i for i, known in enumerate(ids) if known is None]
            got = self._learn([distinct[i] for i in at])
            for i in at:
                ids[i] = got[distinct[i]]
        found = pa.array(ids, pa.large_binary()).take(words.indices)
        # where parts begin in the bytes of all of them
        _, begin, data = found.buffers()
        begin = np.frombuffer(begin, np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
        data = memoryview(data) if data else memoryview(b"")
        at, out = {True: 0, False: len(found) - len(lists)}, []
        for first, (kind, size) in zip(self._ids(firsts), n, strict=True):
            out.append(first + data[begin[at[kind]]:begin[at[kind] + size]])
            at[kind] += size
        return out

    def _tail(self, signs: str) -> bytes | None:
        """The ids of signs behind a word, or None if they depend on the word."""
        if signs not in self._tails:
            if len(self._tails) >= TAILS:
                self._tails = {}
            words = (" the", " Haus", " été", "\nthe", "\nÉté")
            alone, behind = self._ids(list(words)), self._ids([w + signs for w in words])
            tails = {whole[len(word):] if whole.startswith(word) else None for word, whole in zip(alone, behind, strict=True)}
            self._tails[signs] = tails.pop() if len(tails) == 1 else None
        return self._tails[signs]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of different parts; all but long parts and words behind rare signs are kept."""
        new, old = self._new, self._old
        got, signed, fresh = {}, {}, []
        for p in missing:
            if (ids := old.get(p)) is not None:
                got[p] = ids
            elif not p.isalpha() and (m := _SIGNED.fullmatch(p)) and (p.isascii() or max(p) < "\u0250") and (tail := self._tail(m[2])) is not None:
                signed[p] = m[1], tail, m[2] in ",."
            else:
                fresh.append(p)
        known = {s: ids for s in {s for s, *_ in signed.values()} if (ids := new.get(s) or old.get(s))}
        words = self._words({*fresh, *(s for s, *_ in signed.values())} - known.keys() - got.keys())
        got |= words
        for p, (word, tail, kept) in signed.items():
            ids = (known.get(word) or got[word]) + tail
            if kept:
                got[p] = ids
            else:
                signed[p] = ids
        for p, ids in got.items():
            if len(p) <= CACHED_CHARS and p not in self._new:
                if self._size > self.cache:
                    self._new, self._old, self._size = {}, self._new, 0
                self._new[p] = ids
                self._size += ENTRY + len(p) + len(ids)
        return got | {p: ids for p, ids in signed.items() if p not in got}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache = cache
    return _ENCODERS[path]


def encode_column(encode: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of every text of a column, in its order; texts are encoded in groups, smaller ones if the cache is small."""
    group, chars = [], 0
    for text in texts:
        group.append(text.as_py())
        chars += len(group[-1] or "")
        if chars * GROUP >= encode.cache:
            yield from encode.all(group)
            group, chars = [], 0
    yield from encode.all(group)


def forget(path: str) -> None:
    """Drop a worker's encoder with its caches, for workers that have other work behind them."""
    _ENCODERS.pop(path, None)


def crc32_u4(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
