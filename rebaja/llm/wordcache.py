"""Ids of whole texts from a cache of the ids of their space-separated parts.

No match of the pre-tokenisers' patterns goes from a non-space to a space, so a
text can be cut before every space that follows a non-space, and each part be
encoded by itself. Most parts repeat; a part is encoded once while it stays in
the cache.
"""
from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Callable

import numpy as np

CUT = re.compile(r"(?<=\S)(?= )")
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "!#$%&*.,:;?"
# Parts of these signs split the same way under either pattern: runs of letters, runs of stops, line ends.
PLAIN = re.compile(f"[{LETTERS}{STOPS}](?:[{LETTERS}{STOPS}]|\n(?=[{LETTERS}{STOPS}]))*").fullmatch
WORD = re.compile(f"[{LETTERS}]+").fullmatch
# A word and the stops after it: a piece each.
STOPPED = re.compile(f"([{LETTERS}]++)([{STOPS}]++)").fullmatch
WORDS = re.compile(f"[^{STOPS}\n]+|[{STOPS}]+").findall
PIECES = re.compile(f" ?[^ {STOPS}\n]+| ?[{STOPS}]+|\n").findall


_WARM: dict = {}


def warm(key, make: Callable):
    """What ``make`` gives, kept between the tasks of a Python worker until another key comes. Only caches belong here: results never depend on it."""
    if key not in _WARM:
        _WARM.clear()
        gc.collect()
        _WARM[key] = make()
    return _WARM[key]


def _signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: itself where printable, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(free)}


class Library:
    """A vocabulary of the tokenizers library. Plain words go straight to its merges, all else through its whole pipeline."""

    def __init__(self, path: str, spaced: bool, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.merges, self.signs = self.tokenizer.model.tokenize, _signs()
        self.spaced, self.limit, self.known = spaced, limit, {}
        self.split, self.space = PIECES if spaced else WORDS, self.signs[32]
        self.packed = [struct.pack("<H", i) for i in range(self.tokenizer.get_vocab_size())]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece != "\n":
            data = piece.replace(" ", self.signs[32])  # all other signs of such pieces stand for themselves
        else:
            data = piece.encode().decode("latin-1").translate(self.signs)
        return self._merged(data)

    def _merged(self, data: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merges(data)])

    def __call__(self, part: str) -> bytes:
        word = part[1:] if self.spaced and part[:1] == " " else part
        if word.isascii() and word.isalpha():
            return self._merged(part.replace(" ", self.space) if self.spaced else part.lower())
        if WORD(word):
            return self._piece(part if self.spaced else part.lower())
        if not PLAIN(word):
            return np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u2").tobytes()
        pieces = self.split(part if self.spaced else part.lower())
        if len(self.known) > self.limit:
            self.known.clear()
        for piece in pieces:
            if piece not in self.known:
                self.known[piece] = self._piece(piece)
        return b"".join([self.known[p] for p in pieces])


class _Parts(dict):
    """Ids of parts, made when first asked for. With ``strict``, a part that is empty or has a space at an end cannot stand alone: None.

    A part is kept once it is asked for again; those asked for once wait among
    the ``recent`` ones, so rare parts do not push out frequent ones. With
    ``stopped``, a word with stops after it has the ids of the word and those
    of the stops.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str = "", strict: bool = False, stopped: bool = False):
        self.encode, self.lead, self.strict, self.stopped, self.recent, self.ends = encode, lead, strict, stopped, {}, {}

    def trim(self, limit: int) -> None:
        for kept in (self, self.recent, self.ends):
            if len(kept) > limit // 2:
                kept.clear()

    def __missing__(self, part: str) -> bytes | None:
        ids = self.recent.pop(part, None)
        if ids is not None:
            self[part] = ids
            return ids
        pair = STOPPED(part) if self.stopped and part[-1:] in STOPS else None
        if pair:
            word, stops = pair.groups()
            end = self.ends.get(stops)
            if end is None:
                end = self.ends[stops] = self.encode(stops)
            ids = self[word] + end
        else:
            alone = not self.strict or part and not part[-1].isspace() and (self.lead or not part[0].isspace())
            ids = self.encode(self.lead + part) if alone else None
        self.recent[part] = ids
        return ids


class PartCache:
    """Texts to ids as little-endian unsigned 16-bit integers, with ``encode`` for a part. Of the parts asked for again and of the others about ``limit / 2`` are held."""

    def __init__(self, encode: Callable[[str], bytes], spaced: bool, limit: int = 500_000):
        """``spaced``: the space before a part belongs to it (byte-level patterns). Else spaces, line ends and case are dropped."""
        self.encode, self.spaced, self.limit = encode, spaced, limit
        stopped = isinstance(encode, Library)  # its patterns part letters from stops
        self.first, self.later = _Parts(encode, "", True, stopped), _Parts(encode, " " if spaced else "", spaced, stopped)
        self.line_end = encode("\n")

    def __call__(self, text: str) -> bytes:
        for cache in (self.first, self.later):
            cache.trim(self.limit)
        get = self.later.__getitem__
        if not self.spaced:
            if "\u0130" not in text and "\u03a3" not in text:  # the two letters whose lower case is no matter of one letter
                text = text.lower()
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        try:
            lines = []
            for line in text.split("\n"):  # a line end between two non-spaces is a piece of its own
                head, *rest = line.split(" ")
                lines.append(b"".join([self.first[head], *map(get, rest)]))
            return self.line_end.join(lines)
        except TypeError:
            return b"".join(map(self.encode, CUT.split(text))) if text else b""
