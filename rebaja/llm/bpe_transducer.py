"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding a prefix of a piece always ends in one definite token, and a token may
follow another exactly if no merge across the two comes before the merges that
bury their sides. So the last token of every prefix can be found byte by byte.
A state of the transducer is the set of boundaries at which a token still being
read may begin, each with the token that ends there, and the bytes since the
first of them; its arcs name the token that ends at the byte read. States and
arcs are made when first needed. What all open boundaries share is final:
ids leave after a lookahead bounded by the longest token.
"""
from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rebaja.llm.common import slices, texts
from rebaja.llm.wordcache import PartCache, warm

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chars bigint"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class State(dict):
    """Arcs by byte: the next state and the token that ends there, made when first asked for.

    ``live``: the boundaries in ``text`` at which a token still being read may begin, each with the token that ends there.
    """

    __slots__ = ("owner", "text", "live")

    def __init__(self, owner: Transducer, text: bytes, live: tuple):
        self.owner, self.text, self.live = owner, text, live

    def __missing__(self, byte: int) -> tuple[State, bytes]:
        arc = self[byte] = self.owner.step(self, byte)
        return arc


class Transducer:
    """Encodes pieces of the pre-tokeniser; at most about ``limit`` states are kept."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        self.ranks, self.limit = ranks, limit
        self.opens = {t[:n] for t in ranks for n in range(1, len(t))}  # what a token may still grow from
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[bytes, tuple[list, list]] = {}
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # arcs may lead in circles
        self.states: dict[tuple, State] = {}
        self.start = self._state(b"", ((0, None),))

    def _state(self, text: bytes, live: tuple) -> State:
        state = self.states.get((text, live))
        if state is None:
            state = self.states[text, live] = State(self, text, live)
        return state

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token joins; None if merges do not lead to it."""
        if token not in self.halves:
            cut = [token[i:i + 1] for i in range(len(token))]
            while len(cut) > 2:
                rank, i = min((self.ranks.get(cut[i] + cut[i + 1], 1 << 60), i) for i in range(len(cut) - 1))
                if rank == 1 << 60:
                    break
                cut[i:i + 2] = [cut[i] + cut[i + 1]]
            self.halves[token] = tuple(cut) if len(cut) == 2 else None
        return self.halves[token]

    def _edges(self, token: bytes) -> tuple[list, list]:
        """What stands at the right and at the left end of a token while it is being merged: (bytes, rank of the merge that ends it)."""
        if token not in self.edges:
            sides = []
            for side in (1, 0):
                now, until, out = token, 1 << 60, []
                while True:
                    out.append((now, until))
                    if len(now) == 1:
                        break
                    now, until = self.parts(now)[side], self.ranks[now]
                sides.append(out)
            self.edges[token] = tuple(sides)
        return self.edges[token]

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` may stand after ``last`` (None: at the start): no merge across the two comes before the merges that bury its sides."""
        key = (last, token)
        if key not in self.pairs:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            ok = len(token) == 1 or self.parts(token) is not None
            if ok and last is not None:
                ok = not any((r := self.ranks.get(a + b)) is not None and r < until_a and r <= until_b
                             for a, until_a in self._edges(last)[0] for b, until_b in self._edges(token)[1])
            self.pairs[key] = ok
        return self.pairs[key]

    def step(self, state: State, byte: int) -> tuple[State, bytes]:
        """The next state, and the token that ends at this byte."""
        text, ranks = state.text + bytes((byte,)), self.ranks
        for k, last in state.live:
            token = text[k:]
            if token in ranks and self.follows(last, token):
                break
        else:
            raise ValueError("the ranks lack single bytes")
        still = [x for x in state.live if text[x[0]:] in self.opens]
        still.append((len(text), token))
        base = still[0][0]
        return self._state(text[base:], tuple([(k - base, t) for k, t in still]) if base else tuple(still)), token

    def _final(self, state: State, ends: list[bytes]) -> int:
        """The last boundary that all open ones share, by steps back over ``ends``, the tokens that end at each place."""
        first = len(ends) - len(state.text)
        path, at = {len(ends)}, len(ends)
        while at > 0:
            at -= len(ends[at - 1])
            path.add(at)
        shared = len(ends)
        for k, _ in state.live:
            at = first + k
            while at not in path:
                at -= len(ends[at - 1])
            shared = min(shared, at)
        return shared

    def _emit(self, ends: list[bytes], at: int) -> list[int]:
        out = []
        while at:
            token = ends[at - 1]
            out.append(self.ranks[token])
            at -= len(token)
        out.reverse()
        return out

    def encode(self, piece: bytes, window: int = 256) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, whether merges lead to it or not.

        Of a long piece, what is final leaves every ``window`` bytes.
        """
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > self.limit:
            self._reset()
        out: list[int] = []
        ends: list[bytes] = []
        state = self.start
        for at in range(0, len(piece), window):
            for byte in piece[at:at + window]:
                state, token = state[byte]
                ends.append(token)
            if at + window < len(piece) and (done := self._final(state, ends)):
                out += self._emit(ends, done)
                del ends[:done]
        return out + self._emit(ends, len(ends))


class Encoder:
    """Whole texts to ids, as little-endian unsigned 16-bit integers; each match of ``pattern`` by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        self.limit, self.transducer, self.find = limit, Transducer(ranks), regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.cache = PartCache(self._part, spaced=True)

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}H", *ids)

    def _part(self, part: str) -> bytes:
        found, known = self.find(part), self.pieces
        if len(known) > self.limit:
            known.clear()
        for piece in found:
            if piece not in known:
                known[piece] = self._piece(piece)
        return known[part] if len(found) == 1 else b"".join([known[p] for p in found])

    def __call__(self, text: str) -> bytes:
        return self.cache(text)


class StreamDecoder:
    """Ids to text, a run of ids at a time: an incremental UTF-8 state machine holds back a sign that is not complete.

    Ids that never form UTF-8 give replacement signs in the text; the bytes are exact in any case.
    """

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> tuple[bytes, str]:
        """Bytes of these ids, and the signs complete by now."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        return data, self.machine.decode(data, last)


def codec_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, run: int = 16384) -> DataFrame:
    """Encode each whole text, decode its ids as a stream, and describe both. A null or empty text has no ids.

    The ranks go to the tasks once, as a broadcast: they are a vocabulary file of fixed size.
    """
    shared, own = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex

    def digest(batches):
        gc.disable()  # many small objects, no cycles
        encoder, decoder = warm(own, lambda: (Encoder(shared.value, pattern), StreamDecoder(shared.value)))
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder(text), "<u2")
                ids_sum, text_sum, chars = hashlib.sha256(), hashlib.sha256(), 0
                decoder.reset()
                for i in range(0, max(len(ids), 1), run):
                    part = ids[i:i + run]
                    out, signs = decoder.feed(part, i + run >= len(ids))
                    ids_sum.update(part.astype("<u4"))
                    text_sum.update(out)
                    chars += len(signs)
                rows.append((len(ids), ids_sum.hexdigest(), text_sum.hexdigest(), chars))
            n, a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])

    return texts(docs).mapInArrow(digest, SCHEMA)


def bpe_digest(docs: DataFrame) -> DataFrame:
    """``codec_digest`` with the public multilingual ranks."""
    import public_tokenizers as P

    return codec_digest(docs, read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
