"""Byte-level BPE as a lazily determinised finite-state transducer.

The encoding of every prefix of a piece is unique, so it can be extended one byte at a
time: the last token of the prefix of length i is the one vocabulary entry t that ends
there and that may follow the last token of the prefix of length i - len(t). Two tokens
may stand side by side iff the merges leave them apart. A state of the transducer is what
the future can still depend on: the last emitted token and the bytes after it that some
vocabulary entry may still join. Tokens that all live paths share are emitted; the
lookahead is therefore bounded by the length of the longest entry. States and transitions
are made on demand and kept, up to a bound; from there on rare pieces run through the same
configurations without keeping them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, giving_back

#: Entries of a generation of the piece cache (the last two are kept) and determinised states; bounds a worker's memory.
CACHE_PIECES, CACHE_STATES = 200_000, 30_000
#: Bytes after which a run without states settles what it can.
LOOKAHEAD = 48
#: Seconds after its last task for which a worker keeps what it met (the next task of the stage begins with it), and the vocabulary's tables in any case.
KEEP_SECONDS = 5.0

#: Unicode White_Space, spelt out: Python's \s also has U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0  -     　"


def splitter(pattern: str) -> regex.Pattern:
    r"""The pre-tokenising pattern with \s and \S meaning Unicode White_Space."""
    out = pattern.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\S", rf"[^{_WHITE}]").replace(r"\s", rf"[{_WHITE}]")
    return regex.compile(out)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """Encodes bytes by merge ranks, and keeps what it has determinised."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = dict(zip(ranks.values(), ranks.keys()))
        #: 2 (token + 1) of each entry, 0 of what is none; one more if a longer entry begins so
        self.known = {t: 2 * (r + 1) for t, r in ranks.items()}
        for part in {t[:i] for t in ranks for i in range(1, len(t))}:
            self.known[part] = self.known.get(part, 0) | 1
        self.packed = {r: r.to_bytes(4, "little") for r in self.table}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for t in sorted(ranks, key=ranks.__getitem__):
            if len(t) > 1 and (pair := self._last_merge(t)):
                self.halves[ranks[t]] = pair
                self.whole[pair] = ranks[t]
        self.fits: dict[int, bool] = {}  # by a << 20 | b
        self.share = 1.0  # of CACHE_STATES, and of CACHE_PIECES in Codec
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        #: bytes after the last emitted token, the last token of each of their prefixes (first
        #: the emitted one), where those start, and where an entry may still be open
        self.states: list[tuple[bytes, list[int], list[int], list[int]]] = [(b"", [-1], [0], [])]
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        self.ends: dict[int, bytes] = {}

    def _last_merge(self, t: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes t: those that every smaller rank leaves of it."""
        limit, parts = self.ranks[t], [t[i:i + 1] for i in range(len(t))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if rank >= limit:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """True if the merges leave a and b apart: no pair across their seam ever merges before its own parts do."""
        got = self.fits.get(a << 20 | b)
        if got is not None:
            return got
        x, y, before, apart = a, b, 1 << 60, True
        while True:
            if self.whole.get((x, y), 1 << 60) < before:
                apart = False
                break
            # undo the younger of the two merges; what then meets at the seam must not merge earlier
            left, right = self.halves.get(x), self.halves.get(y)
            if left and (x > y or not right):
                before, x = x, left[1]
            elif right:
                before, y = y + 1, right[0]
            else:
                break
        if len(self.fits) > 10 * CACHE_STATES * self.share:
            self.fits.clear()
        self.fits[a << 20 | b] = apart
        return apart

    def _extend(self, tail: bytes, tokens: list[int], starts: list[int], open_at: list[int]) -> list[int]:
        """Append the last token of tail's encoding, and its start; returns where an entry may still be open."""
        n = len(tail)
        known, fits = self.known.get, self.fits.get
        live, token, start = [], None, n
        for s in (*open_at, n - 1):
            entry = known(tail[s:])
            if entry is None:
                continue
            if entry & 1:
                live.append(s)
            if token is None and entry > 1:
                t, p = (entry >> 1) - 1, tokens[s]
                ok = p < 0 or fits(p << 20 | t)
                if ok is None:
                    ok = self.may_follow(p, t)
                if ok:
                    token, start = t, s
        if token is None:
            raise ValueError(f"byte {tail[-1]} is not in the vocabulary")
        tokens.append(token)
        starts.append(start)
        return live

    @staticmethod
    def _settled(n: int, starts: list[int], live: list[int]) -> int:
        """The deepest prefix that every live path goes through."""
        at = n
        for s in live:
            while s != at:
                if s > at:
                    s = starts[s]
                else:
                    at = starts[at]
            if not at:
                break
        return at

    def _emit(self, tokens: list[int], starts: list[int], at: int) -> bytes:
        out = []
        while at:
            out.append(self.packed[tokens[at]])
            at = starts[at]
        return b"".join(reversed(out))

    def _cut(self, tail: bytes, tokens: list[int], starts: list[int], live: list[int]) -> tuple[bytes, tuple]:
        """What is settled, as ids, and the configuration after it."""
        at = self._settled(len(tail), starts, live)
        if not at:
            return b"", (tail, tokens, starts, live)
        return self._emit(tokens, starts, at), (tail[at:], tokens[at:], [max(0, x - at) for x in starts[at:]], [s - at for s in live])

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        tail, tokens, starts, open_at = self.states[state]
        tail, tokens, starts = tail + bytes((byte,)), [*tokens], [*starts]
        live = self._extend(tail, tokens, starts, open_at)
        emitted, config = self._cut(tail, tokens, starts, live)
        key = (config[1][0], config[0])
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(config)
            self.moves.append({})
        got = self.moves[state][byte] = (to, emitted)
        return got

    def _undetermined(self, state: int, rest: bytes) -> bytes:
        """The transducer run on from a state without keeping what it meets: for rare pieces when the states are all taken."""
        tail, tokens, starts, live = self.states[state]
        tokens, starts, out = [*tokens], [*starts], []
        if len(tail) + len(rest) < LOOKAHEAD:
            # as _extend does it, without what a longer run needs
            begin, tail = len(tail), tail + rest
            known, fits = self.known.get, self.fits.get
            for end in range(begin + 1, len(tail) + 1):
                left, token = [], -1
                for s in (*live, end - 1):
                    entry = known(tail[s:end])
                    if entry is None:
                        continue
                    if entry & 1:
                        left.append(s)
                    if token < 0 and entry > 1:
                        t, p = (entry >> 1) - 1, tokens[s]
                        if p >= 0:
                            ok = fits(p << 20 | t)
                            if ok is None:
                                ok = self.may_follow(p, t)
                            if not ok:
                                continue
                        token, start = t, s
                if token < 0:
                    raise ValueError(f"byte {tail[end - 1]} is not in the vocabulary")
                tokens.append(token)
                starts.append(start)
                live = left
            return self._emit(tokens, starts, len(tail))
        for i in range(len(rest)):
            tail += rest[i:i + 1]
            live = self._extend(tail, tokens, starts, live)
            if len(tail) >= LOOKAHEAD:
                emitted, (tail, tokens, starts, live) = self._cut(tail, tokens, starts, live)
                out.append(emitted)
        out.append(self._emit(tokens, starts, len(tail)))
        return b"".join(out)

    def _end(self, state: int) -> bytes:
        got = self.ends.get(state)
        if got is None:
            tail, tokens, starts, _ = self.states[state]
            got = self.ends[state] = self._emit(tokens, starts, len(tail))
        return got

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        state, out, moves = 0, [], self.moves
        for i, byte in enumerate(piece):
            to = moves[state].get(byte)
            if to is None:
                if len(self.states) >= CACHE_STATES * self.share:
                    out.append(self._undetermined(state, piece[i:]))
                    break
                to = self._step(state, byte)
            state = to[0]
            if to[1]:
                out.append(to[1])
        else:
            out.append(self._end(state))
        return b"".join(out)


class Utf8:
    """Incremental UTF-8 state machine.

    A state is how many bytes the character still needs, the range in which the next one must lie, and the bits so far;
    it outlives the chunks. A byte out of range ends a malformed part, which becomes one U+FFFD, and is looked at again.
    """

    def __init__(self):
        self.need, self.low, self.high, self.bits = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        need, low, high, bits = self.need, self.low, self.high, self.bits
        for byte in data:
            if need:
                if low <= byte <= high:
                    need, low, high, bits = need - 1, 0x80, 0xBF, bits << 6 | byte & 0x3F
                    if not need:
                        out.append(chr(bits))
                    continue
                out.append("\ufffd")
                need, low, high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                need, bits = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                need, bits = 2, byte & 0x0F
                low, high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                need, bits = 3, byte & 0x07
                low, high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("\ufffd")
        self.need, self.low, self.high, self.bits = need, low, high, bits
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character leaves; the machine starts anew."""
        left = "\ufffd" if self.need else ""
        self.__init__()
        return left


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.split = splitter(pattern).findall
        fst = self.fst

        class Pieces(dict):
            before: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                got = self.before.get(piece)
                if got is None:
                    got = fst.encode(piece.encode())
                if len(piece) <= 64:
                    if len(self) >= CACHE_PIECES * fst.share:
                        self.before = dict(self)
                        self.clear()
                    self[piece] = got
                return got

        self.pieces = Pieces()
        self.texts = [None] * (max(fst.table, default=-1) + 1)
        for token, data in fst.table.items():
            machine = Utf8()
            text = machine.feed(data)
            if not machine.need and text.encode() == data:
                self.texts[token] = text
        self.whole = np.array([t is not None for t in self.texts], bool)
        self.lock, self.users, self.timer, self.keep = threading.Lock(), 0, None, 0.0

    def forget(self) -> None:
        """Drop what was met, keep the vocabulary's tables: the next task of the stage needs them."""
        self.pieces.clear()
        self.pieces.before = {}
        self.fst.fits.clear()
        self.fst._reset()

    def __enter__(self) -> Codec:
        """For a task: nothing is forgotten before it ends."""
        with self.lock:
            self.users += 1
            if self.timer:
                self.timer.cancel()
                self.timer = None
        return self

    def __exit__(self, *_) -> None:
        with self.lock:
            self.users -= 1
            if self.users:
                return
            if not self.keep:
                self.forget()
            self.timer = threading.Timer(self.keep or KEEP_SECONDS, _drop, (weakref.ref(self),))
            self.timer.daemon = True
            self.timer.start()

    def retire(self) -> bool:
        """Unless a task has it: forget, and be no worker's codec any more."""
        with self.lock:
            if self.users:
                return False
            self.forget()
            for key in [k for k, c in [*_CODECS.items()] if c is self]:
                _CODECS.pop(key, None)
            return True

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, whatever they are."""
        return b"".join(map(self.fst.table.__getitem__, memoryview(ids).cast("I")))

    def decode_text(self, ids: bytes) -> str:
        """The text of ids: tokens that are whole characters as they are, the bytes of others through the state machine."""
        tokens = np.frombuffer(ids, "<u4")
        broken, tokens, texts, table = np.flatnonzero(~self.whole[tokens]).tolist(), tokens.tolist(), self.texts, self.fst.table
        out, machine, at = [], Utf8(), 0
        for i in [*broken, len(tokens)]:
            if at < i:
                if machine.need:  # a character that its tokens left unfinished
                    out.append(machine.feed(table[tokens[at]]))
                    at += 1
                out += map(texts.__getitem__, tokens[at:i])
            if i < len(tokens):
                out.append(machine.feed(table[tokens[i]]))
            at = i + 1
        out.append(machine.end())
        return "".join(out)


_CODECS: dict[tuple[bytes, str], Codec] = {}


def _drop(of: weakref.ref[Codec]) -> None:
    """Give back an unused codec, the vocabulary's tables too: a worker that stays alive runs other stages next."""
    codec = of()
    if codec and codec.retire():
        del codec
        gc.collect()  # it is part of cycles
        give_back()


def codec_of(data: bytes, pattern: str) -> Codec:
    """The codec of a rank file; one stays in a worker, until it is unused for a while."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data), pattern)
    return _CODECS[key]


def utf8_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Decode bytes that arrive in chunks cut anywhere; each malformed part becomes U+FFFD."""
    machine = Utf8()
    for chunk in chunks:
        if text := machine.feed(chunk):
            yield text
    if text := machine.end():
        yield text


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_ids: bool = False, keep_seconds: float = KEEP_SECONDS, cache_share: float = 1.0) -> DataFrame:
    """Encode each text, decode its ids again, and return digests (and the ids on request).

    Columns: the id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids
    (binary, little-endian unsigned 32-bit). A null text counts as empty (0 tokens);
    repeated rows are each returned; other columns of docs are ignored, whatever their
    names; an empty table gives an empty result. Row-local: no shuffle. The vocabulary
    (a fixed file of under 1 MB) is read by the driver and broadcast. Workers keep what they met for keep_seconds
    after a task, some 110 MB each; 0: they drop it with each task. cache_share: the part of CACHE_PIECES and CACHE_STATES
    they may hold; with less, more is encoded anew and the ids are the same.
    """
    spark: SparkSession = docs.sparkSession
    with open(ranks_file, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, pattern)
        codec.keep, codec.fst.share = keep_seconds, cache_share
        with codec:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows = []
                    for text in part.column(1):
                        ids = codec.encode(text.as_py() or "")
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                     hashlib.sha256(codec.decode_text(ids).encode()).hexdigest(), ids if keep_ids else None))
                    cols = list(zip(*rows))
                    arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        arrays.append(pa.array(cols[3], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"{id_col} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(giving_back(run), schema + ", ids binary" * keep_ids)
