"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a smaller
document or before in the same one. No machine can hold the suffixes of all documents, so
equal windows are first brought together:

1. Each window's key is the least hash of the GRAM-byte strings in it. Runs of windows with one
   key are one stretch of text. Equal windows have equal keys, so they lie in stretches of
   one key. Stretches that are equal as a whole are settled by their hashes.
2. Keys under which different stretches meet go to the second step with their bytes: bounded blocks of
   whole keys, one Burrows-Wheeler transform for each. Starting from the interval of all suffixes,
   intervals are extended backward breadth-first; each round's new interval bounds are the places
   where the common prefix has just that length, and the rounds stop at `length`. Suffixes between two
   bounds share their first `length` bytes; all but the earliest are repeats.

Keys that very many different stretches share (a common line in ever new surroundings) are found on
a sample of the documents; their windows travel one by one, under a hash of their own, and
spread evenly. The sample decides which way a window goes, never what becomes of it. So do the windows of keys whose
different stretches turn out to have over KEY_BYTES bytes: no transform is larger than BLOCK_BYTES + KEY_BYTES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free, giving_back, quoted, written

LENGTH, GRAM = 100, 24
#: One document in so many is looked at for crowded keys, and a key is crowded beyond this share of their stretches.
SAMPLE_DOCS, CROWDED_SHARE = 32, 1 / 2000
#: Records that a mapper holds before it sends them on, and bytes of a block under one transform.
FLUSH_RECORDS, BLOCK_BYTES = 300_000, 1 << 19
#: Bytes of a key's different stretches beyond which its windows go one by one.
KEY_BYTES = 1 << 22
#: Text bytes that an array of hashes is made of at a time.
SLAB = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_NO_ID = -(1 << 63)
_INNER = 1 << 31


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(by))) * _ODD


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive bytes, joined from hashes of half as many."""
    parts, size = {1: _BYTE[x]}, 1
    while size * 2 <= k:
        h = parts[size]
        parts[size * 2] = _mixed(h[:-size] * _ODD ^ h[size:], 29)
        size *= 2
    whole, h = size, parts[size]
    while whole < k:
        part = max(p for p in parts if p <= k - whole)
        other = parts[part][whole:]
        n = len(x) - (whole + part) + 1
        h = _mixed(h[:n] * _ODD ^ other[:n], 31)
        whole += part
    return _mixed(h, 32)


def _sliding(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of each `width` consecutive values."""
    size = 1
    while size < width:
        by = min(size, width - size)
        h = pick(h[:-by], h[by:])
        size += by
    return h


def stretches(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows) of each run of windows with one key; empty for texts under one window.

    _INNER is added to windows where the key's gram stands in the stretch more than once: only
    there can windows of one stretch be equal to each other.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.frombuffer(data, np.uint8)
    out = []
    for a in range(0, len(x) - length + 1, SLAB):
        part = gram_hashes(x[a:a + SLAB + length - 1], gram)
        width = length - gram + 1
        least = _sliding(part, width, np.minimum)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate([[0], cut])
        windows = np.diff(np.concatenate([start, [len(least)]]))
        key = least[start]
        # places whose gram is the least of some window
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(part == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
        low, high = np.searchsorted(places, start), np.searchsorted(places, start + windows + width - 1)
        n = high - low
        of = np.repeat(np.arange(len(key)), n)
        at = places[np.arange(len(of)) + np.repeat(low - (np.cumsum(n) - n), n)]
        inner = np.bincount(of, part[at] == key[of], len(key)) > 1
        out.append((key, start + a, windows + _INNER * inner))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(c.tobytes() for c in columns)])


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_RECORD = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint32)  # key, content, id, tie, start, windows


class _Records:
    """Stretches of a mapper's documents on their way to buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, key, content, ident: int, tie: int, start, windows) -> None:
        n = len(key)
        self.held.append((key, content, np.full(n, ident, np.int64), np.full(n, tie, np.int64), start.astype(np.uint32), windows.astype(np.uint32)))
        self.n += n

    def add_windows(self, data: bytes, ident: int, tie: int, at: np.ndarray, length: int) -> None:
        """The windows that start at the places `at`, one by one under a hash of their own."""
        parts = [data[a:a + length] for a in at.tolist()]
        self.add(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(at)), np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(at)),
                 ident, tie, at, np.ones(len(at)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What flush() gives, as rows."""
        got = list(self.flush())
        for a in range(0, len(got), 4096):
            b, k, p = zip(*got[a:a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, payload): kind 0 has the first of equal stretches, kind 1 the others, which are settled."""
        if not self.n:
            return
        key, content, ident, tie, start, windows = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.n = [], 0
        order = np.lexsort((start, tie, ident, content, key))
        key, content, ident, tie, start, windows = (c[order] for c in (key, content, ident, tie, start, windows))
        first, repeat = _firsts(key, content, ident, tie, start)
        bucket = (_mixed(key, 33) >> np.uint64(20)) % np.uint64(self.buckets)
        for kind, rows in ((0, np.flatnonzero(first)), (1, np.flatnonzero(repeat))):
            # what is settled only passes through; its document spreads it
            b = bucket[rows] if kind == 0 else _mixed(ident[rows].view(np.uint64) + tie[rows].view(np.uint64), 33) % np.uint64(self.buckets)
            rows = rows[np.argsort(b, kind="stable")]
            b = np.sort(b, kind="stable")
            cut = np.flatnonzero(np.diff(b)) + 1 if len(b) else []
            for part, at in zip(np.split(rows, cut), np.split(b, cut)):
                if len(part):
                    yield int(at[0]), kind, _pack(*(c[part] for c in (key, content, ident, tie, start, windows)))


def _firsts(key, content, ident, tie, start) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted records: which begin a group of equal stretches, and which repeat one from another place.

    A row that stands in the table twice gives records of one place, which are no repeats.
    """
    n = len(key)
    first = np.ones(n, bool)
    first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    same = (ident == ident[head]) & (tie == tie[head]) & (start == start[head])
    return first, ~same


def crowded_keys(docs: DataFrame, length: int, gram: int) -> set[int]:
    """Keys that many different stretches of a sample of documents have; at most 1 / CROWDED_SHARE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                data = text.as_py().encode()
                key, start, n = stretches(data, length, gram)
                n %= _INNER
                content = [xxhash.xxh3_64_intdigest(data[a:a + b + length - 1]) for a, b in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64))], ["key", "content"])

    some = docs.where(F.pmod(F.xxhash64(F.lit("crowded"), "_id", "_tie"), F.lit(SAMPLE_DOCS)) == 0).select("text")
    pairs = some.mapInArrow(giving_back(run), "key long, content long").distinct()
    counts = pairs.groupBy("key").count().cache()
    total = counts.agg(F.sum("count")).first()[0] or 0
    got = counts.where(F.col("count") > max(8, total * CROWDED_SHARE)).select("key").collect()
    counts.unpersist()
    return {r["key"] & (2**64 - 1) for r in got}


def _mapper(buckets: int, crowded: set[int], length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, busy = _Records(buckets), np.array(sorted(crowded), np.uint64)
        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            for ident, tie, text in zip(*batch.columns):
                data = text.as_py().encode()
                key, start, n = stretches(data, length, gram)
                if not len(key):
                    continue
                ident, tie = ident.as_py(), tie.as_py()
                alone = np.isin(key, busy) if len(busy) else np.zeros(len(key), bool)
                if alone.any():
                    at = np.concatenate([np.arange(a, a + b) for a, b in zip(start[alone].tolist(), (n[alone] % _INNER).tolist())])
                    records.add_windows(data, ident, tie, at, length)
                    key, start, n = key[~alone], start[~alone], n[~alone]
                content = np.fromiter((hashed(data[a:b]) for a, b in zip(start.tolist(), (start + n % _INNER + length - 1).tolist())), np.uint64, len(start))
                records.add(key, content, ident, tie, start, n)
                if records.n >= FLUSH_RECORDS:
                    yield from records.batches()
        yield from records.batches()

    return run


def _one_by_one(buckets: int, length: int):
    """Rows of a document and its stretches under keys with too many bytes: their windows as records of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _Records(buckets)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for ident, tie, text, asked in zip(*(c.to_pylist() for c in batch.slice(a, 64).columns)):
                    at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in asked])
                    records.add_windows(text.encode(), ident, tie, at, length)
                    if records.n >= FLUSH_RECORDS:
                        yield from records.batches()
        yield from records.batches()

    return run


_SPANS = (np.uint32, np.uint32)


def _by_document(ident, tie, start, windows) -> Iterator[tuple[int, int, bytes]]:
    """One packed row of (start, windows) for each document."""
    order = np.lexsort((start, tie, ident))
    ident, tie, start, windows = ident[order], tie[order], start[order], windows[order]
    cut = np.flatnonzero((np.diff(ident) != 0) | (np.diff(tie) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ident)]):
        if b > a:
            yield int(ident[a]), int(tie[a]), _pack(start[a:b].astype(np.uint32), windows[a:b].astype(np.uint32))


_SETTLED = "kind int, _id long, _tie long, key long, start int, windows int, spans binary"


def _settle(length: int, key_bytes: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition of buckets: repeats by document (kind 1), and stretches whose key others share (kind 0; 2 under
    keys with over key_bytes of them)."""
    held = {0: [], 1: []}
    for batch in batches:
        for kind, payload in zip(batch.column(1), batch.column(2)):
            held[kind.as_py()].append(_unpack(payload.as_py(), _RECORD))
    out = []
    sure = [np.concatenate(c) for c in zip(*held[1])] if held[1] else None
    if held[0]:
        key, content, ident, tie, start, windows = (np.concatenate(c) for c in zip(*held[0]))
        held.clear()
        order = np.lexsort((start, tie, ident, content, key))
        key, content, ident, tie, start, windows = (c[order] for c in (key, content, ident, tie, start, windows))
        first, repeat = _firsts(key, content, ident, tie, start)
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.cumsum(head) - 1
        shared = first & ((np.bincount(group, first)[group] >= 2) | (windows >= _INNER))
        windows = windows % np.uint32(_INNER)
        size = np.bincount(group, shared * (windows.astype(np.int64) + length - 1))[group]
        kind = np.where(size > key_bytes, 2, 0) if key_bytes is not None else np.zeros(len(key), np.int64)
        for i in np.flatnonzero(shared).tolist():
            out.append((int(kind[i]), int(ident[i]), int(tie[i]), int(key[i].view(np.int64)), int(start[i]), int(windows[i]), None))
        more = [c[repeat] for c in (ident, tie, start, windows)]
        if sure:
            sure[5] = sure[5] % np.uint32(_INNER)
        sure = [np.concatenate([a, b]) for a, b in zip(sure[2:], more)] if sure else more
    elif sure:
        sure = sure[2:]
        sure[3] = sure[3] % np.uint32(_INNER)
    if sure:
        out += [(1, i, t, None, None, None, p) for i, t, p in _by_document(*sure)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for a in range(0, len(out), 20_000):
        cols = list(zip(*out[a:a + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "_id", "_tie", "key", "start", "windows", "spans"])


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order (by `depth` symbols at least, ties by place) and Burrows-Wheeler transform of symbols below 512."""
    n = len(text)
    far = np.concatenate([text, text[np.arange(7) % n]]) if n else text
    rank = np.zeros(n, np.int64)
    for i in range(7):
        rank = (rank << 9) | far[i:i + n]
    size = 7
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_ = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if size >= depth or n == 0 or new.max() == n - 1:
            break
        rank = new * n + np.roll(new, -(size % n))
        size *= 2
    return order, text[order - 1]


def bounds(bwt: np.ndarray, depth: int) -> np.ndarray:
    """bounds[i]: suffixes i - 1 and i of the order differ within their first `depth` symbols.

    Backward extension of intervals, breadth-first: round r sets the bounds where the common prefix
    has r - 1 symbols, and only intervals that end in a new bound go on.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")  # radix for 16 bits
    back = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    back[by_symbol] = np.arange(n)
    symbols = bwt[by_symbol]
    same = symbols[1:] == symbols[:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and last place of the symbol in the transform
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(left):
            break
        size = right - left
        one = size == 1
        low = high = back[left[one]]
        if not one.all():
            a, b = left[~one], right[~one]
            size = size[~one]
            skip = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(a - skip, size)
            begins = before[place] < np.repeat(a, size)
            ends = after[place] >= np.repeat(b, size)
            # extensions are disjoint runs of the order: their ends pair up when sorted
            low = np.concatenate([low, np.sort(back[place[begins]])])
            high = np.concatenate([high, np.sort(back[place[ends]])])
        new = ~edge[high + 1]
        left, right = low[new], high[new] + 1
        edge[right] = True
    return edge


def repeats(blocks: list[bytes], rank: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the blocks, one after another with a gap between: does a window that is no first start here?

    rank and place order the windows of each block: by rank of the block's document, then by
    place of the block plus offset.
    """
    sizes = np.array([len(b) for b in blocks]) + 1
    text = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    order, bwt = transform(text, length)
    group_of_rank = np.cumsum(bounds(bwt, length)[:-1]) - 1
    of = np.repeat(np.arange(len(blocks)), sizes)
    offset = np.arange(len(text)) - (ends - sizes)[of]
    valid = offset + length <= sizes[of] - 1
    group = np.empty(len(text), np.int64)
    group[order] = group_of_rank
    at = np.flatnonzero(valid)
    g, r, p = group[at], rank[of[at]], place[of[at]] + offset[at]
    by = np.lexsort((p, r, g))
    g, r, p = g[by], r[by], p[by]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    out = np.zeros(len(text), bool)
    out[at[by]] = (r != r[head]) | (p != p[head])
    return out


def _expand(length: int):
    """Per partition of keys, sorted by key: the repeats of each block of whole keys, by document."""

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        ids = np.array([(r[1], r[2]) for r in rows], np.int64)
        _, rank = np.unique(ids, axis=0, return_inverse=True)
        place = np.array([r[3] for r in rows], np.int64)
        again = repeats([r[4] for r in rows], rank.ravel(), place, length)
        sizes = np.array([len(r[4]) for r in rows]) + 1
        at = np.flatnonzero(again)
        of = np.searchsorted(np.cumsum(sizes), at, side="right")
        start = place[of] + at - (np.cumsum(sizes) - sizes)[of]
        if len(at):
            yield from _by_document(ids[of, 0], ids[of, 1], start, np.ones(len(at), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["_id", "_tie", "spans"])

        block, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= BLOCK_BYTES:
                    if found := list(solve(block)):
                        yield batch_of(found)
                    block, size = [], 0
                last = row[0]
                block.append(row)
                size += len(row[4])
        if block and (found := list(solve(block))):
            yield batch_of(found)

    return run


def _slices(length: int):
    """Rows of a document and its shared stretches: the stretches' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for ident, tie, text, asked in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    data = text.encode()
                    rows += [(s["key"], ident, tie, s["start"], data[s["start"]:s["start"] + s["windows"] + length - 1]) for s in asked]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                     ["key", "_id", "_tie", "start", "data"])

    return run


def removal(n_bytes: int, spans: list[bytes] | None, length: int) -> np.ndarray:
    """The bytes that windows starting in the spans cover."""
    out = np.zeros(n_bytes + 1, np.int32)
    for packed in spans or ():
        start, windows = (x.astype(np.int64) for x in _unpack(packed, _SPANS))
        np.add.at(out, start, 1)
        np.add.at(out, start + windows + length - 1, -1)
    return np.cumsum(out[:-1]) > 0


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text).alias("_tie"), text.alias("text"), *more)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(_id, _tie, spans): for each document with repeats, its packed (start, windows) runs. docs: _id, _tie, text."""
    spark = docs.sparkSession
    gram = min(gram, length)
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = "bucket int, kind int, payload binary"
    sent = docs.mapInArrow(giving_back(_mapper(buckets, crowded_keys(docs, length, gram), length, gram)), records)
    settled = written(sent.repartition("bucket").mapInArrow(giving_back(lambda b: _settle(length, key_bytes, b)), _SETTLED), "stretches")
    # a table row that stands there twice asks once
    texts = lambda kind, *of: docs.join(settled.where(F.col("kind") == kind).groupBy("_id", "_tie").agg(
        F.collect_list(F.struct(*of)).alias("asked")), ["_id", "_tie"]).select("_id", "_tie", "text", "asked")
    spans = settled.where("kind = 1").select("_id", "_tie", "spans")
    if not settled.where("kind = 2").isEmpty():
        alone = texts(2, "start", "windows").mapInArrow(giving_back(_one_by_one(buckets, length)), records)
        # equal windows of equal hashes are all settled here: 128 bits tell them apart
        spans = spans.union(alone.repartition("bucket").mapInArrow(giving_back(lambda b: _settle(length, None, b)), _SETTLED).where("kind = 1").select("_id", "_tie", "spans"))
    pieces = texts(0, "key", "start", "windows").mapInArrow(giving_back(_slices(length)), "key long, _id long, _tie long, start long, data binary")
    found = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(giving_back(_expand(length)), "_id long, _tie long, spans binary")
    return spans.union(found)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
          kept: str = "kept", report: str = "report", key_bytes: int = KEY_BYTES) -> DataFrame:
    """docs with two more columns: `kept` (the bytes that stay; with decoded a string, without cut characters) and `report`, a struct of n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes and matches never cross documents. Strings are judged on the
    input: a byte goes if any string of `length` bytes over it starts earlier as well, by ascending
    id (null ids first), rows of equal id in the order of a hash of their texts. Null and empty texts
    and texts under `length` bytes keep everything; rows equal in id and text are one document
    to each other and get equal results; all columns of docs stay, and the two
    new ones are named by the caller, apart from those; an empty table gives an empty result.
    """
    cols = docs.columns
    own_id, own_tie, own_spans = (free(c, cols) for c in ("_id", "_tie", "spans"))
    keyed = docs.withColumns({own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), own_tie: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    spans = repeated_spans(_keyed(docs, id_col, text_col), length, gram, key_bytes)
    spans = spans.groupBy(F.col("_id").alias(own_id), F.col("_tie").alias(own_tie)).agg(F.collect_list("spans").alias(own_spans))
    joined = keyed.join(spans, [own_id, own_tie], "left").select(*map(quoted, cols), own_spans)
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                left, reports = [], []
                for text, runs in zip(part.column(at), part.column(len(cols))):
                    data = (text.as_py() or "").encode()
                    runs = runs.as_py()
                    if runs:
                        gone = removal(len(data), runs, length)
                        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                        n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    else:
                        rest, n_spans = data, 0
                    left.append(rest)
                    reports.append({"n_bytes": len(data), "n_removed": len(data) - len(rest), "n_spans": n_spans, "kept_sha256": hashlib.sha256(rest).hexdigest()})
                if decoded:
                    left = [k.decode("utf-8", "ignore") for k in left]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(cols)], pa.array(left, pa.string() if decoded else pa.binary()), pa.array(reports, kind)], [*cols, kept, report])

    more = StructType.fromDDL(f"{kept} {'string' if decoded else 'binary'}, {report} struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    return joined.mapInArrow(giving_back(run), StructType([*docs.schema.fields, *more.fields]))
