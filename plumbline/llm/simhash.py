"""SimHash fingerprints and exact near-duplicate components within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, giving_back, written

RADIUS = 2
#: Rows of a tile above which its comparison is dealt out as pairs of chunks.
TILE_ROWS = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if over half of the shingles' XXH64 have it set; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        spans = [data]
    else:
        starts = [0, *(ends[:-width] + 1).tolist()]
        spans = [data[a:b] for a, b in zip(starts, ends[width - 1:].tolist())]
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in spans), np.uint64, len(spans))
    over = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        over += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; row-local."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(giving_back(run), f"{id_col} {kind}, fp long")


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius of two sorted-by-bit-count arrays, block by block."""
    count = np.bitwise_count
    step = 1024
    for a in range(0, len(left), step):
        x = left[a:a + step]
        low, high = int(count(x[0])) - radius, int(count(x[-1])) + radius
        for b in range(0, len(right), step):
            y = right[b:b + step]
            if int(count(y[-1])) < low or int(count(y[0])) > high:
                continue  # the tile pair's bit counts differ beyond the radius
            i, j = np.nonzero(count(x[:, None] ^ y[None, :]) <= radius)
            if len(i):
                yield x[i], y[j]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[:len(a)], at[len(a):]
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, low)
        np.minimum.at(new, ry, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def near_links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints within the radius.

    nodes has distinct longs in `fp`. Of radius + 1 blocks of bits at least one is equal in
    any such pair, so a table of tiles is keyed by (block, its value, bit count of the rest
    in bands of radius + 1); a row is at home in one tile and a guest in the next band's.
    Tiles of more than tile_rows rows are cut into chunks and each pair of chunks is a unit of
    its own, so no tile is ever gathered whole. Each unit is compared exactly and emits a
    spanning forest, never all its pairs.
    """
    k = radius + 1
    cuts = [64 * i // k for i in range(k + 1)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    masks = [signed(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i]) for i in range(k)]
    band = lambda m: F.floor(F.bit_count(F.col("fp").bitwiseAND(F.lit(signed(~m & ((1 << 64) - 1))))) / k).cast("int")
    homes = nodes.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"), band(m).alias("band"))
        for i, m in enumerate(masks)))).alias("t")).select("fp", "t.*")
    rows = homes.select("fp", "block", "value", F.explode(F.array(
        F.struct("band", F.lit(True).alias("home")),
        F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))).alias("t")).select("fp", "block", "value", "t.*")
    key = ["block", "value", "band"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    # most tiles hold a single row: they are gone before the rows move
    sizes = sizes.where("n > 1").withColumn("chunks", F.ceil(F.col("n") / tile_rows).cast("int"))
    rows = rows.join(sizes.drop("n"), key).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    units = rows.select(
        "fp", "home", "chunk", *key,
        F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                              lambda c: F.struct(F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi")))).alias("u"))
    units = units.select("fp", "home", F.xxhash64(*key, "u.lo", "u.hi").alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        fp, home, unit = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in range(3))
        fp = fp.view(np.uint64)
        order = np.lexsort((np.bitwise_count(fp), unit))
        fp, home, unit = fp[order], home[order], unit[order]
        cut = np.flatnonzero(np.diff(unit)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(unit)]):
            if b - a < 2 or not home[a:b].any():
                continue
            own, all_ = np.unique(fp[a:b][home[a:b]]), np.unique(fp[a:b])
            own, all_ = own[np.argsort(np.bitwise_count(own), kind="stable")], all_[np.argsort(np.bitwise_count(all_), kind="stable")]
            held_a, held_b = np.empty(0, np.uint64), np.empty(0, np.uint64)
            for x, y in _links(own, all_, radius):
                # fold what is there into a forest, so that a dense tile stays small
                held_a, held_b = _forest(np.concatenate([held_a, x]), np.concatenate([held_b, y]))
            linked = held_a != held_b
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(held_a[linked].view(np.int64)), pa.array(held_b[linked].view(np.int64))], ["a", "b"])

    return units.repartition("unit").mapInArrow(giving_back(run), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of each document.

    Columns: the id, fingerprint (16 lowercase hex digits), component_id (smallest id that
    links of at most `radius` differing bits reach). Null and empty texts have fingerprint
    zero and link like any other; repeated rows are each returned and share a component; rows
    with a null id get the smallest non-null id of their component, or null if there is
    none; other columns are ignored; an empty table gives an empty result. Equal
    fingerprints are one node, so groups of copies cost one row however large they are.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
