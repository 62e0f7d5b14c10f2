"""Language identification by nearest TF-IDF n-gram centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed dimensions, centroids a language, and labelled rows of the fit (documented bound), shared by the languages.
DIMENSIONS, CENTROIDS, FIT_ROWS = 4096, 3, 6_000
#: A text farther from its centroid than all but this share of the training texts is `rejected`.
REJECT_SHARE = 0.005

_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(texts: list[str | None]) -> np.ndarray:
    """Log-damped counts of hashed 1- to 3-grams of letters; a row for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "
        if len(raw) < 3:
            continue
        x = np.frombuffer(raw, np.uint8).astype(np.uint32)
        two = x[:-1] * 257 + x[1:] + 70_000
        three = two[:-1] * 263 + x[2:] + 9_000_000
        grams = np.concatenate([x * 31, two, three])
        grams = (grams * np.uint32(2654435761)) >> np.uint32(20)
        out[i] = np.log1p(np.bincount(grams, minlength=DIMENSIONS))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Centroids:
    def __init__(self, langs: list[str], idf: np.ndarray, vectors: np.ndarray, of: np.ndarray, radius: np.ndarray):
        self.langs, self.idf, self.vectors, self.of, self.radius = langs, idf, vectors, of, radius

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x = counts(texts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cosine = x @ self.vectors.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(x)), best], 0, 1).astype(float)
        named = [self.langs[self.of[b]] if has_letter(t) else "und" for b, t in zip(best, texts)]
        known = np.array([n != "und" for n in named], bool)
        return named, np.where(known, top, 0.0), known & (1 - top > self.radius[best])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean, then the farthest rows."""
    mean = x.mean(axis=0)
    seeds = [int((x @ mean).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learn centroids from a bounded sample of the rows that `train` (a column) admits.

    About FIT_ROWS rows, as many of each language where there are so many, are taken by a hash of
    the id (one pass counts the languages, one reads the sample; only hashed counts of the
    sample reach the driver). Rows with a null text, language or id teach nothing.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        known = known.where(train)
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return Centroids(["und"], np.ones(DIMENSIONS, np.float32), np.zeros((1, DIMENSIONS), np.float32), np.zeros(1, int), np.ones(1))
    langs = sorted(sizes)
    share = F.create_map(*(F.lit(v) for lang in langs for v in (lang, min(1.0, FIT_ROWS / len(langs) / sizes[lang]))))
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("y"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = counts(part.column(1).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    got = sample.mapInArrow(run, "y string, x binary").collect()
    y = np.array([langs.index(r["y"]) for r in got], int)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIMENSIONS), np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    norm = np.linalg.norm(x, axis=1)
    x, y = x[norm > 0] / norm[norm > 0, None], y[norm > 0]
    vectors, of, radius = [], [], []
    for j in range(len(langs)):
        own = x[y == j]
        if not len(own):
            continue
        c = _clusters(own, CENTROIDS)
        far = 1 - (own @ c.T).max(axis=1)
        vectors.append(c)
        of += [j] * len(c)
        radius += [float(np.quantile(far, 1 - REJECT_SHARE))] * len(c)
    if not vectors:
        return Centroids(langs, idf, np.zeros((1, DIMENSIONS), np.float32), np.zeros(1, int), np.ones(1))
    return Centroids(langs, idf, np.concatenate(vectors).astype(np.float32), np.array(of), np.array(radius))


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row.

    score is the cosine to the nearest centroid; rejected tells that the text lies farther
    from it than nearly all training texts of that language. A null text, or one without a
    letter, is `und` with score 0. Repeated rows are each returned; other columns are
    ignored; an empty table gives an empty result. Row-local; the model is a few hundred
    kilobytes whatever the input.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                named, top, odd = model.nearest(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(top, pa.float64()), pa.array(odd, pa.bool_())],
                                                 [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")
