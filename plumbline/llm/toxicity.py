"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native
from .common import giving_back

#: Documented bounds of the fit: labelled rows of either class, by the order of a hash of the id.
FIT_TOXIC, FIT_CLEAN = 8_000, 16_000
#: Least training texts that hold an entry, and least log-odds of an entry.
LEAST_TEXTS, LEAST_WEIGHT = 5, 2.5
#: Prefix lengths that may be entries besides whole words.
PREFIXES = range(4, 9)
#: Entries kept, by weight times frequency.
ENTRIES = 5_000

# Look-alikes outside Latin-1 and its accents, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}


class _Fold(dict):
    """str.translate table: made per character when it is first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        flat = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        out = "".join(LOOK_ALIKES.get(x, x) for x in flat)
        if out and not out.isalnum() and c not in SIGNS:
            out = "" if unicodedata.category(c) in ("Cf", "Mn") else " "
        self[point] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> list[str]:
    """Folded words: lower case, look-alikes as Latin letters, digits and signs inside words as letters."""
    out = []
    for word in text.translate(_FOLD).split():
        if word.isalpha():
            out.append(word)
            continue
        if any(c.isalpha() for c in word):
            # signs at the edges are punctuation, digits and signs within are letters
            word = "".join(SIGNS.get(c, c) for c in word.strip("!|+@"))
        else:
            word = "".join(c for c in word if c.isalnum())
        if word:
            out.append(word)
    return out


def _features(words: list[str]) -> set[str]:
    """Whole words as ' word ', their prefixes as ' pre'."""
    out = set()
    for w in set(words):
        if len(w) <= 40:
            out.add(f" {w} ")
        for n in PREFIXES:
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


class Lexicon:
    """Entries with weights, exception phrases that cancel them, and the score's two coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], slope: float = 1.0, offset: float = 0.0):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.weights.items():
                self._automaton.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._automaton.add_word(e, (len(e), None))
            self._automaton.make_automaton()
        return self._automaton

    def evidence(self, text: str | None) -> float:
        """Summed weights of the matched words (the best entry of each), damped by length."""
        words = fold(text or "")
        if not words or not self.weights:
            return 0.0
        joined = f" {' '.join(words)} "
        best: dict[int, float] = defaultdict(float)
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(joined):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > best[start]:
                best[start] = w
        for a, b in excused:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()) / log(len(words) + 10.0)

    def score(self, text: str | None) -> float:
        x = max(-30.0, min(30.0, self.slope * self.evidence(text) + self.offset))
        return 1 / (1 + exp(-x))


def fit(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Lexicon:
    """Learn a lexicon from the labelled documents that `train` (a column over the id) admits.

    A bounded sample of labels (FIT_TOXIC and FIT_CLEAN rows, in the order of a hash of the id) is
    joined to the documents; the sample is small and its size known, so it is broadcast.
    Feature counts are made per partition, then summed. Rows with a null id or label
    teach nothing; ids with several labels count as toxic if one is; equal texts count once, and near copies mostly.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    pick = lambda y, n: known.where(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64(id_col), id_col).limit(n)
    sample = pick(1, FIT_TOXIC).union(pick(0, FIT_CLEAN))
    texts = (docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
             .join(F.broadcast(sample.select(F.col(id_col).alias("i"), "y")), "i").select("t", "y"))
    # near copies of one text would vote for all its words: texts of one label whose least three shingle hashes agree count once
    texts = native.with_grams(texts.withColumn("_w", native.words(F.col("t"))), "_w", "_g", 5)
    least = F.slice(F.array_sort(F.array_distinct("_g")), 1, 3)
    kind = F.when(F.size(least) == 3, least).otherwise(F.array(F.xxhash64("t")))
    sampled = texts.groupBy(kind.alias("h"), "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "y").cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        n = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                y = int(y.as_py() > 0)
                n[y] += 1
                for f in _features(fold(t.as_py())):
                    seen.setdefault(f, [0, 0])[y] += 1
        seen[""] = n
        items = list(seen.items())
        for at in range(0, len(items), 50_000):
            part = items[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part]), pa.array([c[0] for _, c in part], pa.int64()),
                                              pa.array([c[1] for _, c in part], pa.int64())], ["f", "clean", "toxic"])

    counts = sampled.mapInArrow(giving_back(count), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    total = counts.where("f = ''").first()
    n_clean, n_toxic = (total["clean"] or 0, total["toxic"] or 0) if total else (0, 0)
    if not n_clean or not n_toxic:
        sampled.unpersist()
        counts.unpersist()
        return Lexicon({}, set(), 1.0, -3.0)
    weight = F.log((F.col("toxic") + 0.1) / (n_toxic + 1) / ((F.col("clean") + 0.1) / (n_clean + 1)))
    strong = (counts.where(f"f <> '' and toxic >= {LEAST_TEXTS}").withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
              .orderBy(F.desc(F.col("w") * F.log1p("toxic")), "f").limit(ENTRIES).collect())
    weights = {r["f"]: float(r["w"]) for r in strong}
    # words of clean texts that begin like an entry are its exceptions
    starts = [e for e in weights if not e.endswith(" ")]
    exceptions = set()
    if starts:
        has = F.lit(False)
        by_length = defaultdict(list)
        for e in starts:
            by_length[len(e)].append(e)
        for n, some in by_length.items():
            has = has | F.substring("f", 1, n).isin(some)
        words = counts.where(F.col("f").endswith(" ") & has & (F.col("clean") >= 2) & (F.col("toxic") <= F.col("clean")))
        exceptions = {r["f"] for r in words.orderBy(F.desc("clean"), "f").limit(ENTRIES).collect() if r["f"] not in weights}
    lexicon = Lexicon(weights, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.evidence(t.as_py()) for t in batch.column(0)], pa.float64()),
                                              batch.column(1)], ["x", "y"])

    got = np.array([(r["x"], r["y"] > 0) for r in sampled.mapInArrow(giving_back(measure), "x double, y int").collect()], float)
    sampled.unpersist()
    counts.unpersist()
    # one-variable logistic fit; the classes weigh alike
    x, y = got[:, 0], got[:, 1]
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-3 * beta * len(y)
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2) * len(y)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if abs(step).max() < 1e-9:
            break
    lexicon.slope, lexicon.offset = max(0.0, float(beta[0])), float(beta[1])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row: predicted is 1 from the threshold on.

    Null and empty texts have no evidence and get the score of none; repeated rows are each
    returned; other columns are ignored; an empty table gives an empty result. Row-local.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [lexicon.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                                             [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(giving_back(run), f"{id_col} {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([lexicon.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
