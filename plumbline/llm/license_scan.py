"""Licence detection by a positional index of rare template words.

Every template (a phrase, or a licence's opening words) is cut into words; the words that
occur in the fewest templates have the highest IDF; the ANCHORS rarest of its mandatory phrase are its anchors. A file's
words are looked up in the anchor postings (template, position). The difference of a word's position in the file and
in the template is where the template would begin: the places that the postings of all its anchors have in common
are its alignments. Only these are verified word by word: the mandatory phrase must stand there whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The method's own templates: label, opening words, and the phrase that must be there.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "the bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
]

#: Words of a mandatory phrase whose postings are intersected.
ANCHORS = 3

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Index:
    """Anchor postings of all phrases and templates."""

    def __init__(self, phrases=None, templates=None, anchors: int = ANCHORS, near: float = 0.8):
        phrases = BASE_PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        self.near = near
        self.entries = [(label, [w.encode() for w in text.split()], [w.encode() for w in text.split()], True) for text, label in phrases.items()]
        self.entries += [(label, [w.encode() for w in text.split()], [w.encode() for w in must.split()], False) for label, text, must in templates]
        df = Counter(w for _, words, _, _ in self.entries for w in set(words))
        self.idf = {w: log((1 + len(self.entries)) / (1 + n)) + 1 for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.n_anchors = [min(anchors, len(must)) for _, _, must, _ in self.entries]
        for t, (_, words, must, _) in enumerate(self.entries):
            # a place needs its whole mandatory phrase, so all its anchors stand there; of equally rare words the longer, then the first
            at = next(i for i in range(len(words)) if words[i:i + len(must)] == must)
            for p in sorted(range(len(must)), key=lambda p: (-self.idf[must[p]], -len(must[p]), p))[:anchors]:
                self.postings[must[p]].append((t, at + p))
        longest_first = sorted(self.postings, key=len, reverse=True)
        edge = rb"[0-9a-z\x80-\xff]"
        self.find = re.compile(rb"(?<!" + edge + rb")(?:" + b"|".join(map(re.escape, longest_first)) + rb")(?!" + edge + rb")")

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score of one text."""
        data = text.encode().translate(_LOWER)
        is_word = _IS_WORD[np.frombuffer(data, np.uint8)]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        n_words = int(np.count_nonzero(begins))
        hits = [(m.start(), m.group()) for m in self.find.finditer(data)]
        if not hits:
            return n_words, 0, None, None, "", "", 0.0
        starts = np.flatnonzero(begins)
        # an anchor is met once at a place, so a place that all anchors of a template have is counted as often
        met = Counter()
        for at, (_, word) in zip(np.searchsorted(starts, [at for at, _ in hits]).tolist(), hits):
            met.update([(t, at - p) for t, p in self.postings[word]])
        places = [(t, at) for (t, at), n in met.items() if n == self.n_anchors[t]]
        ends = np.flatnonzero(is_word & ~np.append(is_word[1:], False)) + 1
        word = lambda i: data[starts[i]:ends[i]] if 0 <= i < n_words else None
        base_places, base, labels, score = [], set(), set(), 0.0
        for t, at in places:
            label, words, must, is_base = self.entries[t]
            got = [word(at + i) == w for i, w in enumerate(words)]
            if is_base:
                if all(got):
                    base_places.append(at)
                    base.add(label)
                    labels.add(label)
                    score = 1.0
                continue
            first = next(i for i in range(len(words)) if words[i:i + len(must)] == must)
            if not all(got[first:first + len(must)]):
                continue
            weight = sum(self.idf[w] for w in words)
            share = sum(self.idf[w] for w, ok in zip(words, got) if ok) / weight
            labels.add(label)
            score = max(score, min(1.0, share / self.near))
        return (n_words, len(base_places), min(base_places, default=None), max(base_places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan_licenses(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence places and labels of each text.

    Columns: the id, n_words, n_base (places of the base phrases, overlaps included),
    first_word and last_word (smallest and largest start of such a place; null if none),
    base_labels, labels (sorted, comma-joined; empty if none), score (1 with a base phrase,
    else the best aligned template's IDF-weighted share of matching words, from 0 to 1).
    A null text counts as empty: 0 words, no labels, score 0. Repeated rows are each
    returned; other columns are ignored; an empty table gives an empty result. Row-local.
    """
    index = index or Index()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(index.scan(x.as_py() or "") for x in batch.column(1)))) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
