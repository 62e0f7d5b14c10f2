"""Near copies in the fit of the toxicity lexicon."""

import random

from plumbline.llm import toxicity

from .test_operators import prose


def test_no_label_is_lent_to_a_near_copy(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(8)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(100 + i, t + " moronic", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert " moronic " in lexicon.weights and all(e.startswith(" moro") for e in lexicon.weights)
