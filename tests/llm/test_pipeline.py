"""The pipeline's stages on a small corpus with planted cases."""

import hashlib
import random

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from plumbline.llm import simhash  # noqa: E402

from .test_operators import brute_contamination, brute_dedup, prose  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage, item = prose(rng, 60), prose(rng, 40)
    texts = [prose(rng, 60) for _ in range(80)]
    for i in range(0, 80, 5):
        words = texts[i].split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron"]))
        texts[i] = " ".join(words)
    texts += [texts[1]] * 3 + [texts[2].upper()]
    texts += [prose(rng, 15) + " " + passage + " " + prose(rng, 15) for _ in range(3)]
    texts += [prose(rng, 10) + " " + item + " " + prose(rng, 10), prose(rng, 900) + " " + " ".join(item.split()[:20])]
    texts += [None, "", "short"]
    rows = [(i, t, "en", "src0", len(t or ""), 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages(spark, corpus):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.schema
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in columns]
            path = f"{folder}/stage{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            assert set(before) - set(after) == {i for i in range(0, 80, 5)}
        elif k == 1:
            prints = {i: simhash.fingerprint(t) for i, t in before.items()}
            assert all(any(bin(prints[i] ^ prints[j]).count("1") <= 2 for j in before if j != i) for i in set(before) - set(after))
            assert not {80, 81, 82} & set(after) and 1 in after
        elif k == 2:
            want = brute_dedup(list(before.items()), 100)
            for i, t in before.items():
                n, gone, _, digest = want[i, t or ""]
                assert (i in after) == (gone == 0 or gone < n)
                if i in after and gone == 0:
                    assert after[i] == t
                elif i in after:
                    assert len(after[i].encode()) <= n - gone
            assert any(w[1] for w in want.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.where("text is not null").collect())
        elif k == 3:
            assert set(before) - set(after) == {i for i, t in before.items() if brute_contamination(t, [("b1", item)])[-1]} != set()
        seen.append(name)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(before) and len(seen) == 5
    assert all(r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]] or "").encode()).hexdigest() for r in rows)
    whole = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r["doc_id"], r["ids_sha256"]) for r in rows}


def test_batches_are_bounded_by_bytes(spark, corpus):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 1200, 1, 1).selectExpr("id as doc_id", "repeat('ab ', 4000) as text")
    try:
        dict(corpus_pipeline.STAGES)["byte_level_bpe"](spark, docs, corpus[0])
        sizes = docs.mapInArrow(lambda bs: (pa.record_batch({"n": [b.nbytes]}) for b in bs), "n long")
        assert sizes.agg({"n": "max"}).first()[0] < 5 << 20 and sizes.count() >= 3
        spark.conf.set(name, "1m")  # a smaller bound stays
        dict(corpus_pipeline.STAGES)["byte_level_bpe"](spark, docs, corpus[0])
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
