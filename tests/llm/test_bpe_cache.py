"""What a BPE worker keeps between tasks."""

import base64
import time
import weakref

import numpy as np

from plumbline.llm import bpe
from plumbline.llm.common import giving_back


def test_the_next_task_begins_with_what_the_last_one_met():
    codec = bpe.Codec({bytes((i,)): i for i in range(256)} | {b"ab": 256, b"abc": 257}, r" ?\p{L}+|\s+")
    codec.keep = 0.3
    with codec:
        want = codec.encode("abc ab cab")
        assert codec.pieces
    assert codec.pieces and len(codec.fst.states) > 1
    with codec:
        time.sleep(0.6)
        assert codec.pieces and codec.encode("abc ab cab") == want
    time.sleep(0.6)
    assert not codec.pieces and len(codec.fst.states) == 1
    with codec:
        assert codec.encode("abc ab cab") == want
    codec.keep = 0.0
    with codec:
        codec.encode("abc ab cab")
    assert not codec.pieces


def ranks(more: dict[bytes, int]) -> bytes:
    return b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ({bytes((i,)): i for i in range(256)} | more).items())


def test_an_unused_codec_is_given_back_whole(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_SECONDS", 0.3)
    codec = bpe.codec_of(ranks({b"ab": 256}), r" ?\p{L}+")
    with codec:
        codec.encode("ab ba")
    assert bpe.codec_of(ranks({b"ab": 256}), r" ?\p{L}+") is codec  # the next task of the stage
    left = weakref.ref(codec)
    del codec
    time.sleep(0.8)
    assert not bpe._CODECS and left() is None


def test_a_smaller_cache_gives_the_same_ids():
    vocabulary = {b"ab": 256, b"abc": 257, b"bc": 258, b" a": 259}
    whole, small = (bpe.Codec(bpe.read_ranks(ranks(vocabulary)), r" ?\p{L}+") for _ in range(2))
    small.fst.share = 3 / bpe.CACHE_STATES
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = " ".join("".join(rng.choice([*"abc"], 6)) for _ in range(5))
        assert small.encode(text) == whole.encode(text)
    assert len(small.fst.states) <= 3 < len(whole.fst.states) and len(small.pieces) <= 20


def test_a_task_gives_its_memory_back():
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        top.append(bytes(2000))  # what lives on above keeps the heap from shrinking by itself
        yield len(held)

    top: list[bytes] = []
    before = resident()
    assert [*giving_back(run)(iter(()))] == [100_000] and resident() < before + 60
