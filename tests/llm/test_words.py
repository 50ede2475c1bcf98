"""Words of op7 and batches of the pipeline: what they hold."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("provlog.llm")

from provlog.llm import packing, recompression  # noqa: E402
from provlog.llm.common import tokenizer_file  # noqa: E402


def test_words_are_those_of_split():
    rng = random.Random(3)
    for _ in range(500):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab \t\n\v\f\r é\x00\x1c\x85") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]
        words, split = recompression.Words(texts), [(t or "").encode().split() for t in texts]
        flat = [w for ws in split for w in ws]
        assert words.counts.tolist() == [len(ws) for ws in split]
        assert [words.segment(i, i + 1) for i in range(len(flat))] == flat
        assert len(set(zip(flat, words.name.tolist()))) == len(set(flat)) == len(set(words.name.tolist()))


def test_words_hold_no_object_each():
    text = " ".join(f"w{i}" for i in range(200_000))
    tracemalloc.start()
    try:
        words = recompression.Words([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words.name) == 200_000 and peak < 140 * 200_000  # 189 bytes a word with an object for each


def test_ids_of_odd_words_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = tokenizer_file("word_bpe_49k.json"), random.Random(5)
    tok = Tokenizer.from_file(path)
    signs = list("abzAEJSTK01 9 \t\n\v\f\r.,'-_=<|`@#  \x00\x1c\x85\xa0\u2003éÀß×÷ÿİΣςǅªº²٣½漢한\u1100\u1161😀\u0301\u0338\u030c\u0345\u037e\u212aﬁ’…") + ["'s", "'ll", "'RE", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "İ.", "the", "=\u0338", "J\u030c"]
    for block in (1, 9, 1 << 20):
        monkeypatch.setattr(packing, "BLOCK", block)
        words = packing.WordIds(path)
        for _ in range(60):
            some = rng.sample(signs, rng.randint(2, len(signs)))
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
            got = [np.frombuffer(ids, "<u4").tolist() for ids in words.batch(texts)]
            assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts], texts


def test_new_words_go_to_the_tokenizer_many_at_once():
    class Counting:
        texts = 0

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            Counting.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    words, rng = packing.WordIds(tokenizer_file("word_bpe_49k.json")), random.Random(6)
    for name, value in list(vars(words).items()):
        if hasattr(value, "encode_batch_fast"):
            setattr(words, name, Counting(value))
    new = {"".join(rng.choices("abcdefghijklmnoprstuéü", k=9)) for _ in range(3000)}
    words.batch([" ".join(w + rng.choice(["", ".", "***", "$$$"]) for w in new)])
    assert Counting.texts < len(new) / 50  # one text for each word, before
    assert len(words.known) < len(new) + 10


def test_stages_of_the_pipeline_hand_small_batches_to_python(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"text {i} of some words", "en", "a", 20) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for _, stage in pipeline.STAGES[1:]:
            spark.conf.set(key, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
