"""Decoding reads the offsets that encoding kept."""

from __future__ import annotations

import pytest

pytest.importorskip("provlog.llm")
from pyspark.sql import functions as F  # noqa: E402

from provlog.llm import bpe  # noqa: E402
from provlog.llm.common import tokenizer_file  # noqa: E402


def test_decoding_fails_where_offsets_are_wrong(spark):
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    texts = [(1, "it's a text \u6f22\u5b57"), (2, None), (3, ""), (4, "more of it")]
    encoded = bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), ranks)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded, ranks).collect()} == {i: t or "" for i, t in texts}
    wrong = encoded.withColumn("offsets", F.transform("offsets", lambda x: x + F.when(x > 0, 1).otherwise(0)))
    with pytest.raises(Exception, match="offsets"):
        bpe.decode(wrong, ranks).collect()
