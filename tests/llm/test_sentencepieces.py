"""SentencePiece encoding, places and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("provlog.llm")
spm = pytest.importorskip("sentencepiece")
from provlog.llm import queries as Q  # noqa: E402
from provlog.llm import sentencepieces as S  # noqa: E402
from provlog.llm.common import tokenizer_file  # noqa: E402

PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "\0", "\xa0", "ß", "<s>", "<0x0A>", "<unk>", "▁▁", "\r\n", "é", "　", "zzzz", "23", ".", "‮", "�", "ﬁ", "①", "Å", "ｶﾞ", "​", "１", "㌔", "\x85", "…"]


@pytest.fixture(scope="module")
def path() -> str:
    return tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return spm.SentencePieceProcessor(model_file=path)


def texts() -> list[str]:
    rng = random.Random(3)
    fixed = ["", " ", "   a", "\n", "▁a", "a ", "a" * 3000, "漢" * 500, " " * 100 + "x", "ab " * 50, "word\n" * 200]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_ids_places_and_round_trip(path, library):
    p = S.Pieces(path)
    for text in texts():
        ids, places = p.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [x.id for x in proto.pieces]
        assert list(zip(places[:-1].tolist(), places[1:].tolist())) == [(x.begin, x.end) for x in proto.pieces]
        assert p.decode(ids) == library.decode(ids.tolist())


def test_decoding_of_any_ids(path, library):
    p, rng = S.Pieces(path), random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 8))]
        assert p.decode(np.array(ids, np.int32)) == library.decode(ids)
        assert p.decode_all(np.array(ids * 2, np.int32), np.array([len(ids), 2 * len(ids)])) == [library.decode(ids)] * 2


def test_compiled_character_map():
    normalizer = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    rules = dict(S.messages(dict(S.messages(normalizer.serialized_model_proto()))[3]))
    model = S.Model(characters=S.CharacterMap(rules[2]))
    for text in texts():
        got, source = S.normalised(model, text)
        want, offsets = normalizer.normalize(text, with_offsets=True)
        assert got == want
        data, at, mine = text.encode(), 0, []
        for c in [*got, ""]:
            mine.append(len(data[: source[at]].decode()))
            at += len(c.encode())
        assert mine == list(offsets)


def test_query(spark, tmp_path, library):
    some = [None, *texts()[:200]]
    rows = [(i, t, 1, "r") for i, t in enumerate(some)] + [(None, "a b", 1, "r"), (3, some[3], 1, "r")]
    spark.createDataFrame(rows, "doc_id long, text string, ids int, places string").repartition(3).write.parquet(f"{tmp_path}/d/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())))
    got = [tuple(r) for r in Q.op13_sentencepieces(spark, f"{tmp_path}/d").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    lists = spark.createDataFrame([(1, library.encode("a b")), (2, None), (None, [])], "id long, ids array<int>")
    assert {tuple(r) for r in S.decode(lists, tokenizer_file("piece_bpe_32k.model")).collect()} == {(1, "a b"), (2, ""), (None, "")}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert Q.op13_sentencepieces(spark, f"{tmp_path}/e").collect() == []
