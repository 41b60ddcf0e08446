"""SentencePiece encoding against the library, spans and round trips."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from tessera.llm import pieces

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
ODD = ["", " ", "  a  b ", "▁x▁", "a\nb\r\n\tc", "日本語 テスト😀 x", "​\x00z", "<s> </s> <0x0A> <unk>", "é" * 50, "a" * 3000, "ﬁ①Ａ", " ́a", "﻿a"]


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_proto=MODEL)


def texts():
    rng = random.Random(3)
    alphabet = "ab c▁\n\té日😀İ<>0xA.  "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_ids_spans_and_decoding_match_the_library(library):
    of = pieces.Encoder(MODEL)
    for text, (ids, begin, end) in zip(texts(), of.encode(texts())):
        expected = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert of.decode(ids) == library.decode(expected), text
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert spans == list(zip(begin[1:-1].tolist(), end[1:-1].tolist())), text


def test_decoding_ids_that_were_not_encoded(library):
    of = pieces.Encoder(MODEL)
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert of.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_spans_cover_the_text(library):
    of = pieces.Encoder(MODEL)
    for text, (_, begin, end) in zip(texts(), of.encode(texts())):
        data = text.encode()
        assert b"".join(data[b:e] for b, e in zip(begin, end)) == data


def test_character_map_of_a_published_rule():
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sp.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    charmap = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    rng = random.Random(1)
    fancy = "ﬁ①Ａ½ｶﾞ  ㌔é日本😀　​İＡa b が́ㇰ"
    for text in ["ﬁ①Ａ", "㌔ x", "ｶﾞ"] + ["".join(rng.choice(fancy) for _ in range(30)) for _ in range(300)]:
        data, source = charmap.apply(text)
        assert len(source) == len(data) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(text.encode())
        assert re.sub(" +", " ", data.decode()).strip(" ") == library.normalize(text).replace("▁", " ").strip(" ")


def test_table(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(50, None, 2), (1, " ", 3), (None, "x y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = df.select("doc_id", "text", "ids", pieces.encoded(spark, F.col("text"), MODEL).alias("e"), pieces.digests(spark, F.col("text"), MODEL).alias("d")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["e"]["ids"] == ids and len(r["e"]["begin"]) == len(ids) and r["d"]["n_tokens"] == len(ids)
        assert r["d"]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert df.limit(0).select(pieces.encoded(spark, F.col("text"), MODEL)).collect() == []
