"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlens.llm import piece_bpe as B
from ledgerlens.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B.MODEL))


@pytest.fixture(scope="module")
def own():
    return B.PieceCodec(B.vocabulary(public_tokenizers.path(B.MODEL)))


def texts(own, n, seed):
    rng, vocab = random.Random(seed), list(own.ids)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            yield "".join(rng.choice(vocab).replace(B.SPACE, rng.choice([" ", B.SPACE])) for _ in range(rng.randint(0, 12)))
        elif kind < 0.7:
            yield "".join(rng.choice("abcdeilnorst  \n\t.'é▁汉\x00\U0001f600①Z9") for _ in range(rng.randint(0, 60)))
        else:
            yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 20)))


def test_equals_the_library(own, library):
    for text in texts(own, 3000, 1):
        want = library.encode(text)
        assert own.encode(text).tolist() == want and own.decode(want) == library.decode(want)


def test_backtracking_needs_no_cuts(own, library):
    """Whole texts as one word: the search alone, without words."""
    for text in texts(own, 500, 2):
        ids = []
        for piece in own.pieces(B.SPACE + text.replace(" ", B.SPACE)) if text else []:
            ids += [own.ids[piece]] if piece in own.ids else [own.byte_ids[b] for b in piece.encode()]
        assert ids == library.encode(text)


def test_goes_back_where_the_longest_piece_does_not_fit(own):
    """Some words are not cut by longest pieces alone."""
    greedy = 0
    for word in ("▁unhappiness", "▁theretofore", "▁misunderstandings", "▁notwithstanding", "▁whereabouts", "▁deshalb", "▁aujourdhui"):
        found, at = own.pieces(word), 0
        assert "".join(found) == word
        for piece in found:
            greedy += any(word.startswith(p, at) and len(p) > len(piece) for p in own.ids if p[:1] == piece[:1])
            at += len(piece)
    assert greedy


def test_decoding_any_ids(own, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), rng.randrange(130, 259)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["x" * 50_000, " " * 20_001, "ab" * 30_000, "汉" * 10_000])
def test_long_words(own, library, text):
    assert own.encode(text).tolist() == library.encode(text)


def test_full_stores_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(B, "CACHED_WORDS", 3)
    monkeypatch.setattr(B, "CACHED_PAIRS", 5)
    small = B.PieceCodec(B.vocabulary(public_tokenizers.path(B.MODEL)))
    for text in texts(own, 200, 4):
        assert small.encode(text).tolist() == library.encode(text)


def test_cut_pattern_of_other_vocabularies():
    """Spaces inside pieces are no cuts; without pieces of several characters every character stands alone."""
    import re

    inner = re.compile(B.cut_pattern(["a", "b", "a▁", "▁", "c"]))
    assert inner.findall("a▁a▁bc") == ["a▁a▁", "b", "c"]
    assert re.compile(B.cut_pattern(["a", "b"])).findall("ab") == ["a", "b"]


def test_op11(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_piece_bpe"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_columns(spark):
    """Null and empty texts, null ids, repeated rows, clashing and extra columns, an empty table."""
    ddl = "doc_id bigint, text string, ids string, n_tokens int, _t string"
    df = spark.createDataFrame([(1, None, "i", 0, "t"), (2, "", "i", 0, "t"), (None, "a b", "i", 0, "t"), (None, "a b", "i", 0, "t")], ddl)
    done = B.decode_column(B.encode_column(df, out="ids"), "ids", "back")
    assert done.columns == [*df.columns, "back"] and done.where(F.coalesce("text", F.lit("")) != F.col("back")).isEmpty()
    assert B.decode_column(df.select(F.lit(None).cast("array<int>").alias("i")), "i").where("decoded IS NOT NULL").isEmpty()
    rows = B.encoding_digests(df).collect()
    assert len(rows) == 4 and [r.n_tokens for r in rows][:2] == [0, 0]
    none = spark.createDataFrame([], ddl)
    assert B.encode_column(none).isEmpty() and B.encoding_digests(none).isEmpty()
