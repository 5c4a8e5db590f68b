import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from cartulario.llm.bpe import TOKENIZERS, VOCABULARY, WORDS, Speculator, count_tokens, encode_texts


@pytest.fixture(scope="module")
def truth():
    ranks = {}
    for line in open(f"{TOKENIZERS}/{VOCABULARY}", "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(7)
    letters = "aeiouñáéíóúbcdfglmnprstvzAEIOU       \n\t'0123456789.,;:¿?!–—«»|#😀字 ‍"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    return [*out, "<|endoftext|> texto", "x" * 3000, " " * 900, "a" * 513 + "b" * 700, "don't we'll  \n\n  fin ", "﻿\u0000"]


def test_same_as_exact_encoder(truth):
    model = Speculator(f"{TOKENIZERS}/{VOCABULARY}")
    texts = samples()
    flat, sizes = model.encode(texts)
    at = 0
    for text, n in zip(texts, sizes):
        assert flat[at : at + n].tolist() == truth.encode_ordinary(text), text[:60]
        at += n


def test_memory_of_words_may_begin_anew(truth, monkeypatch):
    import cartulario.llm.bpe as bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    model = Speculator(f"{TOKENIZERS}/{VOCABULARY}")
    for text in samples()[:40]:
        flat, _ = model.encode([text])
        assert flat.tolist() == truth.encode_ordinary(text)


def test_null_empty_repeated_and_extra_columns(spark, truth):
    rows = [(1, None), (2, ""), (3, "Código Civil"), (3, "Código Civil"), (4, "hola " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("__text", F.lit(1))
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, "doc_id", "text").collect())
    want = sorted((i, truth.encode_ordinary(t) if t else []) for i, t in rows)
    assert got == want
    counts = sorted(tuple(r) for r in count_tokens(df, ["doc_id"], "text").collect())
    assert counts == sorted((i, len(x)) for i, x in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(df, "doc_id", "text").collect() == []
