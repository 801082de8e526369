"""Token counts against the library on whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "Hello world, it's 12 o'clock!!  \n\n\tdon't we'll  ",
    "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "<|endoftext",
    "Éa über ñandú œuvre – ‘x’ “y” 10€ ½²",
    "\x1c\x1d\x85 　中文 ひらがな 🙂🙂 é ‍﻿",
    "x" * 5000,
    "word " * 3000,
    "\r\n \x0b\x0c\x00",
    "ß'S 'll'LL 1a2b _x__ ...---",
]


@pytest.mark.parametrize("head", [0, 5, tc.HEAD])
def test_equals_library(spark, head):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, pre string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, PATH, head=head).collect())
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows)
    assert got == want


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(df, PATH, head=200).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in df.collect()}


def test_a_long_pre_token_that_a_third_of_rows_share_leaves_the_shuffle(spark):
    ruler, other = "=" * 300, "-" * 70
    rows = [(i, f"{ruler} word{i % 7} {other}" if i % 3 == 0 else f"text {i}" + "*" * (65 + i)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    top = [r.pre for r in tc.frequent(df.select("text"), PATH, 50).collect()]
    assert ruler in top and " " + other in top and not any(p.startswith("*") for p in top)
    library = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(df, PATH, head=50).collect()} == {i: len(library.encode(t)) for i, t in rows}
