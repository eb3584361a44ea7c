"""Texts with the literals of added tokens against the untouched library call."""

import numpy as np
from tokenizers import Tokenizer

from tilework.llm import token_counts, token_files
from tilework.llm.common import new_folder
from tilework.llm.words import default_path, encoder

TEXTS = ["end <|endoftext|> next", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "ÀÉ 日本 <|endoftext|>x", "<|ENDOFTEXT|> <| endoftext |>", "<|endoftext", "tab\x1c<|endoftext|>", "plain", ""]


def want(text):
    return Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s():
    assert want(TEXTS[0]) == [806, 49407, 1131]
    for text in TEXTS:
        assert np.frombuffer(encoder(default_path()).encode(text), "<u2").tolist() == want(text)


def test_operators(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    lengths = [len(want(t)) for t in TEXTS]
    counted = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(docs).collect()}
    assert counted == {n: lengths.count(n) for n in lengths}
    for r in token_files.round_trip(docs, new_folder(spark, "tokens")).collect():
        assert np.frombuffer(r.ids, "<u4")[:-1].tolist() == want(TEXTS[r.doc_id])
