"""op3 on texts that hold the strings of the tokenizer's added tokens."""

import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dwelltrace.llm import registry, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "x <|endoftext|> y",
    "<|endoftext|>",
    " <|endoftext|><|endoftext|>\n\nword's <|endoftext|>x",
    "end <|endoftext|>",
    "a  <|endoftext|>  b <|endoftext <|endoftext|>|>",
    "plain text of no token",
    "",
]


def test_query_encodes_added_tokens_as_the_library_does(spark, tmp_path):
    rows = [(i, text) for i, text in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.op3_token_files(spark, str(tmp_path)).collect()}
    library, start = Tokenizer.from_file(JSON), 0
    for doc, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert out[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_tokens_that_look_beside_them():
    with open(JSON, encoding="utf-8") as file:
        data = json.load(file)
    (token,) = data["added_tokens"]
    for change in ({}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        data["added_tokens"] = [token | change]
        text = json.dumps(data)
        library = Tokenizer.from_str(text)
        encoded = token_files.IdEncoder(text, public_tokenizers.PATTERN, True).encode(TEXTS)
        expected = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
        assert [np.frombuffer(own, "<u2").tolist() for own in encoded] == expected, change


def test_matches_go_to_the_model_once_each():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    texts = ["", " ", "it's  12,5 é́ ’s", "\t a\n\n b \x00\x1c c", "😀 word word. word!", "çà là <|endoftext|> x", "ab" * 99]
    library = Tokenizer.from_str(text)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = token_files.IdEncoder(text, public_tokenizers.PATTERN, True)
    assert [np.frombuffer(own, "<u2").tolist() for own in encoder.encode(texts)] == expected
    asked, model = [], encoder._model
    encoder = token_files.IdEncoder(text, public_tokenizers.PATTERN)
    encoder._tokenizer = None
    encoder._model = type("Counted", (), {"tokenize": lambda self, signs: asked.append(signs) or model.tokenize(signs)})()
    encoder.encode(["one two, one", "two. one two!", "one"] * 300)
    assert len(asked) == len(set(asked))
