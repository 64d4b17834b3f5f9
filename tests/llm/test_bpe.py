import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from traitforge.llm.bpe import WordBpe, encode_documents, tokenizer_path

PATH = tokenizer_path()
BPE = WordBpe(open(PATH, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(PATH)
HARD = [
    None, "", " ", "hello world", "  The quick\tbrown\nfox's they'll WE'RE ", "ﬁne Ångström été naïve", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul", "½²³ 12345 ٣٤", "!!!??..--'' ''s", "<|endoftext|>a<|startoftext|> b<|endoftext|", "x\x1cy\x1f z\x00\x01", "<|ENDOFTEXT|>", "a <|EndOfText|> b", "<|ENDOFTEXT|><|endoftext|><|StartOfText|>", "<|endoftext|><|endoftext|>x<|endoftext", "<|<|endoftext|>|>", "\U0001fae8 \U0001fadc\U000e0fff new", "日本語テキスト 한국어", "🎉🎉👍🏽", "a" * 5000, "thththth" * 300, " wide　space\x85next x", "anblewh sttible athawh thonre oftionnten enti", "|||___ $$$%%% ***", "̀́ x", "don't can't 'tis 's 't", "᠎​﻿ x",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), len(ids), LIBRARY.decode(ids, skip_special_tokens=False)


def test_hard_texts_match_library():
    ids, counts, decoded = BPE.encode_batch(HARD)
    for text, got in zip(HARD, zip(ids, counts, decoded, strict=True), strict=True):
        assert got == expected(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abcdehinorst' ", max_size=80)), max_size=6))
def test_random_texts_match_library(texts):
    assert list(zip(*BPE.encode_batch(texts), strict=True)) == [expected(t) for t in texts]


def test_query_encodes_every_row(spark):
    docs = spark.createDataFrame([(k % 7 if k else None, t, "x") for k, t in enumerate(HARD * 2)], "doc_id long, text string, n_tokens string")
    rows = encode_documents(docs, PATH).collect()
    assert sorted(((r.ids, r.n_tokens, r.decoded) for r in rows)) == sorted(expected(t) for t in HARD * 2)
    assert encode_documents(docs.limit(0), PATH).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(expected(None)[0].encode()).hexdigest()


def test_unsupported_file_is_refused():
    with pytest.raises(ValueError):
        WordBpe(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read().replace('"normalizer":null', '"normalizer":{"normalizers":[]}').replace('"normalizer": null', '"normalizer": {"normalizers": []}'))
