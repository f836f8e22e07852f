import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from polyquill.llm import bpe

PATH = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
MULTI = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_multi_50k.tiktoken")


def public(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize("path", [PATH, MULTI])
def test_as_the_public_encoder(path):
    own, other = bpe.ByteBPE(bpe.load_ranks(path)), public(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def check(text):
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text

    check()
    for text in ("a" * 5000, "你好" * 3000, "<|endoftext|> x", " \n\n  x'll", "ha" * 4000 + "h", "가나다라" * 500):
        assert own.encode(text) == other.encode_ordinary(text)


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, "", 5), (3, None, 5), (None, "x" * 20000, None)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 2
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {1: "a b", 2: "", 3: "", None: "x" * 20000}
    counted = {r.doc_id: (r.ids, r.n_tokens) for r in bpe.token_counts(df).collect()}
    assert counted[1] == (5, 2) and counted[3] == (5, 0)
    assert bpe.encode(df.limit(0)).count() == 0
