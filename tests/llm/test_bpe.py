"""The transducer against two public implementations, definitions and round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import bpe

FOLDER = os.path.dirname(bpe.DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def merges():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        return bpe.MergeList.parse(f.read())


@pytest.fixture(scope="module")
def lookahead(merges):
    return merges.sufficient_lookahead()


@pytest.fixture(scope="module")
def public(merges):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


TEXTS = ["", " ", "Hello world", "it's they'll I'd", "<|endoftext|> text", "a" * 5000, " \n\t" * 2000, "日本語のテキスト 123", "🙂🙂‍👍", "x̀é�", "'l", "'ll", " '", "  a", " \x1c\x85 b", "=" * 700 + "a"]


def test_texts(merges, lookahead, public):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in TEXTS:
        want = public.encode_ordinary(t)
        assert bpe.encode_text(merges, lookahead, t) == want == other.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_random_texts(merges, lookahead, public, text):
    text = text.encode("utf-8", "replace").decode()
    want = public.encode_ordinary(text)
    assert bpe.encode_text(merges, lookahead, text) == want
    d = bpe.TextDecoder(merges)
    assert "".join(map(d.feed, want)) + d.finish() == text


@pytest.mark.parametrize("alphabet", ["ab", " \n", "the of and", "0123456789", "=-_", "s'll ation", "éü日本"])
def test_slices_of_any_size(merges, lookahead, public, alphabet):
    rnd = random.Random(alphabet)
    for n in (50, 6000):
        text = "".join(rnd.choice(alphabet) for _ in range(n)) + alphabet[0] * n
        t, got, k = bpe.TextTransducer(merges, lookahead), [], 0
        while k < len(text):
            size = rnd.choice([1, 3, 500, 4097])
            got += t.feed(text[k : k + size])
            assert len(t.held) <= bpe.BLOCK + size + bpe.UNSETTLED
            k += size
        got += t.feed("", final=True)
        assert got == public.encode_ordinary(text)


def test_lookahead_suffices_and_memory_is_constant(merges, lookahead):
    rnd = random.Random(3)
    for alphabet in ("ab", "etaoin", "-=", "0"):
        data = "".join(rnd.choice(alphabet) for _ in range(9000)).encode()
        t, got, held = bpe.BytesTransducer(merges, lookahead), [], 0
        for k in range(0, len(data), 100):
            got += t.feed(data[k : k + 100])
            held = max(held, len(t.bytes))
        got += t.finish()
        assert b"".join(merges.tokens[i] for i in got) == data
        assert got[:50] == [merges.ranks[x] for x in merges.merge(data[:1000])][:50]
        assert held <= lookahead + merges.longest + 100


def test_small_merge_list():
    ranks = {bytes([b]): k for k, b in enumerate(b"abc")} | {b"ab": 3, b"abc": 4, b"bc": 5, b"ca": 6, b"abab": 7}
    m = bpe.MergeList(ranks)
    ahead = m.sufficient_lookahead()
    rnd = random.Random(9)
    for _ in range(300):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30)))
        t = bpe.BytesTransducer(m, ahead)
        got = [i for k in range(len(data)) for i in t.feed(data[k : k + 1])] + t.finish()
        assert got == [ranks[x] for x in m.merge(data)]


def test_frames(spark, merges, public):
    rows = [(k, t, 1) for k, t in enumerate([*TEXTS, None, TEXTS[2], "y" * 200_000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {k: public.encode_ordinary(t or "") for k, t, _ in rows}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().text is None
