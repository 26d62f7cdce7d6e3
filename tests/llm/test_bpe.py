import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelspark.llm import bpe
from tests.llm.data import awkward, frame, multiset
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS = bpe.Vocabulary(bpe.read_vocabulary(PATH))
THEIRS = Tokenizer.from_file(PATH)
THEIRS.no_truncation()
THEIRS.no_padding()


def library(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a  b", "I'll we've\n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "naïve déjà 漢字 🙂🙂", "x" * 5000, "\x00\x85  　a",
                                  "aaaa" * 300 + "!!!!" * 40, "1234567890" * 50, "ababab" * 100, "\r\n\t  \t"])
def test_same_ids_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == library(text) and OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert OURS.encode(text) == library(text) and OURS.decode(OURS.encode(text)) == text


def test_decoding_broken_sequences():
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(1, 12))]
        assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token():
    for token in OURS.ids:
        assert OURS.cut(token) == [token]
    assert OURS.cut(b"ab\xff\xffcd")[0].startswith(b"ab") and len(OURS.cut(b"ab\xff\xffcd")) > 1
    assert all(OURS.merge(w) == OURS.merge_long(w) for w in [b"hello", b"antidisestablishment", b"aaaaaaa", b"a"])


def test_rows(spark):
    rows = awkward()
    content = bpe.read_vocabulary(PATH)
    got = bpe.encode(frame(spark, rows, extra=True), content, digests=True, round_trip=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = []
    for r in rows:
        ids = library(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert multiset(map(tuple, got)) == multiset(want)
    encoded = bpe.encode(frame(spark, rows), content)
    back = bpe.decode(encoded, content).select("doc_id", "text").collect()
    assert multiset(map(tuple, back)) == multiset((r[0], r[1] or "") for r in rows)
    assert bpe.encode(frame(spark, []), content).count() == 0
