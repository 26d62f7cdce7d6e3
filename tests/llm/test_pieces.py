import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from panelspark.llm import common, pieces
from tests.llm.data import awkward, frame, multiset

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as file:
    MODEL = file.read()
OURS = pieces.Pieces(MODEL)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=PATH)


def library(text):
    return THEIRS.encode(text or "", add_bos=True, add_eos=True)


def both_ways(text):
    ids = OURS.encode(text)
    assert ids == library(text)
    row = np.array(ids)
    assert OURS.decode(ids) == THEIRS.decode(ids) == OURS.decode_chunk(row, np.array([0, len(row)]))[0].decode()


@pytest.mark.parametrize("text", ["", " ", "a  b", "I'll we've\n\n x", "<s> </s> <unk> <0x0A>", "▁", "▁▁a ▁ b▁c", "naïve déjà 漢字 🙂🙂", "x" * 5000, "\x00\x85  　a",
                                  "aaaa" * 300 + "!!!!" * 40, "1234567890" * 50, "ababab" * 100, "\r\n\t  \t", "漢" * 3000, "🙂" * 500])
def test_same_ids_as_the_library(text):
    both_ways(text)


def test_runs_of_spaces():
    """Pieces of spaces all have one rank, so only their places order the merges."""
    for n in range(150):
        both_ways(" " * n)
        both_ways("a" + " " * n + "the" + " " * (n // 2))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    both_ways(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheinsou ▁éè\n.,1", max_size=60))
def test_mixed_letters(text):
    both_ways(text)


def test_decoding_any_ids():
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), rng.randrange(259, 300)]) for _ in range(rng.randrange(9))]
        assert OURS.decode(ids) == THEIRS.decode(ids) == OURS.decode_chunk(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()


def test_the_pair_test_is_its_definition():
    rng = random.Random(2)
    for _ in range(5000):
        a, b = rng.randrange(len(OURS.names)), rng.randrange(len(OURS.names))
        assert OURS.compatible(a, b) == (OURS.merge(OURS.names[a] + OURS.names[b]) == [OURS.names[a], OURS.names[b]])


def test_every_prefix_has_one_last_token():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abtheinsou") for _ in range(rng.randrange(2, 25)))
        table = {0: None}
        for end in range(1, len(text) + 1):
            fitting = [t for size in range(1, end + 1) if (t := OURS.whole.get(text[end - size:end])) is not None
                       and (size == end or OURS.compatible(table[end - size], t))]
            assert len(fitting) == 1
            table[end] = fitting[0]


def test_a_model_of_another_kind_is_refused():
    at = MODEL.rindex(b"\n\x08identity")
    with pytest.raises(ValueError):
        pieces.Pieces(MODEL[:at - 2])  # without its normaliser, extra spaces would go


def test_the_memory_of_fragments_is_bounded():
    recent = common.Recent(8)
    for i in range(100):
        recent.put(i, i)
        recent.get(0)
    assert len(recent.young) + len(recent.old) <= 8 and recent.get(99) == 99 and recent.get(0) == 0 and recent.get(50) is None


def test_rows(spark):
    rows = awkward()
    got = pieces.encode(frame(spark, rows, extra=True), MODEL, digests=True, round_trip=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "`my col.x`").collect()
    want = []
    for r in rows:
        ids = library(r[1])
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(THEIRS.decode(ids).encode()).hexdigest(), "y"))
    assert multiset(map(tuple, got)) == multiset(want)
    encoded = pieces.encode(frame(spark, rows), MODEL)
    assert multiset(map(tuple, encoded.select("doc_id", "ids").collect())) == multiset((r[0], library(r[1])) for r in rows)
    assert multiset(map(tuple, pieces.decode(encoded, MODEL).select("doc_id", "text").collect())) == multiset((r[0], THEIRS.decode(library(r[1]))) for r in rows)
    assert pieces.encode(frame(spark, []), MODEL).count() == 0
