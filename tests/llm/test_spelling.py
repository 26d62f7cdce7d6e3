import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelspark.llm import spelling
from tests.llm.data import awkward, frame, multiset


def brute_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def check(spark, words):
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert multiset(map(tuple, got.collect())) == multiset(brute_groups(words))


def family(seed, n, letters="abcdeé", size=9, edits=3):
    """Words around a few stems, so that most have near words."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, size + 1))) for _ in range(max(1, n // 20))]
    words = {}
    while len(words) < n:
        w = rng.choice(stems)
        for _ in range(rng.randrange(edits)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]])
        if len(w) >= 7:
            words.setdefault(w, rng.choice([2, 2, 3, 20, 30, 300, 5000, 100_000]))
    return words


@pytest.mark.parametrize("limit", [2, 10_000])
def test_groups_equal_brute_force(spark, monkeypatch, limit):
    """With split lists and without."""
    monkeypatch.setattr(spelling, "LIST", limit)
    check(spark, family(limit, 700))
    monkeypatch.setattr(spelling, "SHARED", 1)
    check(spark, family(5, 400, letters="ab", size=12))


def test_one_letter_words_and_common_stem(spark, monkeypatch):
    """Words of one letter, and words that are all alike, which no list can tell apart."""
    monkeypatch.setattr(spelling, "LIST", 4)
    words = {"a" * k: 10 ** (k % 6) + 1 for k in range(7, 30)}
    words |= {"commonstem"[:i] + c + "commonstem"[i:]: 2 + i for i in range(11) for c in "abcxyzéü"}
    words |= {"commonstem": 50, "antidisestablishmentarianism" * 40: 3, "antidisestablishmentarianism" * 40 + "s": 40}
    check(spark, words)


def test_words_of_awkward_rows(spark):
    rows = awkward() + [(900 + i, "Straßenbahn straßenbahn ÉCOLES écoles École×s×École naïvement Naïvement " * 40, None, None, None) for i in range(40)]
    got = spelling.count_words(frame(spark, rows, extra=True))
    want = brute_words([(r[0], r[1]) for r in rows])
    assert multiset(map(tuple, got.select("word", "n").collect())) == multiset(want.items())
    found = spelling.spelling_variants(frame(spark, rows))
    assert multiset(map(tuple, found.collect())) == multiset(brute_groups(want))


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, "short words only", None, None, 1), (2, None, None, None, 0)])).count() == 0


letters = st.text(alphabet="abcé", min_size=7, max_size=14)
books = st.frozensets(st.text(alphabet="abcé", min_size=2, max_size=3), max_size=25)


@settings(max_examples=1500, deadline=None)
@given(letters, books, st.integers(0, 14), st.sampled_from("abcéx"), st.sampled_from(["add", "lose", "other"]), st.integers(3, 4))
def test_an_edit_spares_the_promised_grams(word, common, at, letter, kind, long):
    """The bound that no pair is lost by, for any gram dictionary."""
    book = spelling.Grams(common, 2, long)
    at %= len(word)
    other = {"add": word[:at] + letter + word[at:], "lose": word[:at] + word[at + 1:], "other": word[:at] + letter + word[at + 1:]}[kind]
    a, b = book.decompose(word), book.decompose(other)
    shift = len(other) - len(word)
    after = set(b)
    kept = sum((p, g) in after if p + len(g) <= at else (p + shift, g) in after for p, g in a)
    assert kept >= len(a) - book.affected(word, a)


@settings(max_examples=300, deadline=None)
@given(letters, st.integers(0, 14), st.sampled_from("abcéx"), st.sampled_from(["add", "other"]), st.integers(1, 3))
def test_near_words_share_a_list(word, at, letter, kind, shared):
    book = spelling.Grams(frozenset({"ab", "bc", "ca"}))
    at %= len(word)
    other = word[:at] + letter + word[at + (kind == "other"):]
    own, longer, sure = {}, {}, []
    for w in (word, other):
        grams = sorted((g, p) for p, g in book.decompose(w))
        sure.append(len(grams) - book.affected(w, book.decompose(w)))
        heads = [spelling.hashed([f"v{len(w) + k}"]) for k in (0, 1)]
        for rows, key, mine in spelling.list_rows(np.array([0, len(grams)]), spelling.hashed([g for g, _ in grams]), np.array([p for _, p in grams]), np.array(sure[-1:]), *heads, shared, None):
            (own if mine else longer).setdefault(w, set()).update(key.tolist())
    if word != other and max(sure) >= shared:
        assert own[other] & (own if kind == "other" else longer)[word]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=7, max_size=9), min_size=2, max_size=12))
def test_verification(words):
    found = spelling.letters_of(pa.array(words))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    fit = np.array([len(words[j]) - len(words[i]) in (0, 1) for i, j in zip(a, b)])
    a, b = a[fit], b[fit]
    assert spelling.one_edit(*found, a, b).tolist() == [one_edit(words[i], words[j]) for i, j in zip(a, b)]
