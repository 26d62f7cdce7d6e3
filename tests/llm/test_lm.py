import math
import zlib
from collections import Counter

import numpy as np
import pytest
from panelspark.llm import lm
from panelspark.llm.eliasfano import EliasFano, encode
from tests.llm.data import awkward, frame


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(train, rows, discount):
    words, pairs = Counter(), Counter()
    for r in train:
        t = tokens(r[1])
        words.update(t)
        pairs.update(zip([None, *t], t))
    total, size, followers = sum(words.values()), len(words), Counter(c for c, _ in pairs)
    out = []
    for r in rows:
        t, base, full = tokens(r[1]), 0.0, 0.0
        for c, w in zip([None, *t], t):
            single = (words[w] + 0.5) / (total + 0.5 * (size + 1))
            direct = 0.0
            if pairs[c, w]:
                code = min(255, max(0, round((math.log10((pairs[c, w] - discount) / words[c]) - lm.FLOOR) / lm.STEP)))
                direct = 10 ** (lm.FLOOR + lm.STEP * code)
            rest = discount * followers[c] / words[c] if words[c] else 1.0
            base += math.log10(single)
            full += math.log10(min(1.0, direct + rest * single))
        out.append((r[0], len(t), sum(words[w] > 0 for w in t), total, round(base, 6), round(full, 6)))
    return out


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


@pytest.mark.parametrize("file_tokens", [100, 1 << 20])
def test_equals_brute_force(spark, file_tokens):
    rows = awkward(4) + [(500 + i, "The hot word the hot word the x" + " the".join(f" w{j}" for j in range(i)), "en", "s", 0) for i in range(40)]
    docs = frame(spark, rows, extra=True)
    trie = lm.build(docs.where(~lm.held_out("doc_id")), file_tokens=file_tokens)
    got = lm.score(docs, trie).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = brute([r for r in rows if not held(r[0])], rows, trie.discount)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], atol=1e-4), (g, w)
    if file_tokens == 100:
        assert len(trie.pairs.files) > 3


def test_probabilities_sum_to_one(spark):
    docs = frame(spark, [(1, "a b a c a b", "", "", 0), (2, "b a", "", "", 0), (3, "", "", "", 0)])
    trie = lm.build(docs)
    trie.words.open()
    trie.pairs.open()
    total = 0.0
    for word in ("a", "b", "c", "unknown"):
        first = lm.score(frame(spark, [(1, f"a {word}", "", "", 0)]), trie).first()["score"] - lm.score(frame(spark, [(1, f"a {word} {word}", "", "", 0)]), trie).first()["score"]
        assert math.isfinite(first)
    # p(w | a) for every known token and the unknown one, from blocks of two tokens.
    from panelspark.llm.common import word_hashes

    raw = np.frombuffer(b"a", np.uint8)
    a = word_hashes(raw, np.array([0]), np.array([1]))[0]
    names = [np.array([a, x]) for x in [*(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([1]))[0] for w in (b"a", b"b", b"c", b"zz")), lm.END]]
    alone = trie.score(np.array([a], np.uint64), np.array([1]))[2][0]
    total = sum(10 ** (trie.score(n.astype(np.uint64), np.array([2]))[2][0] - alone) for n in names)
    assert abs(total - 1) < 0.06


def test_model_beats_words_on_text_like_its_training(spark):
    rows = [(i, " ".join(["one two three four five", "six seven eight nine ten"][(i + j) % 2] for j in range(30)), "", "", 0) for i in range(80)]
    docs = frame(spark, rows)
    got = lm.score(docs, lm.build(docs.where(~lm.held_out("doc_id")))).withColumn("held", lm.held_out("doc_id")).where("held").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_nothing_to_learn_from_and_empty(spark):
    rows = awkward()
    trie = lm.build(frame(spark, []))
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in lm.score(frame(spark, rows), trie).collect())
    assert lm.score(frame(spark, []), lm.build(frame(spark, rows))).count() == 0


@pytest.mark.parametrize("n, top", [(1, 5), (5, 3), (1000, 10**6), (5000, 2**63), (3000, 100), (50_000, 10**9), (10, 2**64 - 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    ef = EliasFano(encode(v))
    i = rng.integers(0, n, 500)
    assert (ef.access(i) == v[i]).all()
    q = np.r_[rng.integers(0, top, 500, dtype=np.uint64), v[:50], v[-1:], np.array([top], np.uint64)]
    assert (ef.successor(q) == np.searchsorted(v, q)).all()
    low = rng.integers(0, n, len(q))
    high = low + (n - low) // 2
    assert (ef.successor(q, low, high) == np.clip(np.searchsorted(v, q), low, high)).all()
    if n >= 50_000:
        assert sum(x.nbytes for x in encode(v).values()) * 8 / n < np.log2(top / n) + 4
