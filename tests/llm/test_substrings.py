import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from geomatch.llm import substrings

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(docs):
    first: dict = {}
    split = [(i, words_of(t)) for i, t in docs]
    for i, w in split:
        if i is not None:
            for at in range(len(w) - 12):
                first[tuple(w[at : at + 13])] = min(i, first.get(tuple(w[at : at + 13]), i))
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - 12):
            if i is not None and first[tuple(w[at : at + 13])] < i:
                gone.update(range(at, at + 13))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def some_docs(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Wide space", "x.", "X."]
    passages = [rng.choices(vocabulary, k=rng.choice([6, 12, 13, 14, 30, 80])) for _ in range(12)]
    texts = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(0, 5)):
            own += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 40))
        if rng.random() < 0.2:
            own += [rng.choice(vocabulary)] * rng.randint(5, 60)
        texts.append(rng.choice(WHITE).join(own))
    return texts + [texts[0], None, "", "  ", "one two", texts[3]]


@pytest.mark.parametrize("chunk, share, hot", [(8 << 20, 32 << 20, 5000), (2000, 3000, 5000), (1500, 2000, 0), (4000, 2500, 2)])
def test_equals_brute_force(spark, make_docs, chunk, share, hot):
    texts = some_docs(chunk, 160)
    ids = [None if i % 31 == 7 else i // 2 for i in range(len(texts))]
    random.Random(3).shuffle(ids)
    docs = make_docs(texts, ids).repartition(3)
    want = plain(list(zip(ids, texts)))
    got = substrings.without_repeats(docs, chunk, share, hot).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    digests = substrings.digests(docs, chunk, share, hot).collect()
    assert Counter(tuple(r) for r in digests) == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want)
    spans: Counter = Counter()
    for r in substrings.repeated_spans(docs, chunk, share, hot).collect():
        spans[r.doc_id] += r.words
    removed: Counter = Counter()
    for i, _, k, _ in want:
        removed[i] += k
    assert +removed == spans


def test_an_anchor_with_many_passages_is_spread(spark, make_docs):
    rng = random.Random(5)
    # Of many phrases, the one whose hash is least: so it is an anchor wherever it stands.
    phrases = [f"a b c d e f{i}" for i in range(300)]
    common = min(phrases, key=lambda p: substrings._Words({"ids": [1], "sizes": [len(p)], "texts": substrings._pack(p.encode())}).hashes(np.array([0]), 6)[0]).split()
    texts = [" ".join(rng.choices([f"v{i}" for i in range(50)], k=9) + common + rng.choices([f"v{i}" for i in range(50)], k=9)) for _ in range(200)]
    texts += texts[:40]
    docs = list(enumerate(texts))
    chunks = substrings._chunks(make_docs(texts).repartition(4), 1000)
    told = substrings._shared(substrings._anchors(chunks, 2), 2, 20).collect()
    assert any(any(r.hot) for r in told)
    assert sorted(tuple(r) for r in substrings.without_repeats(make_docs(texts), 1000, 1000, 20).collect()) == sorted(plain(docs))


def test_index_counts_and_ranks():
    rng = np.random.default_rng(4)
    for kinds, n in ((2, 50), (5, 300), (70, 1000), (300, 20)):
        text = np.r_[0, rng.integers(1, kinds, n), 0]
        tree = substrings.WaveletMatrix(text, kinds)
        at, symbol = rng.integers(0, len(text) + 1, 200), rng.integers(0, kinds, 200)
        assert tree.rank(symbol, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(symbol, at)]
        index = substrings.FMIndex(text, 4)
        ends = np.arange(4, len(text) - 1)
        length, low, high = index.statistics(ends, 4)
        for end, k, a, b in zip(ends, length, low, high):
            count = lambda m: sum(text[i : i + m].tolist() == text[end - m + 1 : end + 1].tolist() for i in range(len(text)))  # noqa: B023, E731
            if b - a > 1:
                assert k == 4 and count(4) == b - a
            else:
                assert k < 4 and count(4) == 1 and (count(k + 1) == 1 or k == 3)


def test_edge_cases(spark, make_docs):
    assert substrings.digests(make_docs([])).count() == 0
    assert sorted(tuple(r) for r in substrings.without_repeats(make_docs([None, "", "a\tb"])).collect()) == [(0, 0, 0, ""), (1, 0, 0, ""), (2, 2, 0, "a b")]
    long = " ".join(f"t{i % 9000}" for i in range(60_000))
    texts = [long, "x " * 30_000, " ".join(f"t{i}" for i in range(8990, 9000)) + " t0 t1 t2", "x " * 20]
    assert sorted(tuple(r) for r in substrings.without_repeats(make_docs(texts)).collect()) == sorted(plain(list(enumerate(texts))))
    same = make_docs([long[:500], long[:500]], [4, 4])
    assert {r.n_removed for r in substrings.digests(same).collect()} == {0}
