import math
import random
import re
import zlib
from collections import Counter

import pytest

from geomatch.llm import lm

END = "\n"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Plain:
    """Interpolated modified Kneser-Ney of order two over dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip([END, *w], w))
        self.after, self.kinds = {}, Counter(b for _, b in self.pairs)
        for (a, _), n in self.pairs.items():
            self.after.setdefault(a, []).append(n)
        self.d2, self.d1 = self.discounts(self.pairs), self.discounts(self.kinds)

    @staticmethod
    def discounts(counts):
        n = [0, *(sum(c == k for c in counts.values()) for k in range(1, 5))]
        d = [0, 0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for k in range(1, 4):
                if n[k] and n[k + 1]:
                    d[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05)
        return d

    def word(self, w):
        left = sum(self.d1[min(k, 3)] for k in self.kinds.values())
        return (max(self.kinds[w] - self.d1[min(self.kinds[w], 3)], 0) + left / (len(self.words) + 1)) / len(self.pairs)

    def pair(self, a, b):
        if a not in self.after:
            return self.word(b)
        n = self.pairs[a, b]
        left = sum(self.d2[min(k, 3)] for k in self.after[a])
        return (max(n - self.d2[min(n, 3)], 0) + left * self.word(b)) / sum(self.after[a])

    def row(self, text):
        w = tokens(text)
        total = sum(self.words.values())
        base = sum(math.log10((self.words[x] + 0.1) / (total + 0.1 * (len(self.words) + 1))) for x in w)
        return len(w), sum(x in self.words for x in w), total, base, sum(math.log10(self.pair(a, b)) for a, b in zip([END, *w], w))


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def texts(n=150):
    rng = random.Random(6)
    pool = ["the", "The", "of", "é", *(f"w{i}" for i in range(60))]
    out = [" ".join(rng.choice(pool[: rng.choice([4, 20, 64])]) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return out + [None, "", " \t", "a\xa0b", "the the", "new words here\n"]


@pytest.mark.parametrize(("shard_bytes", "flush", "run"), [(lm.SHARD_BYTES, lm.FLUSH_TOKENS, lm.SCORE_TOKENS), (1500, 50, 30)])
def test_scores_equal_a_plain_model(make_docs, shard_bytes, flush, run):
    """Once in one shard, once with many shards, flushes and runs; the most frequent words are split in both."""
    own = texts()
    plain = Plain([t for i, t in enumerate(own) if not held(i)])
    model = lm.train(make_docs(own), shard_bytes, flush)
    rows = lm.score(make_docs(own), model, run).collect()
    assert len(rows) == len(own) and len(model.hot) > 3
    for r in rows:
        assert r.held_out == held(r.doc_id)
        assert tuple(r)[2:] == pytest.approx(plain.row(own[r.doc_id]), rel=1e-9)


def test_probabilities_sum_to_one(make_docs):
    plain = Plain(texts())
    for a in ("the", "w1", END):
        assert sum(plain.pair(a, b) for b in plain.words) + plain.pair(a, "unseen") == pytest.approx(1)


def test_long_texts_are_read_in_runs(monkeypatch, make_docs):
    own = ["one two three " * 200]
    whole = lm.perplexity_scores(make_docs(own, ids=[1])).collect()
    whole_runs = [(f.tolist(), s.tolist()) for f, s in lm.token_runs(own[0].encode())]
    split = lm.word_runs
    monkeypatch.setattr(lm, "word_runs", lambda data: split(data, 10))
    parts = list(lm.token_runs(own[0].encode()))
    assert [x for f, _ in parts for x in f.tolist()] == [x for f, _ in whole_runs for x in f]
    assert whole[0].n_tokens == 601


def test_edge_cases(make_docs):
    docs = make_docs(["a b", "a b", None, "", "c " * 300_000, "a"], ids=[1, 1, 2, None, 3, 4])
    rows = lm.perplexity_scores(docs).collect()
    assert len(rows) == 6 and all(r.score <= 0 and r.base_score <= 0 and r.n_tokens >= 1 for r in rows)
    assert lm.perplexity_scores(docs.filter("false")).count() == 0
    nothing = lm.perplexity_scores(docs.selectExpr("cast(null as long) doc_id", "text")).collect()
    assert {(r.score, r.base_score, r.train_tokens, r.held_out) for r in nothing} == {(0.0, 0.0, 0, False)}
