import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from geomatch.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id string, term string, rank int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    docs = [(i, Counter(own), len(own)) for i, own in ((i, terms(t)) for i, t in docs) if own]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, own, _ in docs for t in own)
    out = {}
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    for item, own in asked.items():
        scored = []
        for doc_id, tf, n in docs:
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in own if t in tf)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (doc_id if known else None, -score)
    return out


def collected(frame):
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in frame.collect()}


def some_docs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Wide", "日本", "the", "the", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ,;-_@"[rng.randrange(6)].join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 90]))) for _ in range(n)]
    return texts + [None, "", "--- ;", texts[0], texts[0], "THE the The"]


@pytest.mark.parametrize("share, window, postings, block", [(64, 512, 500_000, 8 << 20), (3, 8, 300, 8 << 20), (10**9, 16, 1000, 60), (1, 4, 50, 200)])
def test_equals_brute_force(spark, make_docs, monkeypatch, share, window, postings, block):
    monkeypatch.setattr(search, "WINDOW", window)
    texts = some_docs(share, 300)
    ids = [None if i % 97 == 5 else i // 2 for i in range(len(texts))]
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(texts[0].split() + ["w1", "w2", "w3", "w20", "w40", "The", "unseen", "日本"], k=rng.choice([1, 4, 30])))) for i in range(12)]
    items += [(12, None), (13, ""), (None, "w1 w2"), (3, "w3 w3 w3")]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], ITEM)
    got = collected(search.search(make_docs(texts, ids).repartition(3), table, 5, share, postings, block))
    want = plain(list(zip(ids, texts)), items, 5)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got == want


def test_every_term_is_indexed_when_the_items_ask_for_too_many(spark, make_docs, monkeypatch):
    texts = some_docs(9, 120)
    items = [(i, t) for i, t in enumerate(texts[:10])]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], ITEM)
    monkeypatch.setattr(search, "VOCABULARY_BYTES", 10)
    assert collected(search.search(make_docs(texts), table, 7)) == plain(list(enumerate(texts)), items, 7)


def test_windows_below_the_threshold_are_skipped():
    size = 5000
    counts = {"short": np.array([100, 101]), "long": np.arange(0, size, 2)}
    names = list(counts)
    shard = {"lengths": np.full(size, 10), "doc_ids": list(range(size)), "terms": names, "ends": np.cumsum([len(v) for v in counts.values()]),
             "docs": np.concatenate(list(counts.values())), "counts": np.ones(sum(map(len, counts.values())), np.int64)}
    lists = search._Lists(shard, 64, (size, 10 * size))
    docs, scores = search.search_shard(lists, [("short", 5000), ("long", 3)], 2, 0)
    assert sorted(docs.tolist()) == [100, 101] and scores.max() > scores.min() > 0
    assert lists.get("short")[2] is None and lists.get("long")[2] is not None


def test_edge_cases(spark, make_docs):
    items = spark.createDataFrame([(1, "alpha beta", "x", "y", 1)], ITEM)
    assert search.search(make_docs([]), items).count() == 0
    assert search.search(make_docs(["alpha"]), items.where("false")).count() == 0
    assert search.search(make_docs([None, "", "?"]), items).count() == 0
    long = "alpha " * 400_000 + "Beta"
    docs = [long, "alpha beta", "gamma", "gamma delta", "alpha"]
    assert collected(search.search(make_docs(docs), items)) == plain(list(enumerate(docs)), [(1, "alpha beta")], 20)


def test_terms_are_not_cut():
    data = ("Ab-é日9_" * 50).encode()
    for size in (1, 3, 7, 1000):
        assert [t for run in search.term_runs(data, size) for t in run] == [t.encode() for t in terms(data.decode())]
