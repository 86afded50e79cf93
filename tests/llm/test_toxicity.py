import math
import random

import numpy as np

from geomatch.llm import toxicity
from geomatch.llm.common import text_pieces


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    clean = [a + b for a in ("the", "or", "an", "wi", "re", "est") for b in ("", "ing", "ly", "ed", "ion")]
    bad = ["zorgul" + x for x in ("a", "en", "ix", "ot", "um")]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_held_out_documents_are_told_apart(spark, make_docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.toxicity(make_docs([t for _, t, _ in rows]), labels).collect()
    wrong = sum(r.predicted != rows[r.doc_id][2] for r in scored if r.held_out)
    assert sum(r.held_out for r in scored) > 50 and wrong <= 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_held_out_labels_are_not_used(spark, make_docs):
    import zlib

    rows = corpus()
    docs = make_docs([t for _, t, _ in rows])
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    a = toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_probabilities_equal_a_plain_model():
    words = ["abab", "abc", "b", "bca", "abab"]
    codes, _ = toxicity.windows(words)
    code, n = np.unique(codes, return_counts=True)
    model = toxicity.KneserNey(code, n.astype(float))

    grams: dict = {}
    for w in words:
        b = b"\0" * 5 + w.encode() + b"\1"
        for i in range(len(b) - 5):
            grams[b[i : i + 6]] = grams.get(b[i : i + 6], 0) + 1
    levels = {6: grams}
    for k in range(5, 0, -1):
        levels[k] = {}
        for g, c in levels[k + 1].items():
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + (c if g[1] == 0 else 1)

    def plain(g, k):
        low = plain(g, k - 1) if k > 1 else 1 / 256
        own = levels[k]
        g = g[-k:]
        followers = [c for h, c in own.items() if h[:-1] == g[:-1]]
        if not followers:
            return low
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = ones / (ones + 2 * twos) if ones else 0.5
        return (max(own.get(g, 0) - d, 0) + d * len(followers) * low) / sum(followers)

    asked = [g for g in grams] + [b"\0\0\0\0\0z", b"abcabc"]
    p = np.full(len(asked), 1 / 256)
    wanted = np.array([int.from_bytes(g, "big") for g in asked], dtype=np.uint64)
    for k in range(1, 7):
        p = model.refine(wanted, k, p)
    assert np.allclose(p, [plain(g, 6) for g in asked])
    every = [b"\0\0\0\0a" + bytes([x]) for x in range(256)]
    p = np.full(256, 1 / 256)
    for k in range(1, 7):
        p = model.refine(np.array([int.from_bytes(g, "big") for g in every], dtype=np.uint64), k, p)
    assert math.isclose(p.sum(), 1)


def test_pieces_cover_texts_and_cut_no_word():
    texts = ["ab cd " * 50, None, "", "x" * 100, "a b"]
    back = [""] * 5
    for rows, pieces in text_pieces(texts, 20):
        for row, piece in zip(rows, pieces):
            back[row] += piece
            assert piece.strip("ab cd") == "" or set(piece) == {"x"}
    assert back == [t or "" for t in texts]


def test_edge_cases(spark, make_docs):
    rows = corpus(120)
    texts = [t for _, t, _ in rows] + [None, "", "123 !!!", "word " * 200_000]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    docs = make_docs(texts, ids=[*range(120), None, 120, 120, 121])
    scored = toxicity.toxicity(docs, labels).collect()
    assert len(scored) == len(texts) and all(r.score is not None and r.held_out is not None for r in scored)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in scored)
    assert toxicity.toxicity(docs.filter("false"), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0}
