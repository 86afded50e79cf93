import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from geomatch.llm import similar, simhash


def plain_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_kept(texts):
    """Indices that are the first of their component, by brute force over all pairs."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {find(i) for i in range(len(texts))}


def edited_texts(rng, bases=12, each=14):
    """Texts with one to several words changed, so that similarities lie on both sides of 0.8; all hold one line."""
    line = " ".join(f"line{i}" for i in range(9))
    out = [None, "", "One", "one", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"]
    for b in range(bases):
        words = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.choice([24, 60, 150]))]
        for _ in range(each):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.choice([0, 1, 1, 2, 3, 4])):
                own[at] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(own) + " " + line)
    return out


@pytest.mark.parametrize("list_rows", [64, 3])
@pytest.mark.parametrize("common", [similar.COMMON_TEXTS, 10**9])
def test_kept_rows_equal_all_pairs(spark, make_docs, monkeypatch, list_rows, common):
    """Also with centres in short lists, and with no shingle counted as common."""
    monkeypatch.setattr(similar, "COMMON_TEXTS", common)
    monkeypatch.setattr(similar, "SLICE", 5)
    texts = edited_texts(random.Random(list_rows))
    assert {r.doc_id for r in similar.keep_first(make_docs(texts), list_rows=list_rows).collect()} == plain_kept(texts)


def test_pipeline_stage_joins_copies_of_similarity_0_8(spark, make_docs):
    words = [f"w{i}" for i in range(104)]
    near = [*words[:50], "x", *words[51:]]  # 95 of 105 shingles
    edge = [*words[:20], "y", *words[21:80], "z", *words[81:]]  # 90 of 110
    far = [*words[:20], "p", *words[21:50], "q", *words[51:80], "r", *words[81:]]  # 85 of 115
    docs = make_docs([" ".join(w) for w in (words, near, edge, far)])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {0, 3}


def test_pipeline_stage_proposes_pairs_by_simhash(spark, make_docs, monkeypatch):
    """Pairs of linked or equal fingerprints are verified first, so that the join of lists gets them as one component."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(w) for w in (words, [*words[:-1], "x"], ["y", *words[1:]], [f"v{i}" for i in range(3000)], words + words[:40])]
    prints = [simhash.fingerprint(t.encode(), similar.SHINGLE_WORDS) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[0] ^ prints[3]).bit_count() > 3
    asked, links = [], simhash.links

    def noted(rows, *args):
        asked.extend(r.fp % (1 << 64) for r in rows.collect())
        return links(rows, *args)

    verified, proposed = similar._verified, []

    def checked(pairs, *args):
        proposed.append({(r.a, r.b) for r in pairs.collect()})
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "links", noted)
    monkeypatch.setattr(similar, "_verified", checked)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, make_docs(texts), "").collect()} == {0, 3}
    assert set(asked) == set(prints)
    keys = [np.uint64(similar.set_key(similar.shingle_set(t.encode()))).astype(np.int64) for t in texts]
    assert (min(keys[0], keys[1]), max(keys[0], keys[1])) in proposed[0]


def test_nulls_and_repeats(spark, make_docs):
    docs = make_docs(["a b c", "a b c", "q r s t", "a b c", "z z z"], ids=[5, 5, None, 3, None])
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "a b c"), ("None", "q r s t"), ("None", "z z z")]
    assert sorted(r.doc_id for r in similar.keep_first(make_docs(["a b c", "a b c", "d e f"], ids=[1, 1, 2])).collect()) == [1, 2]
    assert similar.keep_first(docs.filter("false")).count() == 0


def test_parity_bits_drop_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        m = int(rng.integers(1, 700))
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, m))
        b = np.unique(np.r_[a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(-(2**63), 2**63 - 1, int(len(a) * rng.uniform(0, 0.3)))])
        both = len(np.intersect1d(a, b))
        fits = 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))
        if fits:
            rows.append((similar.parity_bits(a).tolist(), similar.parity_bits(b).tolist(), len(a), len(b), 5 * both >= 4 * (len(a) + len(b) - both)))
    pairs = spark.createDataFrame(rows, "x array<long>, y array<long>, m int, o int, similar boolean")
    found = pairs.select("similar", similar._may_be_similar(*(pairs[c] for c in "xymo")).alias("likely")).collect()
    assert all(r.likely for r in found if r.similar) and any(r.similar for r in found) and not all(r.likely for r in found)


def test_bits_of_lists_drop_only_pairs_that_differ():
    """The pairs of one list are those whose sizes and parity bits allow 0.8; each similar pair is among them."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (5, 40, 150, 600):
        base = rng.integers(-(2**63), 2**63 - 1, size)
        for changed in (0.0, 0.03, 0.08, 0.11, 0.2, 0.9):
            own = base.copy()
            n = int(changed * size)
            own[:n] = rng.integers(-(2**63), 2**63 - 1, n)
            sets.append(np.unique(own))
    n = len(sets)
    bits = np.array([similar.parity_bits(s, 64 * len(similar.LIST_BITS)) for s in sets]).T
    columns = [np.zeros(n, np.int64), np.arange(n), np.array([len(s) for s in sets]), np.arange(n), *bits]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "key", "m", "root", *similar.LIST_BITS])
    found = {(a, b) for out in similar._run_pairs(iter([batch])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    pairs = list(combinations(range(n), 2))
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in pairs}
    alike = {(i, j) for i, j in pairs if 5 * both[i, j] >= 4 * (len(sets[i]) + len(sets[j]) - both[i, j])}
    assert alike <= found
    assert len(alike) > 10
    assert not any(len(sets[i]) < 300 and both[i, j] == 0 and len(sets[i]) > 10 for i, j in found)
