import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geomatch.llm import simhash


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "one TWO", "Ünder ÄB x y z", "a b c d", "a  b\nc\td", "é" * 5 + " b c a b c a b c", "x " * 5000, "w" * 100000]


@pytest.mark.parametrize("n", [3, 5])
def test_fingerprint_is_the_majority_of_shingle_hashes(n):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 700))) for _ in range(20)]
    assert [simhash.fingerprint(t.encode() if t is not None else None, n) for t in texts] == [plain_print(t, n) for t in texts]


def test_long_text_is_read_in_runs(monkeypatch):
    text = " ".join(random.Random(2).choice(["ab", "cd", "EF", "g h"]) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "word_runs", lambda data: ([w] for w in data.lower().split()))
    assert simhash.fingerprint(text.encode()) == whole == plain_print(text)


def near_prints(rng, centres, each):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            out.append(c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5]))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("run_rows", [2048, 4])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_components_equal_all_pairs(spark, run_rows, radius):
    """Also with tiny run bounds, where most rows take the way of hot runs."""
    prints = near_prints(random.Random(radius), 6, 30)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.connected(simhash.links(table, radius, run_rows)).collect()
    root = {p: p for p in signed} | {r.node: r.root for r in found}
    groups: dict = {}
    for p in signed:
        groups.setdefault(root[p], set()).add(p)
    want: dict = {}
    for p, r in zip(signed, plain_components(prints, radius)):
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.connected(edges).collect()} == {(i, 0) for i in range(1, 61)}


def test_documents(spark, make_docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(80)) for _ in range(12)]
    texts = TEXTS + base + [b.upper() for b in base[:6]] + [b + " tail" for b in base[6:9]]
    rows = simhash.near_duplicates(make_docs(texts)).collect()
    prints = [plain_print(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(plain_components(prints)))


def test_nulls_repeats_and_empty_tables(spark, make_docs):
    docs = make_docs(["a b c", "a b c", "q r s t", "a b c", "z z z"], ids=[5, 5, None, 3, None])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", "3"), ("5", "3"), ("5", "3"), ("None", "None"), ("None", "None")]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "a b c"), ("None", "q r s t"), ("None", "z z z")]
    empty = docs.filter("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_rows_that_repeat_wholly_leave_one(spark, make_docs):
    docs = make_docs(["a b c", "a b c", "d e f"], ids=[1, 1, 2])
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 2]


def test_spark_hash_agrees(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert np.int64(row.h).view(np.uint64) == xxhash.xxh64_intdigest(b"a b c", 42)
