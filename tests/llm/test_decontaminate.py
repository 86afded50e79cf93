import random
import re
from collections import Counter

import pytest
import xxhash

from geomatch.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def similarity(window, item):
    n = min(5, len(item))
    a, b = shingles(window, n), shingles(item, n)
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(docs, items, threshold=0.8):
    out = {}
    for i, text in docs:
        w = words(text)
        for j, item in items:
            own = words(item)
            if not own or not w:
                continue
            each = [similarity(w[s : s + len(own)], own) for s in range(max(1, len(w) - len(own) + 1))]
            if max(each) >= threshold:
                out[i, j] = (max(each), each.index(max(each)))
    return out


@pytest.fixture
def case():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("the", "or", "wi", "é", "n") for b in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 20, 40, 60, 300]))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "same same same same same same same same")]
    docs = []
    for i in range(120):
        body = text(rng.randint(0, 150)).split()
        item = (items[rng.randrange(25)][1] if i % 2 else "").split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            if len(item) > 3:
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [item[at], "new"]])
        at = rng.randrange(len(body) + 1)
        docs.append((i, " ".join(body[:at] + item + body[at:])))
    docs += [(500, items[4][1].upper().replace(" ", " , ")), (501, "same " * 30), (502, None), (503, ""), (504, " ".join(items[3][1].split()[1:]))]
    return docs, items


def test_matches_equal_brute_force(spark, make_docs, case):
    docs, items = case
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, width string")
    rows = dc.matches(make_docs([t for _, t in docs], ids=[i for i, _ in docs]), benchmark).collect()
    got = {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start) for r in rows}
    want = brute(docs, items)
    assert len(want) > 30 and any(s < 1 for s, _ in want.values())
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_more_shingles_than_are_broadcast(spark, make_docs, case, monkeypatch):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    own = make_docs([t for _, t in docs], ids=[i for i, _ in docs])
    a = sorted(dc.matches(own, benchmark).select("doc_id", "item_id").collect())
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    assert sorted(dc.matches(own, benchmark).select("doc_id", "item_id").collect()) == a


def test_fingerprint_is_the_majority(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [([rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40, 255, 256, 300)]
    for r in spark.createDataFrame(rows, "h array<long>").select("h", dc.fingerprint(F.col("h")).alias("fp")).collect():
        assert r.fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x % (1 << 64) >> b & 1 for x in r.h) > len(r.h))


def test_blocks_meet_within_the_radius():
    """Sixteen bits may put two into every block; fifteen leave one block with one or none."""
    rng = random.Random(1)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), dc.RADIUS))
        assert min((flips >> (8 * b) & 255).bit_count() for b in range(8)) <= 1


def test_plan_is_native(spark, make_docs, case):
    docs, items = case
    found = dc.windows(make_docs([t for _, t in docs]), dc._items(spark.createDataFrame(items, "item_id long, text string")))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_removal_and_edge_cases(spark, make_docs):
    item = "one two three four five six seven eight"
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    docs = make_docs([item, item, "x " * 100_000 + item, "clean text of its own", None, "", item], ids=[1, 1, 2, 3, 4, 5, None])
    found = dc.matches(docs, benchmark).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == sorted((d, i) for d in ("1", "2", "None") for i in ("1", "2", "None"))
    kept = dc.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert dc.matches(docs.filter("false"), benchmark).count() == 0
    assert dc.matches(docs, benchmark.filter("false")).count() == 0 and dc.drop_contaminated(docs, benchmark.filter("false")).count() == 7


def test_hashes_are_of_words(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dc.words_of(F.lit("Ab, c_d 1.É")).alias("w"), F.transform(dc.words_of(F.lit("Ab")), lambda w: F.xxhash64(w)).alias("h")).first()
    assert row.w == ["ab", "c", "d", "1", "é"] and row.h[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab", 42)


def test_similar_pairs_beyond_the_radius(spark, make_docs):
    """Four of an item's five shingles are 0.8 of it, and often more than fifteen bits from it."""
    texts = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(150)]
    docs = make_docs([t.rsplit(" ", 1)[0] for t in texts])
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = dc.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == {(i, i): pytest.approx(0.8) for i in range(150)}


def test_texts_that_share_an_item_id(spark, make_docs):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, one), (1, two)], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.matches(make_docs([one, two, "c " * 20]), benchmark).collect()) == [0, 1]
