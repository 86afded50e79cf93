import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geomatch.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    ids = packing.Ids(PATH)
    texts = ["", " ", "a  b", "it's 'll we've", "x<|endoftext|>y", "é ü 日本 🙂 \x1c\x85", "a" * 100_000, "\n" * 50_000]
    texts += ["".join(rng.choice("abS \n.'1é\t🙂") for _ in range(40)) for _ in range(3000)]
    assert [ids.of(t).tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_equal_a_plain_cut(tokenizer, make_docs):
    texts = [None, "", "one two", "word " * 1023, "word " * 1024, "word " * 1025, "ab cd " * 3000]
    want = []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(tuple(r) for r in packing.pieces(make_docs(texts)).collect()) == want


def check(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def exact(lengths, capacity):
    """Fewest sequences, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(lengths):
            best = len(left)
            return
        for k in range(len(left)):
            if left[k] >= lengths[i] and left[k] not in left[:k]:
                go(i + 1, [*left[:k], left[k] - lengths[i], *left[k + 1 :]])
        go(i + 1, [*left, capacity - lengths[i]])

    go(0, [])
    return best


def test_bounds_never_exceed_the_optimum_and_packings_are_valid():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 9))])
        sequence, offset, left = packing.best_fit(lengths, 30)
        best = exact(lengths.tolist(), 30)
        bound = packing.lower_bound(*np.unique(lengths, return_counts=True), 30)
        assert bound <= best <= len(left)
        for s in range(len(left)):
            own = sorted((o, n) for q, o, n in zip(sequence, offset, lengths) if q == s)
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == 30 - left[s]


@pytest.mark.parametrize("task_rows", [50, 100_000])
def test_tasks_exchange_documents(spark, task_rows):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([1024, rng.randint(1, 1023), rng.randint(1, 100)]), i) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(table, task_rows=task_rows).collect()
    assert sorted(r[:5] for r in got) == sorted(rows)
    bound = packing.lower_bound(*np.unique([r[3] for r in rows], return_counts=True))
    assert bound <= check(got, 1024) <= bound + 2


def test_edge_cases(make_docs):
    docs = make_docs([None, "", "a", "a", "x y " * 100_000, "b"], ids=[1, 2, 3, 3, 4, None])
    got = packing.pack_documents(docs).collect()
    check(got, 1024)
    assert sum(r.doc_id == 3 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert packing.pack_documents(docs.filter("false")).count() == 0
