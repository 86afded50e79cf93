import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geomatch.llm import langid
from geomatch.llm.common import GROUP_CHARS, SLICE_ROWS, arrow_map, text_pieces

PARTS = {"xx": ["the", "ing", "and", "wh", "sh"], "yy": ["der", "ung", "sch", "für", "ß"], "zz": ["que", "ción", "ñ", "los"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(PARTS))
        out.append((" ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    return out


def plain_bits(model, lang, text):
    """Prediction by partial matching, byte by byte, over dictionaries."""
    trees = [{} for _ in range(langid.DEPTH + 1)]
    for at, gram, n in zip(model.lang, model.gram, model.count):
        b = int(gram).to_bytes(langid.DEPTH + 1, "big")
        if at == lang:
            for k, tree in enumerate(trees):
                own = tree.setdefault(b[langid.DEPTH - k : langid.DEPTH], {})
                own[b[-1]] = own.get(b[-1], 0) + int(n)
    known = {x for gram in model.gram for x in int(gram).to_bytes(langid.DEPTH + 1, "big")}
    data = b"\0" * langid.DEPTH + text.lower().encode()

    def every(context):
        """Probability of each known byte; -1 stands for all others."""
        low = {x: 1 / 256 for x in [*known, -1]} if context is None else None
        if low:
            return low
        low = every(context[1:]) if context else every(None)
        own = trees[len(context)].get(context)
        if not own:
            return low
        total, kinds = sum(own.values()), len(own)
        left = {x: p for x, p in low.items() if x not in own}
        mass = max(sum(left.values()), 1e-12)
        return {x: max(own[x] / (total + kinds) if x in own else kinds / (total + kinds) * p / mass, 1e-9) for x, p in low.items()}

    bits = 0.0
    for i in range(langid.DEPTH, len(data)):
        context = bytes(x if x in known else 255 for x in data[i - langid.DEPTH : i])
        p = every(context)
        bits -= math.log2(p.get(data[i], p[-1]))
    return bits


def test_code_lengths_are_exact(make_docs):
    rows = corpus(60)
    model = langid.train(make_docs([t for t, _ in rows], langs=[x for _, x in rows]))
    coder = langid.Coder(model)
    texts = ["the sching", "Ñ los QUE", "zzz 123", "x", "für und die", "日本 the", "a" * 30]
    for text, got in zip(texts, coder.code_lengths(texts)):
        assert got == pytest.approx([plain_bits(model, i, text) for i in range(len(model.langs))], rel=1e-4)


def test_costs_are_distributions(make_docs):
    rows = corpus(60)
    coder = langid.Coder(langid.train(make_docs([t for t, _ in rows], langs=[x for _, x in rows])))
    sums = np.exp2(-coder.bits.reshape(-1, coder.a, len(coder.langs))).sum(axis=1)
    assert sums.max() < 1.01


def test_pieces_do_not_change_code_lengths(monkeypatch, make_docs):
    rows = corpus(60)
    coder = langid.Coder(langid.train(make_docs([t for t, _ in rows], langs=[x for _, x in rows])))
    texts = [t for t, _ in rows[:20]] + [None, "", " ".join(t for t, _ in rows)]
    whole = coder.code_lengths(texts)
    plain = langid.text_pieces
    monkeypatch.setattr(langid, "text_pieces", lambda texts: plain(texts, 50))
    assert np.allclose(whole, coder.code_lengths(texts), rtol=1e-5)


def test_held_out_texts(make_docs):
    rows = corpus()
    found = langid.identify(make_docs([t for t, _ in rows], langs=[x for _, x in rows])).collect()
    assert all(r.lang_pred == rows[r.doc_id][1] for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_used(make_docs):
    rows = corpus()
    wrong = [x if zlib.crc32(str(i).encode()) % 5 else "xx" for i, (_, x) in enumerate(rows)]
    a, b = (langid.identify(make_docs([t for t, _ in rows], langs=own)).collect() for own in ([x for _, x in rows], wrong))
    assert sorted(a) == sorted(b)


def test_edge_cases(make_docs):
    rows = corpus(80)
    texts = [t for t, _ in rows] + [None, "", "12 !!", "der " * 300_000, "日本語"]
    docs = make_docs(texts, ids=[*range(80), 80, 81, 82, None, 82], langs=[x for _, x in rows] + [None, "xx", "", "yy", None])
    found = langid.identify(docs).collect()
    assert len(found) == 85
    by_score = {(r.doc_id, r.lang_pred): r.score for r in found}
    assert by_score[80, "und"] == by_score[81, "und"] == by_score[82, "und"] == 0.0 and (None, "yy") in by_score
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {80, 81} & {r.doc_id for r in kept.collect()} == set()
    assert langid.identify(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_coder_takes_little_more_than_its_table():
    rng = np.random.default_rng(7)
    langs = np.repeat(np.arange(4), 30_000)
    letters = rng.choice(np.arange(97, 123), (len(langs), langid.DEPTH + 1))
    model = langid.Model(list("abcd"), langs, (letters * 256 ** np.arange(langid.DEPTH, -1, -1)).sum(axis=1), np.ones(len(langs), np.int64))
    tracemalloc.start()
    coder = langid.Coder(model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * coder.bits.nbytes


def test_batches_and_groups_are_bounded(make_docs):
    docs = make_docs(["ein Satz"] * 2500)
    rows = arrow_map(docs.select("text").coalesce(1), lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long", rows=10_000)
    assert max(r.n for r in rows.collect()) <= SLICE_ROWS
    groups = [sum(map(len, pieces)) for _, pieces in text_pieces(["x " * 50_000] * 30)]
    assert max(groups) < 2 * GROUP_CHARS and sum(groups) == 3_000_000
