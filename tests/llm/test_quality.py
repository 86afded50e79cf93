import random
import re
from collections import Counter

from geomatch.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    chars, upper = sum(map(len, w)), len(re.findall("[A-Z]", text))
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines))
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    kept = not (base or not 3 * len(w) <= chars <= 10 * len(w) or 10 * symbols > len(w) or 2 * dup > len(lines) or 2 * upper > chars)
    return len(w), chars, symbols, dup, len(repeated), base, kept


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a b c a b c", "x\xa0y z", "a\r\na\na\n", "#$ % & | <> *" * 20]
    for _ in range(60):
        pool = [rng.choice(["ab", "cde", "FGHI", "é", "jklmnop", "q#"]) + str(rng.randrange(rng.choice([3, 300]))) for _ in range(40)]
        out.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(1, 300))))
    out.append(" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(20_000)))
    return out


def test_counts_and_verdicts_equal_a_plain_version(make_docs):
    own = texts()
    rows = quality.judge(make_docs(own)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: plain(t) for i, t in enumerate(own)}
    assert any(plain(t)[-1] for t in own)


def test_long_texts_are_counted_alike(monkeypatch):
    own = [t for t in texts() if t]
    want = [quality.Text(t).n_repeat_words for t in own]
    monkeypatch.setattr(quality, "_LONG", 4)
    assert [quality.Text(t).n_repeat_words for t in own] == want


def test_order_follows_rejection_per_cost_and_does_not_change_verdicts(make_docs):
    import time

    def slow(text):
        time.sleep(0.002)
        return len(text.text) > 5

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda t: False), quality.Rule("cheap", lambda t: len(t.text) > 3))
    docs = make_docs(["a" * n for n in range(10)])
    assert quality.order_rules(docs, rules)[0] == 2
    assert [r.doc_id for r in quality.keep(docs, rules).collect()] == [0, 1, 2, 3]


def test_a_rejected_text_meets_no_later_rule(make_docs):
    def fails(text):
        raise ValueError("asked after a rejection")

    docs = make_docs(["abc"]).selectExpr("cast(null as long) doc_id", "text")
    assert quality.keep(docs, (quality.Rule("all", lambda t: True), quality.Rule("fails", fails))).count() == 0


def test_edge_cases(make_docs):
    docs = make_docs([None, "", "w " * 500_000, "a", "a"], ids=[None, 1, 2, 3, 3])
    assert quality.judge(docs).count() == 5 and quality.keep(docs).columns == docs.columns
    empty = docs.filter("false")
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    assert quality.order_rules(empty) == list(range(len(quality.RULES)))
