"""Quality rules as a short-circuit cascade.

A rule looks at counts of a whole text and rejects it or not. On a bounded sample every rule is applied to every text, which gives its cost
(seconds) and what it rejects. The cascade takes, again and again, the rule that rejects most per cost among the
texts that no earlier rule rejects. Over the table, a text meets the rules in this order and leaves at the first that
rejects it; counts are made when a rule first asks for them. The order depends on clocks, the verdict does not: it is
whether any rule rejects.

Words are runs of characters other than space and U+0009 to U+000D; lines end at U+000A.

Defined cases. A null or empty text has no words and is rejected by ``few_words``. A repeated row is judged each time; a null doc_id stays null.
An empty table gives an empty table, and the rules keep the order in which they are given. Ties in the order go to the rule given first.
Only ``doc_id`` and ``text`` are read for a verdict; ``keep`` passes all columns in a struct, so they cannot clash.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import arrow_map, hashed_sample, keep_rows

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LONG = 5000


class Text:
    """Counts of one text, each made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, _UPPER))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text has twice or more."""
        w = self.words
        if len(w) < 4:
            return 0
        if len(w) < _LONG:
            each = list(zip(w, w[1:], w[2:]))
            counts = Counter(each)
            if len(counts) == len(each):
                return 0
            twice = np.fromiter((counts[x] > 1 for x in each), dtype=bool, count=len(each))
        else:
            # Long texts are numbered, so that a window is a number.
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(x, len(number)) for x in w), dtype=np.int64, count=len(w))
            pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            _, at, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
            twice = counts[at] > 1
        marked = np.zeros(len(w), dtype=bool)
        for i in range(3):
            marked[i : len(w) - 2 + i] |= twice
        return int(marked.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("capitals", lambda t: 2 * t.n_upper > t.word_chars),
)
BASE = ("few_words", "repeated_words")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Places of the rules in the order of rejection per cost, from a sample of at most ``sample_rows`` texts.

    One row for each combination of rejecting rules that occurs comes to the driver.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            masks, seconds = [], []
            for text in batch["text"].to_pylist():
                mask, spent = 0, []
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(Text(text)) << i
                    spent.append(time.perf_counter() - began)
                masks.append(mask)
                seconds.append(spent)
            return pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(seconds, pa.list_(pa.float64()))], ["mask", "seconds"])

        return work

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    sample = F.broadcast(hashed_sample(ids, [], sample_rows).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id", "left_semi").select("text")
    sums = [F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]
    found = arrow_map(texts, make, "mask long, seconds array<double>").groupBy("mask").agg(F.count("*").alias("n"), *sums).toPandas()
    cost = [found[f"s{i}"].sum() + 1e-9 for i in range(len(rules))]
    open_rules, order = list(range(len(rules))), []
    alive = dict(zip(found["mask"], found["n"]))
    while open_rules:
        best = max(open_rules, key=lambda i: sum(n for m, n in alive.items() if m >> i & 1) / cost[i])
        order.append(best)
        open_rules.remove(best)
        alive = {m: n for m, n in alive.items() if not m >> best & 1}
    return order if len(found) else list(range(len(rules)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept of every row.

    The base counts are part of the result, so here they are made for every text; the verdict comes from the cascade.
    """
    ordered = [rules[i] for i in order_rules(docs, rules, sample_rows)]
    base = [r for r in RULES if r.name in BASE]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for value in batch["text"].to_pylist():
                text = Text(value)
                kept = not any(rule.rejects(text) for rule in ordered)
                failed = any(rule.rejects(text) for rule in base)
                out.append((*(getattr(text, c) for c in counts), failed, kept and not failed))
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.bool_()) for c in columns[5:]]
            return pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *counts, "base_failed", "kept"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, make, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; a text meets no rule after the first that rejects it."""
    ordered = [rules[i] for i in order_rules(docs, rules, sample_rows)]

    def make():
        def keeps(texts):
            return np.fromiter((not any(r.rejects(t) for r in ordered) for t in map(Text, texts)), dtype=bool, count=len(texts))

        return keeps

    return keep_rows(docs, make)
