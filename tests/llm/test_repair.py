import hashlib
import random
import zlib
from functools import lru_cache
from math import isqrt

from geomatch.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, n long, fault string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "f") for r in rows], COLUMNS)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows, convs):
    """Every conversation by trying all edits at every place, from the front, with the audit so far in the comparison."""
    result = {}
    for conv in convs:
        own = sorted([(t is not None, t or 0, r, x) for c, t, r, x in rows if c == conv])
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _ in own]
        turns = [t for known, t, _, _ in own if known]

        @lru_cache(None)
        def best(i, made, inserted=0):
            """Cheapest (cost, audit, turns) from row i on, when the last turn made has this initial; at most two turns are inserted at one place."""
            want, named = ("a", "assistant") if made == "u" else ("u", "user")
            found = [(0, "", ())] if i == len(own) and made in ("", "a") else []

            def then(edit, cost, said, rest):
                found.append((cost + rest[0], edit + rest[1], said + rest[2]))

            if i < len(own):
                _, _, role, text = own[i]
                then("D", 2, (), best(i + 1, made))
                if faults[i] in (0, 3):
                    extra = 5 if faults[i] == 3 else 0
                    then("R", 1 + extra, ((named, text),), best(i + 1, want))
                    if role[:1] == want or (made == "" and role[:1] == "s"):
                        then("K", extra, ((role, text),), best(i + 1, role[:1]))
            if inserted < 2:
                then("I", 5, ((named, ""),), best(i, want, inserted + 1))
            return min(found, default=(10**9, "", ()))

        cost, audit, said = best(0, "")
        result[conv] = (
            turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0,
            faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return result


def some_rows(seed, n, convs, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "universe"]
    texts = ["a.", "b!", "c", " ", "", None, "d? \t", "e\n", "a.", "é.", "f\x0b"]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def collected(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_equals_all_edits_tried(spark):
    rows = some_rows(1, 700, 90, 7)
    convs = {r[0] for r in rows}
    assert collected(repair.damaged_reports(table(spark, rows))) == plain(damaged(rows), convs)
    own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert collected(repair.reports(table(spark, rows))) == plain(own, convs)


def test_repaired_turns_are_what_the_reports_digest(spark):
    rows = table(spark, some_rows(2, 300, 30, 9))
    by: dict = {}
    for r in sorted(repair.repaired_turns(rows).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, report in collected(repair.reports(rows)).items():
        said = [r for r in by.get(conv, []) if r.role is not None]
        assert "".join(r.edit for r in by.get(conv, [])) == report[-2]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest() == report[-1]
        initials = "".join(r.role[0] for r in said)
        assert not initials or (initials.removeprefix("s") and initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2))


def test_a_long_conversation_keeps_few_vectors_and_rows(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i}." if i % 5 else str(i)) for i in range(5000)]
    most = 0
    one = repair._Conversation(1, len(rows))
    for at in range(len(rows) - 1, -1, -1):
        one.backward(at, at, rows[at][2], 0)
    most = len(one.checkpoints)
    for at, row in enumerate(rows):
        list(one.forward(at, row[2], row[3], 0))
        assert len(one.block) <= isqrt(len(rows))
    assert most <= isqrt(len(rows)) + 3
    got = collected(repair.reports(table(spark, rows)))[1]
    assert got[5] > 0 and got[0] == 0 and len(got[6]) >= len(rows)


def test_edge_cases(spark):
    assert repair.damaged_reports(table(spark, []).where("false")).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "x."), (6, 1, None, None), (7, None, "user", "y" * 3_000_000 + ".")]
    got = collected(repair.damaged_reports(table(spark, rows)))
    assert got == plain(damaged(rows), {5, 6, 7})
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ties = [(1, 0, "user", "a."), (1, 0, "assistant", "a."), (1, 0, "user", "a.")]
    assert collected(repair.reports(table(spark, ties))) == plain(ties, {1})
