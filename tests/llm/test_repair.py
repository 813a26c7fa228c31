"""Conversation repair against a plain shortest-path search, over segments and grammars of every size."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.llm import repair
from tideloom.llm.queries import damaged

AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Cost, audit and repaired turns, by a search over (turn, state) that keeps whole audits."""
    ways = {0: (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                for role in "ua":
                    if state in AFTER[role]:
                        new = (cost + 5, audit + "I", (*turns, (FULL[role], "")))
                        out[AFTER[role][state]] = min(out.get(AFTER[role][state], new), new, key=lambda w: w[:2])
        return out

    for role, text, fault in rows:
        after: dict = {}

        def offer(state, way, after=after):
            after[state] = min(after.get(state, way), way, key=lambda w: w[:2])

        for state, (cost, audit, turns) in inserted(ways).items():
            offer(state, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if state in AFTER.get(role[:1], {}):
                offer(AFTER[role[0]][state], (cost + more, audit + "K", (*turns, (role, text))))
            for target in "ua":
                if state in AFTER[target]:
                    offer(AFTER[target][state], (cost + 1 + more, audit + "R", (*turns, (FULL[target], text))))
        ways = after
    return min((w for s, w in inserted(ways).items() if s in (0, 3)), key=lambda w: w[:2])


def by_hand(rows, hurt=True):
    """The whole result from (conv_id, turn, role, text) rows."""
    blank = " \t\n\v\f\r"
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        after = []
        for turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            row = (turn, "user" if kind == 4 else role, text)
            after += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
        seen, faulty = set(), []
        for _, role, text in after:
            bare = text.strip(blank)
            faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"))
            seen.add((role, text))
        known = [t for t, _, _ in after if t is not None]
        count = lambda name: sum(f == name for _, _, f in faulty)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faulty, faulty[1:], strict=False)]
        cost, audit, kept = cheapest(faulty)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def found_in(spark, rows, hurt=True):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("row", "tie", "copy", "gone", "fault", "kind", "audit", "__conv", "__first"):
        frame = frame.withColumn(name, F.lit("clash"))
    given = repair.ordered(frame)
    marked, found = repair.repair(damaged(given) if hurt else given)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(marked, found).collect()}
    turns: dict = {}
    for r in sorted(repair.repaired_rows(marked, found).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(r)
    results = found.collect()
    assert len(results) == len({r.conv_id for r in results})
    for r in results:
        own = turns.get(r.conv_id, [])
        assert [t.place for t in own] == list(range(len(own))) and [t.edit for t in own] == [c for c in r.audit if c != "D"]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == hashes[r.conv_id]
    return {r.conv_id: (*tuple(r)[1:], hashes[r.conv_id]) for r in results}


def drawn(seed, convs, least, most):
    random.seed(seed)
    texts = ["Hello there.", "Cut off", "", " \t", "Why?", "Yes! ", "No.", "é𝒳."]
    return [(c, t, random.choice(["system", "user", "assistant", "user", "assistant", "tool"]), random.choice(texts) + str(random.randrange(2)) * random.randrange(2)) for c in range(convs) for t in range(random.randint(least, most))]


@pytest.mark.parametrize("hurt", [True, False])
def test_repair_by_brute_force(spark, hurt):
    rows = drawn(1, 300, 0, 9)
    assert found_in(spark, rows, hurt) == by_hand(rows, hurt)


def test_long_conversations_over_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(repair, "FAN", 3)
    monkeypatch.setattr(repair, "ROUND_RULES", 5)
    rows = drawn(2, 8, 60, 150) + [(100, t, "user", f"Text {t}.") for t in range(90)] + drawn(3, 8, 1, 2)[:0]
    assert found_in(spark, rows) == by_hand(rows)


def test_odd_conversations(spark):
    long = "wörd " * 60_000
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, "user", "Null turn."), (1, None, None, "No role."), (1, 5, "assistant", None),
        (2, 0, "user", "Twice."), (2, 0, "user", "Twice."), (2, 0, "user", "Twice."), (2, 9, "assistant", "Nine."), (3, 0, "user", long), (3, 1, "assistant", long + "."), (3, 2, "", "."), (4, 0, "U", "x."), (5, 7, None, None),
    ]
    assert found_in(spark, rows, hurt=False) == by_hand(rows, hurt=False)
    assert found_in(spark, rows) == by_hand(rows)
    assert found_in(spark, []) == {}


def test_dropped_conversations_come_back_empty(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(60)]
    gone = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    found = found_in(spark, rows)
    assert gone and len(found) == 60 and all(found[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_rules_have_the_matrices_of_their_expansions():
    drawn_ = np.random.default_rng(4)
    grammar = repair.Grammar()
    spelled = {s: [s] for s in range(repair.TERMINALS)}
    for _ in range(40):
        left, right = (int(x) for x in drawn_.choice(list(spelled), 2))
        if len(spelled[left] + spelled[right]) < 40:
            spelled[grammar.add(left, right)] = spelled[left] + spelled[right]
    plain = repair.Grammar()
    for symbol, terminals in spelled.items():
        whole = repair._identity()
        for t in terminals:
            whole = repair._product(whole, plain.matrix(t))
        assert grammar.matrix(symbol) == whole


def test_replacing_pairs_keeps_the_sequence():
    drawn_ = np.random.default_rng(5)
    sequences = [drawn_.integers(0, 3, n).astype("<u2") for n in (0, 1, 2, 7, 50, 300)]
    symbols, rules = repair._joined([s.tobytes() for s in sequences]), {}
    for _ in range(4):
        inner = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        pairs, n = np.unique(np.stack([symbols[:-1][inner], symbols[1:][inner]]), axis=1, return_counts=True)
        chosen = repair._chosen([(int(a), int(b), int(c)) for a, b, c in zip(*pairs, n, strict=True)])
        made = {pair: repair.TERMINALS + len(rules) + i for i, pair in enumerate(chosen)}
        rules |= {rule: pair for pair, rule in made.items()}
        symbols = repair._replaced(symbols, made)

    def spell(s):
        return [t for x in rules[s] for t in spell(x)] if s in rules else [s]

    back = [t for s in symbols.tolist() for t in spell(s)]
    assert back == repair._joined([s.tobytes() for s in sequences]).tolist() and len(symbols) < len(back) / 2
