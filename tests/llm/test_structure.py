"""Structure repair and prefix tries against plain recomputation."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pageframe.llm import prefix_trie, repair

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows, open_end=False):
    """(cost, audit, messages) with whole texts as states: rows are (initial, must go, cut, role, text)."""
    least = lambda *xs: min((x for x in xs if x), default=None)
    add = lambda x, cost, letter, *said: x and (x[0] + cost, x[1] + letter, x[2] + said)
    ins = lambda s, p, u, a: (s, p, u := least(u, *[add(x, 3, "I", "user:") for x in (s, p, a)]), least(a, add(u, 3, "I", "assistant:")))
    s, p, u, a = (0, "", ()), None, None, None
    for initial, must, cut, role, text in rows:
        s, p, u, a = ins(s, p, u, a)
        more, gone = 3 * cut, lambda x: add(x, 4, "D")
        keep = lambda x, i, more=more, must=must, initial=initial, role=role, text=text: None if must or initial != i else add(x, more, "K", f"{role}:{text}")
        turn = lambda x, to, more=more, must=must, text=text: None if must else add(x, 3 + more, "R", f"{to}:{text}")
        s, p, u, a = gone(s), least(gone(p), keep(s, "s")), least(gone(u), *[f(x, *y) for x in (s, p, a) for f, y in ((keep, ("u",)), (turn, ("user",)))]), least(gone(a), keep(u, "a"), turn(u, "assistant"))
    s, p, u, a = ins(s, p, u, a)
    return least(s, a)


def test_audit_is_the_least_of_the_cheapest():
    rng = random.Random(3)
    for n in [*range(12)] * 60 + [300, 700]:
        rows = [(i := rng.choice("ssuuaat"), rng.random() < 0.2, rng.random() < 0.3, {"s": "system", "u": "user", "a": "assistant"}.get(i, "tool"), f"t{k}") for k in range(n)]
        cost, letters, messages = cheapest(rows)
        audit = repair.Audit(every=rng.choice((1, 3, 1000)))
        got = []
        for initial, must, cut, role, text in rows:
            got += audit.add(initial, must, cut, {"role": role, "text": text})
        got += audit.finish()
        assert (audit.cost, "".join(x[0] for x in got)) == (cost, letters)
        assert [":".join(m) for x in got if (m := repair.said(*x))] == list(messages)


def test_no_prefix_of_a_million_rows_stays_open():
    audit, held = repair.Audit(), 0
    for i in range(20000):
        held += len(list(audit.add("uuasa"[i % 5], False, i % 7 == 0, None)))
    assert held > 18000 and max(edit.depth for _, edit in audit.tips.values()) < 3000


def test_equal_hashes_of_other_letters_do_no_harm(monkeypatch):
    monkeypatch.setattr(repair, "PRIME", 1)  # every hash is 0
    test_audit_is_the_least_of_the_cheapest()


def told(conv, rows):
    """The expected row of a conversation of (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    seen, n, judged = set(), Counter(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        n[fault] += 1
        seen.add((role, text))
        judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    cost, letters, messages = cheapest(judged)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(messages).encode()).hexdigest(), messages


def test_repair_of_odd_rows(spark):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ünal"], ["Yes.", "No", "  ", "", None, "a!\n\t", "😀?", "x. y", "Yes. ", "long " * 5000 + "."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.choice([None, *range(6), -3, 1 << 40]), rng.choice(roles), rng.choice(texts), i) for i in range(160)]
    rows += [(50, 1, "user", "Same.", 0)] * 30 + [(51, 1, "", None, 0), (52, None, "user", "Hi.", 0), (52, None, "assistant", "Hi.", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key long").withColumn("seen", F.lit(1)).withColumn("first", F.lit(2))
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r, x))
    want = {c: told(c, y) for c, y in by.items()}
    assert {tuple(r) for r in repair.audited(df).collect()} == {w[:-1] for w in want.values()}
    messages = defaultdict(list)
    for r in repair.repaired(df).orderBy("position").collect():
        messages[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: tuple(m) for c, m in messages.items()} == {c: w[-1] for c, w in want.items() if w[-1]}
    assert repair.audited(df.limit(0)).collect() == [] and repair.repaired(df.limit(0)).collect() == []


def nodes_of(sequences):
    """The expected nodes of {conv_id: sequence of (role, text)}."""
    nodes = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(p))
        yield min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rng = random.Random(4)
    sequences = {}
    for c in rng.sample(range(-50, 400), 150):
        if sequences and rng.random() < 0.7:
            base = list(rng.choice(list(sequences.values())))
            base = base[: rng.randint(0, len(base))] if rng.random() < 0.6 else base
        else:
            base = []
        sequences[c] = tuple(base + [(rng.choice(["user", "", "assistant"]), rng.choice(["", "é😀", "abc", "b"])) for _ in range(rng.choice((0, 0, 1, 2, 9)))])
    rows = [(c, None if i == 0 else i, None if r == "" else r, None if x == "" else x, 1) for c, s in sequences.items() for i, (r, x) in enumerate(s)]
    rows += [(None, 1, "user", "nobody", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, keys int").withColumn("block", F.lit(1)).withColumn("n_chars", F.lit("x"))
    everyone = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    got = prefix_trie.trie(everyone, prefix_trie.turns_of(df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(nodes_of(sequences), key=repr)


def test_trie_without_turns(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(nothing.select("conv_id"), prefix_trie.turns_of(nothing)).collect() == []
    alone = spark.createDataFrame([(7,), (3,)], "conv_id long")
    assert [tuple(r) for r in prefix_trie.trie(alone, prefix_trie.turns_of(nothing)).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def test_rebuilt_takes_the_base_conversation(spark):
    said = lambda c, n: [(c, t, "user", f"{c}.{t}") for t in range(n)]
    df = spark.createDataFrame(said(100, 2) + said(101, 4) + said(205, 3), "conv_id long, turn long, role string, text string")
    convs, turns = prefix_trie.rebuilt(df, F.col("conv_id") - F.col("conv_id") % 100, F.lit(3), 5)
    assert sorted(r.conv_id for r in convs.collect()) == [100, 101, 205]
    assert Counter(r.conv_id for r in turns.collect()) == {100: 2, 101: 3}  # 205 has no base and no more than its first three


def test_extents_search_both_ways():
    import numpy as np

    rng = random.Random(2)
    shared = np.array([-1] + [rng.choice((-1, 0, 1, 2, 3)) for _ in range(60)])
    at, depth = np.array([i for i in range(61) for _ in range(3)]), np.array([1, 2, 3] * 61)
    left, right = prefix_trie.extents(prefix_trie.sparse_table(shared), at, depth)
    for i, d, x, y in zip(at, depth, left, right, strict=True):
        lo = hi = i
        while lo > 0 and shared[lo] >= d:
            lo -= 1
        while hi + 1 < 61 and shared[hi + 1] >= d:
            hi += 1
        assert (lo, hi) == (x, y)
