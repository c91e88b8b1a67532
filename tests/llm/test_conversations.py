"""Repair and prefix trie of conversations against brute force: nulls, ties, repeated rows, empty tables, runs that cut a conversation."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tessella.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, kind string, pos long, node long, place int"
SPACES = " \t\n\x0b\x0c\r"
TEXTS = ["Yes. Go", "all right!", "so it is", "", " \n", "what? ", "end.", None, "é ö.\n"]


def some_rows(seed, n):
    random.seed(seed)
    rows = []
    for c in [*range(n), None, -7]:
        for t in range(random.choice([0, 1, 2, 3, 5, 7])):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, random.choice([t, t, t, t + 2, None, 1]), role, random.choice(TEXTS), "k", 1, 2, 3))
    rows += random.sample(rows, 10)  # repeated rows
    for c in range(30, 36):  # a beginning that several share
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < c - 30 else c}.", "k", 1, 2, 3) for t in range(6)]
    rows += [(c, t, "user", "same again.", "k", 1, 2, 3) for c in (61, 62, 63, 64) for t in range(4)]
    return rows


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def cheapest(turns):
    """(cost, audit, repaired) by trying all edits: turns (role, text, forced, truncated)."""
    best = [10**9, "", []]

    def go(i, state, cost, audit, out):
        if cost > best[0] or audit.endswith("III"):
            return
        if i == len(turns) and state in "oa" and (cost, audit) < (best[0], best[1]):
            best[:] = [cost, audit, out]
        after = "assistant" if state == "u" else "user"
        if i < len(turns):
            role, text, forced, cut = turns[i]
            go(i + 1, state, cost + 3, audit + "D", out)
            if not forced:
                if role[:1] in {"o": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}[state]:
                    go(i + 1, role[:1], cost + cut, audit + "K", [*out, f"{role}:{text}"])
                go(i + 1, after[0], cost + cut + 2, audit + "R", [*out, f"{after}:{text}"])
        go(i, after[0], cost + 2, audit + "I", [*out, f"{after}:"])

    best[0] = 3 * len(turns)
    best[1] = "D" * len(turns)
    go(0, "o", 0, "", [])
    return best


def expected_repair(rows):
    damaged = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        damaged[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged[c] += [(c, t, role, text)] * (2 if kind == 3 else 1)
    want = {}
    for c, mine in damaged.items():
        seen, turns, n = set(), [], collections.Counter()
        mine = order(mine)
        for _, _, role, text in mine:
            last = text.strip(SPACES)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        given = [r[1] for r in mine if r[1] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, out = cheapest(turns)
        want[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return want


@pytest.mark.parametrize("bits", [12, 1])
def test_repair(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "RUN_BITS", bits)  # runs of two turns cut most conversations
    rows = some_rows(bits, 40)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repaired_turns_follow_the_audit(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "tool", "x."), (1, 3, "assistant", "x."), (2, 0, "user", "")]
    path = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    found, repaired, _ = repair.repair(path)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (4, "KIKRK"), 2: (3, "D")}
    assert [tuple(r)[1:] for r in repaired.orderBy("conv_id", "place").collect()] == [(1, "K", "system", "be kind."), (2, "I", "user", ""), (3, "K", "assistant", "hello."), (4, "R", "user", "x."), (5, "K", "assistant", "x.")]


def test_repair_of_one_long_conversation(spark):
    """Half of all rows in one conversation: many runs, and the fold over runs equals that over turns."""
    roles = ["user", "assistant", "assistant", "user", "tool"]
    rows = [(1, t, roles[(t * t) % 5], f"text {t % 700}{'.' if t % 3 else ''}") for t in range(9000)] + [(c, 0, "user", "a.") for c in range(2, 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(3)
    found, repaired, _ = repair.repair(df)
    one = found.where("conv_id = 1").first()
    assert one.duplicate == 9000 - len({(r, x) for c, _, r, x in rows if c == 1})
    kept = repaired.where("conv_id = 1").orderBy("place").collect()
    assert [r.place for r in kept] == list(range(1, len(kept) + 1)) and re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
    cost = {"K": 0, "R": 2, "I": 2, "D": 3}
    assert one.cost == sum(cost[x] for x in one.audit) + sum(r.edit != "I" and r.text[-1:] not in ".!?" for r in kept)


def expected_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            by[c].append((c, t, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in order(x)] for c, x in by.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(c - 20 * int(c / 20)), [])[:h] + mine[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    want = {}

    def fold(p):
        below = [fold(k) for k in kids[p]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = sum(b[0] for b in below) or 1, (len(members[p]) - 1) * words + sum(b[1] for b in below)
        want[(min(members[p]), len(p))] = (min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        return leaves, saved

    fold(())
    return want


def test_trie(spark, tmp_path):
    rows = some_rows(5, 90)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op12(spark, str(tmp_path)).collect()
    want = expected_trie(rows)
    assert len(got) == len(want) and {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want


def test_one_conversation_and_none(spark, tmp_path):
    for k, rows in enumerate(([], [(None, 0, "user", "x", "k", 1, 2, 3)], [(40, 0, "user", "one two", "k", 1, 2, 3)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        got = trie.op12(spark, f"{tmp_path}/{k}").collect()
        want = expected_trie(rows) if k == 2 else {}
        assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want
        assert len(repair.op11(spark, f"{tmp_path}/{k}").collect()) == (0 if k == 0 else 1)
