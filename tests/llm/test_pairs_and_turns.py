"""Conversation repair, SimHash and hard negatives against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldtrace.llm import hard_negatives, simhash_tree, turn_repair

WS = re.compile(r"[^\x20\x09-\x0D]+")


# conversation repair


def cheapest(rows):
    """(cost, audit) by search over all edits, the state being the part of the grammar read so far."""
    seen, flags = set(), []
    for role, text in rows:
        bare = "".join(WS.findall(text))
        flags.append("blank" if not bare else "duplicate" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    memo = {}

    # insertions make cycles of states: at most two in a row are of use before each turn
    def with_inserts(i, state, left=2):
        found = [closed(i, state)]
        if left:
            for letter in "ua":
                if (state, letter) in step:
                    after = with_inserts(i, step[state, letter], left - 1)
                    found.append((2 + after[0], "I" + after[1]))
        return min(found)

    def closed(i, state):
        if (i, state) in memo:
            return memo[i, state]
        found = [(0, "")] if i == len(rows) and state in ("", "a") else [(math.inf, "")]
        if i < len(rows):
            after = with_inserts(i + 1, state)
            found.append((3 + after[0], "D" + after[1]))
            if flags[i] not in ("blank", "duplicate"):
                extra = flags[i] == "cut"
                for letter, price, name in [(rows[i][0][:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                    if (state, letter) in step:
                        after = with_inserts(i + 1, step[state, letter])
                        found.append((price + extra + after[0], name + after[1]))
        memo[i, state] = min(found)
        return memo[i, state]

    cost, audit = with_inserts(0, "")
    return cost, audit, Counter(flags)


def test_alignment_against_search():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", "unknown"]
    for case in range(1500):
        n = rng.randint(0, 14)
        rows = [(rng.choice(roles[: 2 + case % 5]), rng.choice(["Yes.", "No.", "", " \t", "cut", f"t{rng.random()}.", f"t{rng.random()}"])) for _ in range(n)]
        found, audit, repaired = turn_repair.repair_turns([None] * n, [r for r, _ in rows], [t for _, t in rows])
        cost, want, flags = cheapest(rows)
        assert (found["cost"], audit) == (cost, want), rows
        assert (found["blank"], found["duplicate"], found["truncated"]) == (flags["blank"], flags["duplicate"], flags["cut"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in repaired))


def test_long_conversations_keep_few_rows_of_the_table():
    rng = random.Random(6)
    letters = "".join(rng.choice("uuaaus") if rng.random() < 0.3 else "ua"[k % 2] for k in range(400))
    cost, audit = turn_repair.align(letters, [rng.random() < 0.1 for _ in letters])
    rows = [({"u": "user", "a": "assistant", "s": "system"}[x], f"{k}.") for k, x in enumerate(letters)]
    plain = turn_repair.align(letters, [False] * 400)
    assert plain == cheapest(rows)[:2]
    table = turn_repair.Table(letters, [False] * 400, turn_repair.incumbent(letters))
    assert len(table.kept) <= 400 // turn_repair.KEEP + 2 and cost >= plain[0] and len(audit) >= 400


def conversations():
    rng = random.Random(7)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else t + 1, "ua"[t % 2] == "u" and "user" or "assistant", f"words {rng.randint(0, 3)} {c}" + rng.choice([".", "!", "", "?\n"])))
    rows += [(c, 1, "user", "q.") for c in range(300, 360)]
    rows += [(200, None, "user", "a."), (200, 3, None, None), (None, 1, "user", "x."), (None, None, None, None), (201, 1, "system", "s."), (201, 1, "system", "s."),
             (202, 5, "assistant", "word " * 30_000), (203, -4, "", "y.")]
    return rows


def damaged(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out[c] += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def test_turn_repair(spark, tmp_path):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("clash"), "fault": F.lit(1), "copies": F.lit(9)})
    table.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()}
    want = damaged(rows)
    assert set(got) == set(want) and len(got) == len(want)
    faults = Counter()
    for c, turns in want.items():
        cost, audit, flags = cheapest([x[1:] for x in turns])
        known = [t for t, *_ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        due, lines, i = "user", [], 0
        for step in audit:
            if step == "D":
                i += 1
                continue
            role, text = (due, "") if step == "I" else (turns[i][1] if step == "K" else due, turns[i][2])
            i += step != "I"
            lines.append(f"{role}:{text}")
            due = due if role[:1] == "s" else "assistant" if due == "user" else "user"
        r = got[c]
        assert (r["cost"], r["audit"], r["blank"], r["duplicate"], r["truncated"]) == (cost, audit, flags["blank"], flags["duplicate"], flags["cut"]), c
        assert r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        faults.update(flags)
    assert all(faults[f] for f in ("blank", "duplicate", "cut")) and any(not x for x in want.values())
    assert turn_repair.repair(table.where("false")).count() == 0
    names = turn_repair.repair(table.withColumn("conv_id", F.col("conv_id").cast("string"))).schema["conv_id"].dataType.simpleString()
    assert names == "string"


# SimHash


def printed(text):
    w = WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(keys, linked):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(keys)), 2):
        if linked(keys[i], keys[j]):
            root[find(i)] = find(j)
    return [find(i) for i in range(len(keys))]


def smallest(ids, groups):
    least = {}
    for i, g in zip(ids, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in groups]


def texts():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["Alpha", "é", "x1", "$", "word", "der"]) + str(rng.randint(0, 50)) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(60)]
    base = [f"W{i}" for i in range(400)]
    rows += [(100 + k, " ".join(w if j != 7 * k else "edit" for j, w in enumerate(base))) for k in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "One"), (None, text(30)), (None, None), (205, rows[0][1]), (3, rows[3][1]), (206, text(50_000)), (207, " a b c d e")]
    return rows


def test_simhash_dedup(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(1), "component_id": F.lit("x"), "fp": F.lit(0), "shard": F.lit(0), "label": F.lit(0)})
    got = simhash_tree.simhash_dedup(docs.repartition(3))
    keys = [printed(t) for _, t in rows]
    least = smallest([i for i, _ in rows], components(keys, lambda a, b: (a ^ b).bit_count() <= 4))
    assert Counter(map(tuple, got.select("doc_id", "text", "fingerprint", "component_id").collect())) == Counter((i, t, f"{k:016x}", c) for (i, t), k, c in zip(rows, keys, least))
    assert set(got.columns) == set(docs.columns) and [r[0] for r in got.select("shard").distinct().collect()] == [0]
    assert sum(c == 100 for c in least) > 10 and least[60 + 20] == least[60 + 21] == 200
    assert simhash_tree.simhash_dedup(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def prints():
    rng = np.random.default_rng(9)
    spread = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    near = [spread[k] ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for k in range(100) for b, c in rng.integers(0, 64, (2, 2))]
    dense = [np.uint64(0xF0F0) ^ sum((np.uint64(1) << np.uint64(b) for b in set(rng.integers(0, 64, 5).tolist())), np.uint64(0)) for _ in range(400)]
    return np.unique(np.concatenate([spread, near, dense]).astype(np.uint64))


def test_tree_loses_no_pair(prints):
    tree = simhash_tree.plant(prints[::3], 40)
    at, shard, home = simhash_tree.place(prints, tree)
    assert len(set(shard.tolist())) > 8 and np.array_equal(np.sort(at[home]), np.arange(len(prints)))
    lives = np.zeros(len(prints), np.int64)
    lives[at[home]] = shard[home]
    visits = {(a, s) for a, s in zip(at.tolist(), shard.tolist())}
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 4)
    assert len(i) > len(prints) and all((a, lives[b]) in visits or (b, lives[a]) in visits for a, b in zip(i.tolist(), j.tolist()))
    assert all(s >= lives[a] for a, s in visits)  # each pair meets once, in the later shard


def test_links_in_blocks(spark, prints, monkeypatch):
    for name, value in {"SHARD": 200, "POINTS": 90, "QUERIES": 150, "SAMPLE": 700, "PAIRS": 1000, "RING_POINTS": 50}.items():
        monkeypatch.setattr(simhash_tree, name, value)
    table = spark.createDataFrame([(int(i), int(p)) for i, p in enumerate(prints.view(np.int64))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash_tree.near_copies(table).select("doc_id", "component_id").collect()}
    want = smallest(range(len(prints)), components(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 4))
    assert [got[i] for i in range(len(prints))] == want


def test_links_stay_below_the_points_of_a_block():
    rng = np.random.default_rng(10)
    for n in (64, 128, 256):  # all within reach of each other
        dense = np.unique(np.uint64(1 << 40) + (np.uint64(1) << rng.integers(0, 30, n).astype(np.uint64)) + (np.uint64(1) << rng.integers(30, 38, n).astype(np.uint64)))
        a, b = simhash_tree.joined(dense, dense)
        assert len(a) == len(dense) - 1 and len(np.unique(b)) == 1


# hard negatives


def brute_negatives(rows):
    q = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        key = (label, [math.floor(256 * x) for x in v])
        q[i] = min(q.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sorted(x for x in q if x % 100 == 0):
        scored = sorted((-dot(q[a][1], q[i][1]), i) for i in q if i != a)
        for s, p in [x for x in scored if q[x[1]][0] == q[a][0]][:5]:
            fits = [(n, i) for n, i in scored if q[i][0] != q[a][0] and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits)]
    return out


def vectors():
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 3), [rng.choice([0.0, rng.gauss(0, 1), 0.5, -0.25]) for _ in range(6)]) for i in range(420)]
    rows += [(1000 + i, 1, [1.0, 0.5, 0.0, 0.0, -1.0, 0.25]) for i in range(150)]  # one vector, many ids
    rows += [(500, 2, [0.0] * 6), (600, None, [1.0] * 6), (None, 1, [1.0] * 6), (700, 1, None), (800, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (900, 1, [float("nan")] * 6),
             (2000, 3, [float("inf")] + [1.0] * 5), (2100, 9, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (300, 2, rows[300][2]), (2200, 1, []), (2201, 1, [1.0, 1.0])]
    return rows


def test_hard_negatives(spark, tmp_path, monkeypatch):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("x"), "q": F.lit(1), "score": F.lit(1)})
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    as_float = [(i, b, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, b, v in rows]
    want = brute_negatives(as_float)
    for shard, block, depth in ((8192, 4096, 32), (60, 2, 1)):
        for name, value in {"SHARD": shard, "BLOCK": block, "DEPTH": depth}.items():
            monkeypatch.setattr(hard_negatives, name, value)
        assert Counter(map(tuple, hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect())) == Counter(want)
    assert len(want) > 50
    assert hard_negatives.mine(table.where("false"), F.col("id") % 100 == 0).count() == 0


def test_sorted_access_stops_early():
    rng = np.random.default_rng(12)
    vectors = rng.integers(-5, 5, (4000, 4)).astype(np.int64)
    vectors[:20] += 200
    shard = hard_negatives.Shard(np.arange(4000), np.zeros(4000, np.int64), vectors)
    reads = []
    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                reads.append(len(at))
            return np.asarray(self)[at]
    shard.vectors = shard.vectors.view(Counted)
    (place, score), = shard.search(np.array([1, 2, 1, 1]), np.ones(4000, bool), [(None, None)], 5)
    exact = vectors @ np.array([1, 2, 1, 1])
    assert score.tolist() == sorted(exact.tolist(), reverse=True)[:5] and sum(reads) < 1000 and place.tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist()
