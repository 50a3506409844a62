"""Tree contraction and the conversation trie against plain recursion."""

import hashlib
import random
import zlib

import pytest

from tableloom.llm import plans, prefix_trie
from tableloom.llm.tree_sums import path_sums, subtree_sums
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, node string, at int"


def sums(spark, parents, values):
    depth = {}
    for n in parents:
        chain = [n]
        while chain[-1] not in depth and parents[chain[-1]] is not None:
            chain.append(parents[chain[-1]])
        top = chain.pop() if chain[-1] in depth or parents[chain[-1]] is None else None
        depth.setdefault(top, 0)
        for x in reversed(chain):
            depth[x] = depth[parents[x]] + 1
    nodes = spark.createDataFrame([(n, p, depth[n], values[n], 1) for n, p in parents.items()], "node long, parent long, depth long, v long, one long")
    got = {r["node"]: (r["v"], r["one"]) for r in subtree_sums(nodes, ["v", "one"]).collect()}
    want = {n: [values[n], 1] for n in parents}
    for n in sorted(parents, key=depth.__getitem__, reverse=True):
        if parents[n] is not None:
            want[parents[n]][0] += want[n][0]
            want[parents[n]][1] += want[n][1]
    assert got == {n: tuple(w) for n, w in want.items()}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest", "combs"])
def test_subtree_sums(spark, shape):
    rng = random.Random(5)
    if shape == "chain":
        parents = {i: i - 1 if i else None for i in range(300)}
    elif shape == "star":
        parents = {i: 0 if i else None for i in range(2000)}
    elif shape == "random":
        parents = {i: rng.randrange(max(0, i - 5), i) if i else None for i in range(400)}
    elif shape == "forest":
        parents = {i: None if i % 50 == 0 else i - 1 - rng.randrange(min(3, i % 50)) for i in range(300)}
    else:
        parents = {i: None if i == 0 else (i - 1 if i < 100 else i - 100) for i in range(200)}
    sums(spark, parents, {i: rng.randint(-9, 9) for i in parents})


def test_no_nodes(spark):
    empty = spark.createDataFrame([], "node long, parent long, depth long, v long")
    assert subtree_sums(empty, ["v"]).collect() == []


def brute(rows, graft):
    """The trie by plain recursion over lists of turns."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    convs = {c: [(role, text) for _, role, _, text in sorted(ts)] for c, ts in by.items()}
    if graft:
        def whole(c):
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (c % 5 if c >= 0 else -(-c % 5))
            return convs.get(base, [])[:h] + convs[c][h:]

        convs = {c: whole(c) for c in convs}
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        parts = [below(k) for k in kids.get(path, [])]
        return (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))

    return {
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids.get(path, [])), *below(path),
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path)).encode()).hexdigest())
        for path, m in members.items()
    }


def trie(spark, rows, graft=True):
    turns = prefix_trie.order_turns(spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS))
    members = turns.select("conv_id")
    got = prefix_trie.build_trie(prefix_trie.graft_beginnings(turns) if graft else turns, members).collect()
    assert len({(r["conv_id"], r["depth"]) for r in got}) == len(got)
    return {tuple(r) for r in got}


def odd_rows():
    rng, rows = random.Random(2), []
    for c in [*range(0, 40), -1, -3, -5, -7, 10**12]:
        for t in range(rng.randint(1, 10)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", None, "", "é|é"])))
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a"), (41, 2, "user", "x" * 300_000)]
    rows += [(50, t, "user", f"turn {t % 7}") for t in range(150)] + [(51, t, "user", f"turn {t % 7}") for t in range(140)]
    return rows


@pytest.mark.parametrize("graft", [True, False])
def test_trie_of_odd_rows(spark, graft, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    assert trie(spark, odd_rows(), graft) == brute(odd_rows(), graft)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == set()
    alone = [(c, 0, "user", "hi") for c in range(1, 30) if c % 5]  # their base conversations are absent
    assert trie(spark, alone) == brute(alone, True)


def test_query_equals_sql(spark):
    assert not compare(spark, connect(SF), plans.op13_prefix_trie, plans.ORACLES["op13_prefix_trie"], SF)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_path_sums(spark, block):
    """Against plain sums over all longer beginnings, with values of both signs."""
    rng = random.Random(block)
    convs = {c: [rng.choice("ab") for _ in range(rng.choice([0, 3, 9, 40]))] for c in rng.sample(range(-50, 500), 60)}
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault("".join(said[:d]), []).append(c)
    value = {path: rng.randint(-9, 9) for path in members}
    nodes = spark.createDataFrame([(p, min(m), len(p), value[p], 1) for p, m in members.items()], "path string, c long, depth long, v long, one long")
    paths = spark.createDataFrame([(c, len(p), p) for p, m in members.items() for c in m], "c long, depth long, path string")
    got = {r["path"]: (r["v"], r["one"]) for r in path_sums(nodes, paths, "c", ["path"], ["v", "one"], block).collect()}
    assert got == {p: (sum(v for q, v in value.items() if q.startswith(p)), sum(q.startswith(p) for q in value)) for p in value}


def test_plans_do_not_grow_with_depth(spark):
    """The driver runs as many jobs for a dialogue of 300 turns as for one of three."""
    def jobs(turns):
        rows = spark.createDataFrame([(c, t, "user", f"{t % 3} {c if t > turns // 2 else 0}", "x", 7) for c in range(4) for t in range(turns)], TURNS)
        spark.sparkContext.setJobGroup(group := f"trie of {turns}", "")
        prefix_trie.build_trie(prefix_trie.order_turns(rows)).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(300) <= jobs(3) + 4
