"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest

from quoin.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            top = node[:d]
            leaves[top] = leaves.get(top, 0) + (node not in kids)
            saved[top] = saved.get(top, 0) + ((len(who) - 1) * len(node[-1][1].encode()) if node else 0)
    out = {}
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        out[(min(who), len(node))] = (min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def checked(spark, rows, schema=SCHEMA):
    got = P.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:8] for r in got} == brute([r[:4] for r in rows])
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    assert sorted(x for r in got for x in (r.enter_at, r.exit_at)) == list(range(2 * len(got)))
    at = {(r.conv_id, r.depth): (r.enter_at, r.exit_at) for r in got}
    for r in got:
        if r.depth:
            up = at[(r.parent_conv_id, r.depth - 1)]
            assert up[0] < r.enter_at < r.exit_at < up[1]
    return got


@pytest.fixture
def small(monkeypatch):
    """Bounds so small that a test table has several chunks, levels of splitters, hot parents and pieces of ids."""
    for name, value in {"CHUNK": 4, "FINISH": 12, "STRIDE": 3, "HOT": 5, "IDS": 3}.items():
        monkeypatch.setattr(P, name, value)


def test_tables_of_few_turns(spark, small):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(("user", "assistant")), draw.choice("ab")) for c in range(60) for t in range(draw.randint(1, 12))]
    copies = [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(10)]
    checked(spark, rows + copies)


def test_a_long_conversation_and_negative_ids(spark, small):
    rows = [(7, t, "user", f"t{t % 3}") for t in range(150)] + [(5, t, "user", f"t{t % 3}") for t in range(130)]
    rows += [(c, t, "user", "x" * (t + 1)) for c in (-11, -10, -3, -1, 0, 4) for t in range(9)]
    checked(spark, rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 3, "user", "é"), (None, 1, "user", "lost"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, None, None, None), (8, 5, "", "")]
    checked(spark, rows)
    checked(spark, [(*r, 1, "k") for r in rows], SCHEMA + ", depth int, h1 string")
    tied = [(1, 2, "user", "a"), (1, 2, "user", "b"), (1, 2, "assistant", "a")]
    again = [P.prefix_trie(spark.createDataFrame(x, SCHEMA)).drop("enter_at").orderBy("conv_id", "depth").collect() for x in (tied, tied[::-1])]
    assert again[0] == again[1]


def test_turnless_conversations_and_no_table(spark):
    gone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its base is absent, its one turn is dropped
    got = checked(spark, [(gone, 0, "user", "a")])
    assert [(r.conv_id, r.depth, r.n_leaves, r.ends_sha256) for r in got] == [(gone, 0, 1, hashlib.sha256(str(gone).encode()).hexdigest())]
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).collect() == []


def test_ranks_of_several_lists(spark):
    chain = [(f"a{i}", f"a{i + 1}" if i < 199 else None, 1, i) for i in range(200)] + [("b", None, 1, 7)]
    got = {r.id: (r.n, r.s) for r in P.rank_list(spark.createDataFrame(chain, "id string, next string, n long, s long"), ["n", "s"], finish=10).collect()}
    assert got == {f"a{i}": (200 - i, sum(range(i, 200))) for i in range(200)} | {"b": (1, 7)}
