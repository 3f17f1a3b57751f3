"""The n-gram join and the line deduplication against brute force."""

import random
import re

import numpy as np
import pytest

from quoin.llm.common import SPACED, components, hash_words, shingle_hashes
from quoin.llm import common, line_dedup
from quoin.llm.line_dedup import MIN_CHARS, SHINGLE, ALIKE, dedup_lines
from quoin.llm.ngram_join import divide_skip, merge_skip, op5_ngram_join, similar_documents

WORDS = [f"w{i}" for i in range(400)] + ["été", "größe", "señor", "đại", "汉字"]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 120))]
        if i % 7 == 0:
            words[:0] = passage
        texts.append(" ".join(words))
    for i in range(0, n, 2):
        words = texts[i].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(rng.choice([" ", "\t\n "]).join(words).upper() if i % 4 else " ".join(words))
    return texts + [None, "", " \n", "one two", "ONE  two", "one two three", "x " * 3000, "x " * 2500]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(sets):
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("bound", [4_000_000, 300])
def test_join_is_exact(spark, bound):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs, task_shingles=bound).collect()}
    sets = [shingles(t) for t in texts]
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets)))}


def test_group_of_near_copies_is_one_component(spark):
    """A chain of edits: neighbours are alike, the ends are not; a small bound cuts the block to pieces."""
    rng = random.Random(3)
    words = [rng.choice(WORDS) for _ in range(200)]
    texts = []
    for i in range(80):
        words = list(words)
        words[rng.randrange(200)] = f"new{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(docs, task_shingles=3000).collect()}
    assert [got[i] for i in range(80)] == brute_components([shingles(t) for t in texts])


def test_join_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert similar_documents(none).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in similar_documents(docs).collect()) == [(-1, 3), (3, 3), (3, 3), (5, 5)]


def test_null_ids_are_linked(spark):
    """Near copies of rows without an id, and documents that only such a row connects."""
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        words = [rng.choice(WORDS) + str(i) for i in range(60)]
        texts.append([" ".join(words[:50] + [f"x{j}{i}" for i in range(j, 6)] + words[50:]) for j in (0, 3, 6)])
    rows = [(7, texts[0][0]), (None, texts[0][1]), (9, texts[1][0]), (None, texts[1][1]), (4, texts[1][2]), (None, texts[2][0]), (None, texts[2][1]), (1, "something else entirely stands in here")]
    got = [(r.doc_id, r.component_id) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = brute_components([shingles(t) for _, t in rows])
    ids = {g: min((d for (d, _), h in zip(rows, groups) if h == g and d is not None), default=None) for g in groups}
    assert sorted(got, key=str) == sorted(((d, ids[g]) for (d, _), g in zip(rows, groups)), key=str)
    assert (None, 7) in got


def test_t_occurrence():
    rng = np.random.RandomState(0)
    for most in (50, 3000):
        for _ in range(20):
            lists = [np.unique(rng.randint(0, most, rng.randint(1, most))) for _ in range(rng.randint(1, 25))]
            least = int(rng.randint(1, len(lists) + 1))
            counts = np.bincount(np.concatenate(lists))
            expected = {int(i): int(counts[i]) for i in np.flatnonzero(counts >= least)}
            assert dict(zip(*map(np.ndarray.tolist, divide_skip(lists, least)))) == expected
            assert {k: v for k, v in merge_skip(lists, least).items()} == expected


def test_hashed_words_are_words():
    import pyarrow as pa

    texts = corpus() + ["a" * 3_000_000 + " b", "é" * 700_000]
    hashes, begin = hash_words(pa.array(texts), SPACED)
    seen = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        assert len(words) == begin[i + 1] - begin[i]
        for w, h in zip(words, hashes[begin[i] : begin[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_hashes(hashes[:4], 5)) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(100)]
    of = {}
    for a, b in edges:
        of.setdefault(a, a), of.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(of[a], of[b])
            if of[a] != m or of[b] != m:
                of[a] = of[b] = m
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in of.items() if k in linked}


def test_query_on_given_table(spark, sf):
    out = op5_ngram_join(spark, sf)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# ------------------------------------------------------------------------------- lines
def line_set(line):
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def brute_lines(texts):
    """Kept positions of each text, by all pairs."""
    at = [(d, p, line.strip(" \t\r\f ").lower()) for d, t in enumerate(texts) for p, line in enumerate((t or "").split("\n"))]
    at = [x for x in at if len(x[2]) >= MIN_CHARS]
    sets = [line_set(x[2]) for x in at]
    of = list(range(len(at)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= ALIKE * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    gone = {(d, p) for i, (d, p, _) in enumerate(at) if root(i) != i}
    return ["\n".join(line for p, line in enumerate(t.split("\n")) if (d, p) not in gone) if t is not None else None for d, t in enumerate(texts)]


def line_corpus():
    rng = random.Random(11)
    lines = [" ".join(rng.choice(WORDS) + rng.choice(["", "ing", "tion"]) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    texts = []
    for _ in range(40):
        own = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(lines)
            kind = rng.random()
            if kind < 0.3 and len(line) > 250:
                words = line.split(" ")
                words[rng.randrange(len(words))] = "changed"
                line = " ".join(words)
            elif kind < 0.5:
                line = "  " + line.upper() + "\t"
            elif kind < 0.6:
                line = "short"
            own.append(line)
        texts.append("\n".join(own))
    return texts + [None, "", "\n\n", "z" * 5000]


def test_lines_like_brute_force(spark):
    texts = line_corpus()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, line string, doc int")
    got = {r.row.doc_id: r for r in dedup_lines(docs).collect()}
    expected = brute_lines(texts)
    assert len(got) == len(texts)
    wrong = [i for i in range(len(texts)) if got[i].text != expected[i]]
    assert len(wrong) <= 1  # banding finds a pair with a chance of 0.99
    assert got[40].text is None and got[40].n_lines == 0
    assert got[0].row.line == "x" and got[0].row.doc == 7


def test_lines_edge_cases(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    line = "the same rather long line of text stands here"
    docs = spark.createDataFrame([(None, line), (4, line), (4, line), (9, f"{line}\nand something that only this text has")], "doc_id long, text string")
    got = sorted((r.row.doc_id or -1, r.text, r.emptied) for r in dedup_lines(docs).collect())
    assert got == [(-1, line, False), (4, "", True), (4, "", True), (9, "and something that only this text has", False)]


def crowded_lines():
    """Groups of copies that share most of their text, and so their buckets, and a chain of edits whose ends differ."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = [word() for _ in range(60)]
    lines = []
    for _ in range(40):
        own = [word() for _ in range(16)]
        lines += [" ".join(common + own), " ".join(common + own[:-1] + [word()])]
    chain = [word() for _ in range(60)]
    for i in range(25):
        lines.append(" ".join(chain))
        chain[4 * i % 60 : 4 * i % 60 + 4] = [word() for _ in range(4)]
    rng.shuffle(lines)
    return lines


@pytest.mark.parametrize("block", [512, 6])
def test_every_group_of_a_bucket(spark, monkeypatch, block):
    """With blocks of 6, buckets are refined and dealt into blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    texts = crowded_lines()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


@pytest.mark.parametrize("opening", [0, 50])
def test_recall_by_similarity(spark, opening):
    """Pairs of every similarity, alone or 300 of them behind one long opening: all pairs are the truth."""
    rng = random.Random(31 + opening)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    common, pairs = [word() for _ in range(opening)], []
    for i in range(300):
        own = [word() for _ in range(25)]
        other = list(own)
        for at in rng.sample(range(25), i % 4):
            other[at] = word()
        pairs.append((" ".join(common + own), " ".join(common + other)))
    docs = spark.createDataFrame([(2 * i + j, line) for i, p in enumerate(pairs) for j, line in enumerate(p)], "doc_id long, text string")
    emptied = {r.row.doc_id for r in dedup_lines(docs).where("emptied").select("row").collect()}
    by_band = {}
    for i, (a, b) in enumerate(pairs):
        x, y = line_set(a), line_set(b)
        like = len(x & y) / len(x | y)
        if like >= ALIKE:
            by_band.setdefault(min(int(like * 20), 19), []).append(2 * i + 1 in emptied)
        elif not opening:
            assert 2 * i + 1 not in emptied
    assert by_band and all(sum(v) >= 0.95 * len(v) for v in by_band.values()), {k: (sum(v), len(v)) for k, v in by_band.items()}


def test_repeated_content_is_a_copy(spark):
    """Twice the length, but nearly the same shingles."""
    rng = random.Random(8)
    line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(18))
    texts = [line, f"{line} {line}", f"{line} {line} {line}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert [got[i] for i in range(3)] == brute_lines(texts) == [line, "", ""]


def test_sketches_never_refuse_a_copy(spark):
    """Sketches differ in no more bits than the sets of shingles differ in; repeated shingles count once."""
    rng = random.Random(13)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 60))) for _ in range(12)]
    lines += [f"{x} {rng.choice(WORDS)}" for x in lines] + [f"{lines[0]} {lines[0]}", "ha " * 40, "z" * 3000]
    got = {r.line_id: r for r in line_dedup.sketches(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")).collect()}
    sets = [line_set(x) for x in lines]
    assert [got[i].size for i in range(len(lines))] == [len(s) for s in sets]
    bits = lambda i, j: sum(bin((got[i][p] ^ got[j][p]) & (2**64 - 1)).count("1") for p in line_dedup._PARITIES)
    for i in range(len(lines)):
        assert all(bits(i, j) <= len(sets[i] ^ sets[j]) for j in range(i))


def test_buckets_are_compared_by_sketches_alone(spark, monkeypatch):
    """Sets of shingles are made for the pairs that sketches let through, not for each row of a bucket."""
    plans, kept = [], common.saved
    noted = lambda df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, *a, **k))[1]
    monkeypatch.setattr(common, "saved", noted)
    monkeypatch.setattr(line_dedup, "saved", noted)
    docs = spark.createDataFrame(list(enumerate(crowded_lines())), "doc_id long, text string")
    assert dedup_lines(docs).where("emptied").count() > 0
    assert any("array_intersect" in p for p in plans) and any("op15" in p and "band" in p for p in plans)
    assert not any("array_intersect" in p and "band" in p for p in plans)
