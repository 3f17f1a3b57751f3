"""Mixing, decontamination, fingerprints, licenses, WARC records, tokens, quality and language."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoin.llm import decontaminate as D
from quoin.llm import fingerprint as P
from quoin.llm import language as N
from quoin.llm import quality as Q
from quoin.llm import tokens as T
from quoin.llm.licenses import TEMPLATES, scan_licenses
from quoin.llm.mixing import mix_documents, mixing_plan, source_targets
from quoin.llm.warc import derivatives, parsed, plain_text, responses, serialised

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------------------- mixing
def test_targets_fill_up(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 1, None: 50}, {"x": 0, "y": 7}, {"only": 5}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
        while open_:
            unit = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
            if not full:
                target |= {s: unit * weight[s] for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in full}
            left -= sum(2.0 * sizes[s] for s in full)
            open_ -= full
        assert got == pytest.approx(target)


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, "en", "s", 0), (None, "x y", "en", None, 3), (3, " ", None, "t", 1)], DOCS)
    plan = {r.doc_id: r for r in mixing_plan(docs).collect()}
    assert (plan[1]["size"], plan[2]["size"], plan[None]["size"], plan[3]["size"]) == (3, 0, 2, 0)
    assert all(0 <= r.copies <= 2 for r in plan.values())
    mixed = mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {k: r.copies for k, r in plan.items() if r.copies}
    assert mixing_plan(spark.createDataFrame([], DOCS)).collect() == []


def test_mixing_without_ids_comes_near_its_targets(spark):
    """Rows without an id and rows that share one draw apart; copies of a row in every respect draw together."""
    rows = [(None if i % 2 else 7, f"w{i} a b c", "en", "s", 9) for i in range(2000)] + [(i, "x y", "en", "t", 3) for i in range(1000)]
    plan = mixing_plan(spark.createDataFrame(rows, DOCS)).collect()
    for source in ("s", "t"):
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) < 0.05 * mine[0].target
    same = mixing_plan(spark.createDataFrame([rows[1]] * 5 + rows[:500], DOCS)).where("size = 4 AND doc_id IS NULL").collect()
    assert len({r.copies for r in same}) > 1


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "s", 3, "mine", "key", 5) for i in range(9)], DOCS + ", copy string, mix_key string, size int")
    got = mix_documents(docs).collect()
    assert got and {(r.copy, r.mix_key, r.size) for r in got} == {("mine", "key", 5)} and {r.copy_ for r in got} <= {1, 2}


# ------------------------------------------------------------------------------- decontamination
def brute_hits(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        seq = words(t)
        w = min(window, len(seq))
        for i in range(len(seq) - w + 1 if w else 0):
            for j in range(len(own) - w + 1):
                if own[j : j + w] == seq[i : i + w]:
                    hit |= set(range(j, j + w))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [2_000_000, 40, 4])
def test_hits_like_brute_force(spark, bound):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "A1", "straße", "x", "yes"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [("e", ""), ("n", None)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(30)]
    texts += [f"{texts[i]} -- {items[i % 12][1].upper()}! {texts[i + 1]}" for i in range(20)] + [None, "", "..."]
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, row string")
    bench = spark.createDataFrame([*items, items[0], (None, "the the")], "item_id string, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in D.benchmark_hits(docs, bench, index_words=bound).withColumn("n_hit", D.n_hit()).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_one_index_at_a_time_and_one_scan_for_rarity(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    item = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(str(i), item(20)) for i in range(60)] + [("long", item(300))]
    texts = [item(30) + " " + items[i][1] + " " + item(9) for i in range(60)] + [items[60][1][200:900], item(500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, scans = spark.read.parquet(f"{tmp_path}/docs"), []
    monkeypatch.setattr(D, "SEGMENT", 50)
    kept = D.saved
    monkeypatch.setattr(D, "saved", lambda df: (scans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    out = D.benchmark_hits(docs, spark.createDataFrame(items, "item_id string, text string"), index_words=30)
    plans = [*scans, out._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) > 50 and max(p.count("MapInArrow") for p in plans if "runs" in p) == 1
    assert sum(p.count(f"{tmp_path}/docs") > 0 for p in plans) == 2  # for rarity, and for the first pass
    got = {r.row.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in out.withColumn("n_hit", D.n_hit()).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_no_benchmark_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.runs, r["items"]) for r in D.benchmark_hits(docs, bench).collect()] == [(2, [], [])]
    assert D.benchmark_hits(docs.limit(0), bench).collect() == []


# ------------------------------------------------------------------------------- fingerprints
def test_sketches_give_differences_back():
    rng = np.random.RandomState(4)
    for n, m, both in ((0, 0, 0), (1, 0, 3), (5, 9, 100), (300, 20, 50), (2000, 1500, 10)):
        pool = np.unique(rng.randint(1, 2**62, n + m + both)).astype(np.uint64)
        rng.shuffle(pool)
        a, b = pool[: n + both], np.concatenate([pool[n : n + both], pool[n + both :]])
        only_a, only_b = P.difference(a, b)
        assert sorted(only_a) == sorted(pool[:n].tolist()) and sorted(only_b) == sorted(pool[n + both :].tolist())


def test_sketches_of_several_pairs_at_once():
    rng = np.random.RandomState(5)
    sets = [[np.unique(rng.randint(1, 2**62, n)).astype(np.uint64) for n in (a, b, both)] for a, b, both in ((0, 0, 0), (3, 2, 40), (0, 900, 5), (700, 0, 0), (1, 1, 0), (15, 15, 2000))]
    a, b = [np.concatenate([x, both]) for x, _, both in sets], [np.concatenate([y, both]) for _, y, both in sets]
    of_a, of_b = (np.repeat(np.arange(len(sets)), list(map(len, side))) for side in (a, b))
    minus = P.Sketches(np.full(len(sets), P.CELLS)).add(np.concatenate(a), of_a).add(np.concatenate(b), of_b, -1)
    pair, digest, sign = P.differences(np.concatenate(a), of_a, np.concatenate(b), of_b, minus)
    for i, (x, y, _) in enumerate(sets):
        assert sorted(digest[(pair == i) & (sign > 0)].tolist()) == x.tolist() and sorted(digest[(pair == i) & (sign < 0)].tolist()) == y.tolist()


def test_paragraphs_that_an_edit_keeps():
    rng = random.Random(1)
    piece = ["a", "b", "\n", " ", ". ", "! ", "?\t", "\n\n", ".", "  ", "é"]
    for _ in range(5000):
        text, following = ("".join(rng.choice(piece) for _ in range(rng.randint(0, 60))) for _ in range(2))
        same, new = P._same_until(text), P.edited(text, following)
        for t in (text, new):
            assert sorted(P._digests([P._hashes(t[:same]) + P._hashes(t[same:])])[0].tolist()) == sorted(P.paragraph_digests(t).tolist())


def test_fingerprints_like_brute_force(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(6)) + rng.choice([".", "\n", "! "])
    texts = ["".join(line() for _ in range(rng.randint(0, 60))) for _ in range(50)] + [None, "", "é", "same. same. same.", "x" * 50_000]
    docs = spark.createDataFrame([(3 * i - 20, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, border string")
    got = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n] if n else t
        r = got[3 * i - 20]
        sets = [set(P.paragraph_digests(x).tolist()) for x in (t, new, following)]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(sets[0], sets[1])) and r.near_next == pytest.approx(alike(sets[0], sets[2]))
        assert {x % 2**64 for x in r.only_text} == sets[0] - sets[1] and {x % 2**64 for x in r.only_edited} == sets[1] - sets[0]


def test_fingerprints_edge_cases(spark):
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = P.fingerprints(spark.createDataFrame([(5, "abcd efgh.")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = P.fingerprints(spark.createDataFrame([(5, "a"), (5, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.near_next) for r in rows) == [(-1, 0.0), (5, 0.0), (5, 1.0)]
    assert len({r.fingerprint for r in rows}) == 2


# ------------------------------------------------------------------------------- quality
def test_ftrl_by_hand():
    """Weights and sums of the published update, coordinate by coordinate, against the vector form."""
    rng = np.random.RandomState(3)
    rows = [(np.sort(rng.choice(30, rng.randint(1, 8), replace=False)), int(rng.randint(2))) for _ in range(300)]
    model, z, n = Q.Ftrl(5), [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= Q.L1:
            return 0.0
        return -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for index, y in rows:
        x = rng.rand(len(index))
        w = [weight(i) for i in index]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, v, wi in zip(index, x, w):
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA
            z[i] += g - sigma * wi
            n[i] += g * g
        model.update(index, x, y)
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)
    assert model.weights(np.arange(33)) == pytest.approx([weight(i) for i in range(33)])


def test_quality_like_brute_force(spark):
    """Training on all rows outside the fold and scoring, with n-grams in dictionaries instead of a hashed space."""
    words = ["good", "Fine", "plain", "BAD", "worse", "x"]
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(120):
        y = i % 2
        mark = rng.choice([".", ";", ","]) if y else rng.choice(["!!", "?!", "##"])
        docs.append((i, " ".join(rng.choice(words[:4] if y else words[2:]) + rng.choice(["", mark]) for _ in range(rng.randint(3, 30)))))
        labels.append((i, y))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["row"].doc_id: r.score for r in Q.quality_scores(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def grams(text):
        tokens, marks = re.findall(r"[0-9A-Za-z]+", text), re.findall(r"[^0-9A-Za-z\s]+", text)
        low = [t.lower() for t in tokens]
        shape = [(0 if t == t.lower() else 2 if t == t.upper() else 1, j > 0 and low[j] == low[j - 1], min(len(t).bit_length() - 1, 6)) for j, t in enumerate(tokens)]
        count: dict = {}
        for kind, (stream, most) in enumerate(((low, 2), (marks, 2), (shape, 3))):
            for k in range(1, most + 1):
                for j in range(len(stream) - k + 1):
                    key = (kind, *stream[j : j + k])
                    count[key] = count.get(key, 0) + 1
        norm = max(1.0, math.sqrt(sum(v * v for v in count.values())))
        return {k: v / norm for k, v in count.items()} | {"constant": 0.5}

    x = {i: grams(t) for i, t in docs}
    z, n = {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= Q.L1 else (math.copysign(Q.L1, a) - a) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + Q.L2)

    scored = lambda row: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in row.items())))
    fit = [(x[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    for epoch in range(Q.EPOCHS):
        for j in np.random.RandomState(epoch).permutation(len(fit)):
            row, y = fit[j]
            p, w = scored(row), {k: weight(k) for k in row}
            for k, v in row.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / Q.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    assert len(got) == len(docs)
    assert max(abs(got[i] - scored(x[i])) for i, _ in docs) < 1e-4


def test_features_take_texts_in_slices(monkeypatch):
    draw = random.Random(12)
    texts = ["A long word-list " + " ".join(draw.choice(("Ab", "cd!", "éf", "...", "x1")) for _ in range(draw.randint(0, 400))) for _ in range(800)]
    texts[5:9] = [None, "", "y " * 3000, None]

    monkeypatch.setattr(Q, "SLICE", 1 << 17, raising=False)

    def peak(column):
        tracemalloc.start()
        found = sum(len(i) for i, _ in Q.features(column))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, most

    once, often = pa.array(texts), pa.array(texts * 6)
    (n, small), (m, large) = peak(once), peak(often)
    assert m == 6 * n and large < 1.5 * small
    whole = list(Q.features(once))
    monkeypatch.setattr(Q, "SLICE", 700)
    for (i, x), (j, y) in zip(whole, Q.features(once.slice(0)), strict=True):
        assert (i == j).all() and (x == y).all()
    assert list(Q.features(pa.array([], pa.string()))) == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = Q.op8_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.95
    assert (r.predicted[r.quality == 1] == 1).mean() > 0.98


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good words here", None, "", "!!! ### $$$", "good words here", "a " * 100_000])] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, 1), (4, 1), (99, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    rows = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).collect() == []


# ------------------------------------------------------------------------------- language
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = N.op10_language(spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97 and r.score.between(0, 1).all()


def test_kneser_ney_by_hand(spark):
    """Log probabilities against the recursive definition, and their sum over the alphabet."""
    text = "aba abba baab ab"
    counts = N.gram_counts(spark.createDataFrame([("x", text)], "lang string, text string"))
    model = N.sorted_arrays(N.kneser_ney(counts), ["x"])
    seq = [0, 0, 0, *N.codes(text, N._letters()).tolist()]
    tables = {4: {}}
    for i in range(4, len(seq)):
        g = tuple(seq[i - 3 : i + 1])
        tables[4][g] = tables[4].get(g, 0) + 1
    for n in (3, 2, 1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return N.UNSEEN
        t = tables[len(g)]
        ones, twos = (sum(c == k for c in t.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        total, kinds = sum(c for h, c in t.items() if h[:-1] == g[:-1]), sum(h[:-1] == g[:-1] for h in t)
        return max(t.get(g, 0) - d, 0) / total + d * kinds / total * p(g[1:]) if total else p(g[1:])

    key = lambda g: sum(c << 16 * (3 - i) for i, c in enumerate(g))
    asked = [*tables[4], (97, 98, 97, 120), (120, 120, 97, 98)]
    got = N.log_probabilities(np.array([key(g) for g in asked], np.uint64), model, 4)[:, 0]
    assert np.exp(got) == pytest.approx([p(g) for g in asked], rel=1e-4)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(1, "der die das und ist nicht", "de"), (2, "the and of with that", "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "die und nicht"), (2, "WITH THE"), (3, None), (4, "123 !?"), (5, ""), (None, "the")], "doc_id long, text string")
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in N.identify_languages(docs, train).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None)] == ["de", "en", "und", "und", "und", "en"]
    assert got[3][1] == 0.0
    assert {r.lang_pred for r in N.identify_languages(docs, train.limit(0)).collect()} == {"und"}
    parts = {r.row.doc_id: r.lang_pred for r in N.identify_languages(docs, train, model_rows=10).collect()}
    assert parts == {k: v[0] for k, v in got.items()}


def test_language_pieces_and_rejection_of_unseen_texts(spark):
    """Scores do not depend on the pieces; texts like the training's are kept, other ones rejected, whether or not learned from."""
    rng = random.Random(3)
    words = {"aa": ["tara", "mili", "sono", "reda", "kilo", "nuta"], "bb": ["xwq", "zrk", "wxz", "qqr", "kzw", "rrz"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    train = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(["aa", "bb"] * 60)] + [(900 + i, "ooo uuu " * 5, "few") for i in range(3)], "doc_id long, text string, lang string")
    fresh = [(i, text(("aa", "bb")[i % 2])) for i in range(40)] + [(100, "tjfd vbpc hgys " * 9), (101, "ooo uuu ooo"), (102, None)]
    docs = spark.createDataFrame(fresh, "doc_id long, text string")
    whole = {r.row.doc_id: r for r in N.identify_languages(docs, train).collect()}
    assert all(whole[i].lang_pred == ("aa", "bb")[i % 2] for i in range(40))
    assert sum(whole[i].rejected for i in range(40)) <= 2
    assert whole[100].rejected and whole[102].rejected and whole[101].lang_pred == "few"
    cut = {r.row.doc_id: r for r in N.identify_languages(docs, train, model_rows=300).collect()}
    for k, r in whole.items():
        assert (cut[k].lang_pred, cut[k].rejected) == (r.lang_pred, r.rejected)
        assert cut[k].score == pytest.approx(r.score) and (cut[k].entropy is None) == (r.entropy is None)
        assert r.entropy is None or cut[k].entropy == pytest.approx(r.entropy)


def test_characters_dealt_to_pieces():
    weights = {i: (i * 37) % 100 + 1 for i in range(500)} | {999: 5000}
    pieces = N.dealt(weights, 400)
    assert sorted(x for p in pieces for x in p) == sorted(weights) and [999] in pieces
    assert all(sum(weights[x] for x in p) <= 400 for p in pieces if p != [999])


# ------------------------------------------------------------------------------- licenses
def test_licenses(spark):
    rng = random.Random(6)
    noise = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(12))
    texts = [f"{noise()}\n{t}\n{noise()}" for _, t in TEMPLATES]
    texts += [f"{noise()}\nthis line has no permission and no license at all to speak of", noise(), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan_licenses(docs).collect()
    sure = {r.doc_id: r["license"] for r in rows if r.confirmed}
    assert sure == {i: name for i, (name, _) in enumerate(TEMPLATES)}
    assert all(r.given_bytes < r.plain_bytes and r.missing == r.added == 0 for r in rows if r.confirmed)
    assert scan_licenses(docs.limit(0)).collect() == []


def test_every_license_of_a_block(spark):
    """All notices one after the other, and pairs within GAP lines."""
    names = sorted({n for n, _ in TEMPLATES})
    longest = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n in names}
    texts = ["\n".join(longest.values()), f"{longest['MIT']}\n\n{longest['CC-BY-4.0']}", "Released under the MIT License.\nLicensed under CC BY-SA 4.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan_licenses(docs).collect()
    got = [sorted(r["license"] for r in rows if r.doc_id == i and r.confirmed) for i in range(3)]
    assert got == [names, ["CC-BY-4.0", "MIT"], ["CC-BY-SA-4.0", "MIT"]]


# ------------------------------------------------------------------------------- WARC
def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = serialised(derivatives(responses(pages)))
    names = ["warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "block"]
    same = made.select(*names, parsed(F.col("warc")).alias("p"))
    wrong = same.where(" OR ".join(f"NOT (p.{c} <=> {c})" for c in names))
    assert made.count() == 2 * pages.count() and wrong.count() == 0


def test_plain_text(spark):
    cases = {
        "<p>a<b>b</b> &amp; c</p><script>x<p></script><!-- no --><div>d&#233;&#x41;&#0;</div>": "ab & c\ndéA&#0;",
        "caf&eacute; &Alpha;&alpha; &amp;eacute; &nosuch; &apos; a&nbsp;b &#38;lt; &": "café Αα &eacute; &nosuch; ' a b &lt; &",
        "&#xD800; &#1114112; &#x10FFFF; & &; &amp": "&#xD800; &#1114112; \U0010ffff & &; &amp",
        "": "", "no tags  at\n all": "no tags at all", "&lt;p&gt;": "<p>",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "html string").select("html", plain_text(F.col("html")).alias("t")).collect()
    assert {r.html: r.t for r in rows} == cases
    none = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    got = derivatives(responses(none)).collect()
    assert [(r.warc_type, r.content_length) for r in got] == [("metadata", 74), ("conversion", 0)]


def test_outlinks_and_titles(spark):
    html = """<title>A &amp; B&eacute;</title><a href="/x?a=1&amp;b=2">1</a><a class=c HREF = '/it"s'>2</a><a href=/bare>3</a>
    <a data-href="/no" id="i">4</a><a\nhref="/two
    lines">5</a><abbr href="/no">6</abbr><a href="">7</a>"""
    rows = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    block = derivatives(responses(rows)).where("warc_type = 'metadata'").first().block
    lines = block.split("\r\n")
    assert lines[0] == "title: A & Bé"
    assert [x[9:] for x in lines if x.startswith("outlink: ")] == ["/x?a=1&b=2", '/it"s', "/bare", "/two lines", ""]


def test_derivatives_of_clashing_columns_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "<p>x", "mine", "own", 3, "b", "t")], "page_id long, url string, html string, content_type string, Refers_To string, content_type_ int, body string, text string")
    records = responses(rows).crossJoin(rows.select("content_type", "Refers_To", "content_type_", "body", "text"))
    made = derivatives(records)
    made.write.parquet(f"{tmp_path}/made")  # no two columns of one name
    got = spark.read.parquet(f"{tmp_path}/made").where("warc_type = 'conversion'").first()
    assert (got.content_type, got.content_type__, got.content_type_, got.Refers_To_, got.body, got.text, got.block) == ("text/plain; charset=utf-8", "mine", 3, "own", "b", "t", "x")
    assert derivatives(records.limit(0)).collect() == []


# ------------------------------------------------------------------------------- tokens
def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}"
    T.write_token_files(docs, path).collect()  # an attempt whose rows are lost
    kept = spark.createDataFrame(T.write_token_files(docs, path).collect())
    assert len(list(tmp_path.glob("*.tok"))) == 2
    got = kept.join(T.count_tokens(spark, path, files=kept), ["file", "place"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 2), (2, 0), (3, 0)]
    assert T.count_tokens(spark, path).count() == 6
    assert T.count_tokens(spark, path, files=kept.limit(0)).collect() == []
    with pytest.raises(Exception, match="every executor"):
        T.write_token_files(docs, path, "/no/such/vocabulary").collect()


def test_separator_scan(spark, tmp_path):
    rng = np.random.RandomState(1)
    expected = {}
    for name, tokens in {"a": [7, 9, 9, 3, 9], "b": [1, 2], "c": [9], "d": [], "e": rng.randint(0, 12, 1000).tolist()}.items():
        np.array(tokens, "<u2").tofile(tmp_path / f"{name}.tok")
        start, docs = 0, []
        for i, t in enumerate(tokens):
            if t == 9:
                docs.append((start, i - start))
                start = i + 1
        if start < len(tokens):
            docs.append((start, len(tokens) - start))
        expected[f"{name}.tok"] = docs
    for block, group in ((1, 2), (3, 4), (64, 4096), (5000, 4096)):
        found = T.stitched(T.separator_positions(T.token_blocks(spark, f"file://{tmp_path}", block), 9), group).collect()
        got = {k: [(r.start, r.n_tokens) for r in sorted(found, key=lambda r: r.place) if r.file == k] for k in expected}
        assert got == expected
        assert all(sorted(r.place for r in found if r.file == k) == list(range(len(v))) for k, v in expected.items())


def test_token_counts(spark, sf):
    import base64

    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in T.op1_token_counts(spark, sf).collect()} == {k: len(encoding.encode_ordinary(t)) for k, t in docs.items()}
