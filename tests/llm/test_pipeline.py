"""The pipeline, stage by stage, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quoin.llm.mixing import mixing_plan
from tests.llm.test_pairs import brute_components, brute_lines, shingles
from tests.llm.test_texts import brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    kept.append(docs.toPandas().sort_values("doc_id"))
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
        kept.append(docs.toPandas().sort_values("doc_id"))
    return kept


def test_columns(stages):
    assert all(list(s.columns) == C.COLUMNS for s in stages[:5]) and list(stages[5].columns) == [*C.COLUMNS, "copy"]
    assert all(s.doc_id.is_unique for s in stages[:5])


def test_quality_keeps_the_good(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    good = [d for d in labels.index if labels[d] == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d in labels.index if labels[d] == 0) <= 0.5 * (labels == 0).sum()


def test_lines(stages):
    before, after = stages[1], stages[2].set_index("doc_id").text
    expected = brute_lines(before.text.tolist())
    same = sum(after.get(d) == t for d, t in zip(before.doc_id, expected) if d in after.index)
    assert same >= 0.98 * len(after)
    untouched = [d for d, t, u in zip(before.doc_id, before.text, expected) if t == u]
    assert all(d in after.index for d in untouched)


def test_near_duplicates(stages):
    before = stages[2]
    groups = brute_components([shingles(t) for t in before.text])
    assert set(stages[3].doc_id) == {d for i, d in enumerate(before.doc_id) if groups[i] == i}


def test_near_duplicates_without_or_with_repeated_ids(spark, sf):
    words = lambda seed, n=60: " ".join(f"w{(seed * 7919 + i * i) % 997}" for i in range(n))
    rows = [(None, words(1)), (None, words(1) + " end"), (5, words(2)), (5, words(3)), (5, words(3)), (9, words(3)), (None, words(4)), (3, words(4)), (None, words(5)), (None, None), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, sf).collect()), key=repr)
    either = [(None, words(1)) in got, (None, words(1) + " end") in got]
    assert sum(either) == 1
    got = [g for g in got if g[1] not in (words(1), words(1) + " end")]
    assert got == sorted([(5, words(2)), (5, words(3)), (3, words(4)), (None, words(5)), (None, None), (4, None)], key=repr)
    assert C.near_duplicates(spark, docs.union(docs), sf).count() == 7


def test_decontamination(spark, sf, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keep = set()
    for d, t in zip(stages[3].doc_id, stages[3].text):
        if not any(t.lower().find(x[1][10:40].lower()) >= 0 for x in items):
            keep.add(d)
            continue
        n, hit, _ = brute_hits(t, items)
        if not (hit and 20 * hit >= n):
            keep.add(d)
    assert set(stages[4].doc_id) <= keep
    assert len(stages[4]) >= 0.97 * len(keep)


def plan_of(spark, docs):
    return {r.doc_id: (r["size"], r.source, r.target, r.copies) for r in mixing_plan(docs).collect()}


def test_mixing(spark, stages):
    """The stage emits each document as often as the mix takes it; those taken 0 times are absent."""
    plan = plan_of(spark, spark.createDataFrame(stages[4]))
    copies = stages[5].groupby("doc_id").copy.apply(sorted).to_dict()
    assert set(plan) == set(stages[4].doc_id)
    assert {d: list(range(1, x[3] + 1)) for d, x in plan.items() if x[3]} == copies
    assert all(x[3] <= 2 for x in plan.values())
    assert sum({x[1]: x[2] for x in plan.values()}.values()) == pytest.approx(1.5 * sum(x[0] for x in plan.values()))


def test_edge_rows(spark, sf):
    rows = [(1, None, None, None, None), (None, "some text that is long enough to count here", "en", "s", 10), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[1:]:
        out = stage(spark, docs, sf)
        assert out.count() >= (3 if name != "mixing" else 1), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert C.STAGES[0][1](spark, docs.withColumn("extra", F.lit(1)), sf).columns == C.COLUMNS


def test_run_emits_the_mix(spark, sf, monkeypatch):
    """Each document as often as planned, with its text; those planned 0 times are absent."""
    monkeypatch.setattr(C, "STAGES", C.STAGES[-1:])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {d: x[3] for d, x in plan_of(spark, docs).items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = C.run(spark, sf)
    assert out.columns == [*C.COLUMNS, "copy"]
    copies = {}
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        copies.setdefault(r.doc_id, []).append(r["copy"])
    known = {d: n for d, n in plan.items() if n is not None}
    assert 0 in known.values() and 2 in known.values()
    assert {d: sorted(copies.get(d, [])) for d in known} == {d: list(range(1, n + 1)) for d, n in known.items()}


def test_short_lines_of_its_own_keep_a_document(spark, sf):
    line = "this line of boilerplate stands in every one of them"
    texts = [line, f"{line}\nroses are red", f"{line}\nroses are red", f"{line}\n \n", f"roses are red\n{line}\nviolets blue"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.lines(spark, docs, sf).collect()}
    assert got == {0: (line, len(line)), 1: ("roses are red", 13), 4: ("roses are red\nviolets blue", 26)}
