"""License notices as they stand in files: wrapped, marked, repeated, altered; against brute force."""

import random
import textwrap
import time

import pytest

from quoin.llm import licenses as L

DOCS = "doc_id long, text string"


def confirmed(spark, texts, templates=L.TEMPLATES):
    rows = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), DOCS), templates).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.first_line)):
        if r.confirmed:
            out[r.doc_id].append(r)
    return out


@pytest.mark.parametrize("width", [60, 72, 80])
def test_wrapped_and_marked(spark, width):
    texts, names = [], []
    for mark in ("", "# ", "// ", " * "):
        for name, notice in L.TEMPLATES:
            body = [mark + line for line in textwrap.wrap(notice, width)]
            texts.append("\n".join(["int x = 1;", *body, "int main() { return 0; }"]))
            names.append((name, len(body)))
    for got, (name, lines), text in zip(confirmed(spark, texts), names, texts):
        assert [r["license"] for r in got] == [name]
        assert (got[0].first_line, got[0].last_line, got[0].missing, got[0].added) == (1, lines, 0, 0)
        assert got[0].block in text and L.words(got[0].block) == L.words(text)[3:-4]


def brute(text):
    """Licenses whose wording stands somewhere in a text, all windows of all templates compared."""
    own, out = L.words(text), set()
    for name, notice in L.TEMPLATES:
        template = L.words(notice)
        slack = int(L.DIFFER * len(template))
        for s in range(max(1, len(own) - len(template) + slack + 1)):
            missing, added = L.wording(own[s : s + len(template) + slack], template)
            if max(missing, added) <= L.DIFFER * len(template):
                out.add(name)
    return out


def test_altered_notices_equal_brute_force(spark):
    draw = random.Random(7)
    noise = lambda n: [draw.choice(["license", "terms", "file", "you", "may"]) for _ in range(n)]
    texts = []
    for name, notice in [t for t in L.TEMPLATES if len(t[1]) > 150]:
        for share in (0.03, 0.08, 0.3):
            words = notice.split()
            for _ in range(int(share * len(words))):
                p = draw.randrange(3, len(words) - 3)
                words[p : p + draw.randint(0, 1)] = draw.choice([[], ["really"]])
            texts.append("\n".join(textwrap.wrap(" ".join(noise(30) + words + noise(30)), 70)))
    got = [{r["license"] for r in rows} for rows in confirmed(spark, texts)]
    for found, text in zip(got, texts):
        assert found <= brute(text)
    # of versions that differ in a few words the closest one stands
    names = [n for n, t in L.TEMPLATES if len(t) > 150]
    assert all(found == {names[i // 3]} for i, found in enumerate(got) if i % 3 < 2)


def test_a_notice_at_the_border_of_blocks(spark):
    mit = L.TEMPLATES[4][1]
    for before in (L.BLOCK - 40, L.BLOCK - 1, L.BLOCK, 2 * L.BLOCK - 3):
        text = "license\n" * before + mit + "\nlicense" * 50
        assert [[r["license"] for r in rows] for rows in confirmed(spark, [text])] == [["MIT"]]


def test_long_texts_take_time_by_length(spark):
    """Ten megabytes of cues and notices, on one line and on many."""
    began = time.time()
    notice = "This project is licensed under the MIT License."
    many = confirmed(spark, [(notice + "\n") * 100_000, (notice + " ") * 100_000])
    assert all({r["license"] for r in rows} == {"MIT"} for rows in many) and time.time() - began < 120


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("Own", "all rights of this license are reserved by nobody at all"), ("None", None), ("Blank", "")], "license string, text string")
    texts = ["x\nAll rights of this License\n are reserved by nobody at all.", "license", L.TEMPLATES[4][1], "", None]
    assert [[r["license"] for r in rows] for rows in confirmed(spark, texts, table)] == [["Own"], [], [], [], []]
    with pytest.raises(ValueError):
        L.templates_of(table, 1)
