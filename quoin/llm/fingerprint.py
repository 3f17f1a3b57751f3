"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
import re
from math import inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import mixed, read

#: Cells of a fingerprint (a multiple of HASHES), and cells of which each paragraph is in one a third.
CELLS, HASHES = 48, 3
#: Documents that a task has as Python objects at a time.
ROWS = 256
#: A paragraph ends at a newline or after the mark that ends a sentence.
PARAGRAPH = re.compile(r"\n+|(?<=[.!?])[ \t]+")

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, only_text array<long>, only_edited array<long>"


def _hashes(text: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in PARAGRAPH.split(text) if p]


def _digests(hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``(digests, owner)`` of several texts' paragraph hashes; the n-th copy within a text has a digest of its own."""
    owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, len(owner))
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
    return np.where(nth == 0, flat, mixed(flat + mixed(nth.astype(np.uint64)))), owner


def paragraph_digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs; the n-th copy of a paragraph has a digest of its own.

    A text that is empty, or only separators, has none.
    """
    return _digests([_hashes(text)])[0]


def _checks(digests: np.ndarray) -> np.ndarray:
    h = (digests ^ (digests >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFF)


class Sketches:
    """Counts, digest sums and check sums (by exclusive or) in cells, for several sets at once.

    Set i has ``cells[i]`` cells, one behind the other in three flat arrays; each digest is in one cell
    of each third. Sketches of the same sizes subtract.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.begin = np.concatenate([[0], np.cumsum(cells)])
        self.count = np.zeros(self.begin[-1], np.int64)
        self.keys, self.checks = np.zeros(self.begin[-1], np.uint64), np.zeros(self.begin[-1], np.uint64)

    def _places(self, digests: np.ndarray, owner: np.ndarray) -> np.ndarray:
        third = (self.cells[owner] // HASHES).astype(np.uint64)
        parts = [((digests * np.uint64(m)) >> np.uint64(24)) % third + np.uint64(i) * third for i, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))]
        return np.concatenate([p.astype(np.int64) + self.begin[owner] for p in parts])

    def add(self, digests: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> "Sketches":
        at = self._places(digests, owner)
        np.add.at(self.count, at, np.tile(np.broadcast_to(np.asarray(sign, np.int64), len(digests)), HASHES))
        np.bitwise_xor.at(self.keys, at, np.tile(digests, HASHES))
        np.bitwise_xor.at(self.checks, at, np.tile(_checks(digests), HASHES))
        return self

    def minus(self, other: "Sketches", rows: np.ndarray, others: np.ndarray) -> "Sketches":
        """The differences of the sets ``rows`` and the other's sets ``others``; all sets have CELLS cells."""
        out = Sketches(self.cells[rows])
        pick = lambda x, at: x.reshape(-1, CELLS)[at].ravel()
        out.count = pick(self.count, rows) - pick(other.count, others)
        out.keys = pick(self.keys, rows) ^ pick(other.keys, others)
        out.checks = pick(self.checks, rows) ^ pick(other.checks, others)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, digest, sign, failed)``: the digests that only the first (sign 1) or only the second (-1) of
        two subtracted sets has, and for each set whether its sketch was too small. A cell whose check
        sum fits its digest holds one digest: it is taken out of all its cells, which may leave others
        with one. The sketches are used up."""
        of = np.repeat(np.arange(len(self.cells)), self.cells)
        found, taken = [], np.zeros(len(self.cells), np.int64)
        pure = np.flatnonzero(np.abs(self.count) == 1)
        while True:
            pure = pure[(np.abs(self.count[pure]) == 1) & (taken[of[pure]] <= 4 * self.cells[of[pure]])]
            pure = pure[_checks(self.keys[pure]) == self.checks[pure]]
            if not len(pure):
                break
            order = np.lexsort((self.keys[pure], of[pure]))
            pure = pure[order]
            digest, owner = self.keys[pure], of[pure]
            first = np.ones(len(pure), bool)
            first[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
            digest, owner, sign = digest[first], owner[first], self.count[pure[first]]
            self.add(digest, owner, -sign)
            taken += np.bincount(owner, minlength=len(taken))
            found.append((owner, digest, sign))
            pure = np.unique(self._places(digest, owner))
        failed = np.bincount(of[(self.count != 0) | (self.keys != 0)], minlength=len(self.cells)) > 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return *(np.concatenate(x) for x in zip(none, *found)), failed

    def texts(self) -> list[str]:
        """Each sketch as base64: counts in 4 bytes, check sums in 4, digest sums in 8."""
        parts = self.count.astype("<i4"), self.checks.astype("<u4"), self.keys.astype("<u8")
        return [base64.b64encode(b"".join(x[a:b].tobytes() for x in parts)).decode() for a, b in zip(self.begin, self.begin[1:])]


def differences(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, minus: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, digest, sign)``: for each pair of sets the digests that only a (sign 1), and only b (-1), has,
    recovered from sketches alone; ``minus`` has the subtracted first sketches. After a failure a pair
    gets larger ones, at first of as many cells as wholly different texts need.

    ``of_a`` and ``of_b`` name each digest's pair, from 0.
    """
    sizes = np.bincount(of_a, minlength=len(minus.cells)) + np.bincount(of_b, minlength=len(minus.cells))
    pairs, cells = np.arange(len(sizes)), minus.cells
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while True:
        owner, digest, sign, failed = minus.peel()
        done = ~failed[owner]
        out.append((pairs[owner[done]], digest[done], sign[done]))
        pairs, cells = pairs[failed], cells[failed]
        if not len(pairs):
            return tuple(np.concatenate(x) for x in zip(*out))
        hopeless = cells > 64 * (sizes[pairs] + 1)  # only equal digests of different paragraphs come this far
        for p in pairs[hopeless].tolist():
            x, y = a[of_a == p], b[of_b == p]
            out += [(np.full(len(d), p), d, np.full(len(d), s)) for d, s in ((np.setdiff1d(x, y), 1), (np.setdiff1d(y, x), -1))]
        pairs, cells = pairs[~hopeless], cells[~hopeless]
        cells = np.maximum(2 * cells, HASHES * -(-11 * sizes[pairs] // 20))  # decodes if no paragraph is common
        place = np.full(len(sizes), -1)
        place[pairs] = np.arange(len(pairs))
        in_a, in_b = place[of_a] >= 0, place[of_b] >= 0
        minus = Sketches(cells).add(a[in_a], place[of_a[in_a]]).add(b[in_b], place[of_b[in_b]], -1)


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """The digests that only a, and only b, has: ``differences`` of one pair."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    _, digest, sign = differences(a, of_a, b, of_b, Sketches(np.array([cells])).add(a, of_a).add(b, of_b, -1))
    return digest[sign > 0].tolist(), digest[sign < 0].tolist()


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first characters of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(place, doc_id, text, border)``: all documents dealt to ranges of doc_id (``place``), each range with the
    first document of the next one behind it (``border``; behind the last, the first of all).

    The ranges' bounds are quantiles of doc_id, one number a partition; documents are shuffled once.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    least = F.coalesce("doc_id", F.lit(-(2**63))).cast("double")
    dealer = Bucketizer(splits=[-inf, *sorted({float(c) for c in cuts or [0]}), inf], inputCol="at", outputCol="place")
    placed = dealer.transform(docs.withColumn("at", least)).withColumn("place", F.col("place").cast("int")).drop("at")
    heads = sorted((r["place"], r["least"]) for r in placed.groupBy("place").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least")).collect())
    after = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]  # at most one row a partition
    after = spark.createDataFrame(after, "place int, least long")
    first = docs.join(F.broadcast(after), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least")).groupBy("place").agg(F.min("text").alias("text"))
    border = first.select("place", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("border"))
    rows = placed.select("place", "doc_id", "text", F.lit(False).alias("border")).unionByName(border)
    return rows.repartition(n, "place").sortWithinPartitions("place", "border", "doc_id", "text")


def _same_until(text: str) -> int:
    """A place before the last quarter where paragraphs end and another begins, whatever follows the quarter's start."""
    cut = len(text) - len(text) // 4
    line, sentence = text.rfind("\n", 0, cut) + 1, text.rfind(". ", 0, cut - 1)
    return sentence + 2 if line <= sentence < cut - 2 and text[sentence + 2] not in " \t" else line


def _compared(doc_ids: list, texts: list[str], asked: list[int]) -> pa.RecordBatch:
    """The fingerprints of the texts numbered ``asked``, whose next texts follow them."""
    new, heads, ends, new_ends = [], [], [], []
    for i, text in enumerate(texts):
        same = _same_until(text)
        heads.append(_hashes(text[:same]))
        ends.append(_hashes(text[same:]))
    for i in asked:
        new.append(edited(texts[i], texts[i + 1]))
        new_ends.append(_hashes(new[-1][_same_until(texts[i]) :]))
    own, of = _digests([x + y for x, y in zip(heads, ends)])
    changed, of_changed = _digests([heads[i] + y for i, y in zip(asked, new_ends)])
    sketch = Sketches(np.full(len(texts), CELLS)).add(own, of)
    other = Sketches(np.full(len(asked), CELLS)).add(changed, of_changed)
    rows, pair = np.array(asked, np.int64), np.arange(len(asked))
    # the pair of each digest of a text, and of a text that is a pair's next one
    first, second = np.full(len(texts), -1), np.full(len(texts) + 1, -1)
    first[rows], second[rows + 1] = pair, pair
    mine, following = first[of] >= 0, second[of] >= 0
    n = np.bincount(of, minlength=len(texts))[rows]

    def near(found: tuple[np.ndarray, ...]) -> np.ndarray:
        gone, come = (np.bincount(found[0][found[2] == s], minlength=len(asked)) for s in (1, -1))
        every = n + come
        return np.where(every > 0, (n - gone) / np.maximum(every, 1), 1.0)

    by_edit = differences(own[mine], first[of[mine]], changed, of_changed, sketch.minus(other, rows, pair))
    by_next = differences(own[mine], first[of[mine]], own[following], second[of[following]], sketch.minus(sketch, rows, rows + 1))

    def only(s: int) -> pa.ListArray:
        at = np.flatnonzero(by_edit[2] == s)
        at = at[np.lexsort((by_edit[1][at], by_edit[0][at]))]
        sizes = np.bincount(by_edit[0][at], minlength=len(asked))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(by_edit[1][at].view(np.int64)))

    prints = sketch.texts()
    columns = {
        "doc_id": pa.array([doc_ids[i] for i in asked], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for i in asked], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new], pa.string()),
        "fingerprint": pa.array([prints[i] for i in asked], pa.string()),
        "edited_fingerprint": pa.array(other.texts(), pa.string()),
        "near_edited": pa.array(near(by_edit), pa.float64()),
        "near_next": pa.array(near(by_next), pa.float64()),
        "only_text": only(1),
        "only_edited": only(-1),
    }
    return pa.RecordBatch.from_pydict(columns)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_text, only_edited)``.

    Null text is as empty. Documents follow each other by doc_id (null first) and, where rows repeat a
    doc_id, by text; the first follows the last, a single document itself. ``only_text`` and
    ``only_edited`` are the digests of the paragraphs in which a text and its edited text differ. A
    task holds an Arrow batch, and a few hundred documents of it as objects and sketches, at a time.
    """

    def run(batches):
        place, doc_id, text, border = [], [], [], []
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            # the last row of the slice before waits for its next one
            for have, c in zip((place, doc_id, text, border), ("place", "doc_id", "text", "border")):
                have[:] = have[-1:] + b.column(c).to_pylist()
            yield _compared(doc_id, text, [i for i in range(len(text) - 1) if place[i] == place[i + 1] and not border[i]])

    return in_order(docs).mapInArrow(run, _SCHEMA)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents")).drop("only_text", "only_edited")
