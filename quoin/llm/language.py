"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import discard, read, saved
from quoin.llm.quality import fold

#: Characters of the longest n-gram. A character takes 16 bits of a 64-bit key.
ORDER = 4
#: Values (n-grams times languages) in one broadcast piece of the models; each piece is a pass of its own.
MODEL_ROWS = 48_000_000
#: Languages with so many training texts keep one in HELD_BACK of them for calibrating rejection; how far in the tail a text must be.
HELD_BACK_FROM, HELD_BACK, TAIL = 20, 10, 4.0
#: Probability of a character that no text of the language has.
UNSEEN = 1e-6


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case letters as 16-bit codes; each run of other characters is one 1, also at both ends.

    Code points beyond 16 bits fall on one of 65536 codes by their remainder. Empty without letters.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(is_letter, np.maximum(c & 0xFFFF, 2), 1)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c = c[keep]
    return np.concatenate([[1] if c[0] != 1 else [], c, [1] if c[-1] != 1 else []]).astype(np.uint64)


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each character but the first; before the text stand zeros."""
    key = c.copy()
    for back in range(1, order):
        key[back:] |= c[:-back] << np.uint64(16 * back)
    return key[1:]


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n)`` over all texts of ``docs(lang, text)``; counted in each batch before the shuffle."""

    def run(batches):
        letters = _letters()
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [grams(codes(t, letters), order) for t, x in zip(texts, langs) if x == lang]
                ids, keys = pd.factorize(np.concatenate(own).view(np.int64))
                n = np.bincount(ids, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string"))
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, size, gram, logp, logback)``: interpolated log probability of the last character of each
    n-gram of 1 to ``order`` characters, and the weight its (size)-character context leaves to the next
    shorter one (``logback``, null where nothing continues it).

    The longest n-grams have their counts, shorter ones the number of different characters before
    them; each size has one absolute discount, n1 / (n1 + 2 n2).
    """
    lower = lambda size: (1 << 16 * size) - 1
    levels = {order: counts.withColumnRenamed("n", "c")}
    for size in range(order - 1, 0, -1):
        levels[size] = saved(levels[size + 1].groupBy("lang", F.col("gram").bitwiseAND(lower(size)).alias("gram")).agg(F.count("*").alias("c")))
    out, shorter = None, None
    for size in range(1, order + 1):
        level = levels[size]
        ones = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        ones = ones.select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("discount"))
        level = level.join(ones, "lang").withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.first("discount").alias("d"))
        contexts = saved(contexts.select("lang", "context", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")))
        level = level.join(contexts, ["lang", "context"])
        if shorter is None:
            p = F.greatest(F.col("c") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * UNSEEN
        else:
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(lower(size - 1))).join(shorter, ["lang", "suffix"])
            p = F.greatest(F.col("c") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("q")
        level = saved(level.select("lang", "gram", p.alias("p")))
        shorter = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        rows = level.select("lang", F.lit(size).alias("size"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logback"))
        backs = contexts.select("lang", F.lit(size).alias("size"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("back").alias("logback"))
        out = rows.union(backs) if out is None else out.union(rows).union(backs)
    return out


def with_pivot(model: DataFrame) -> DataFrame:
    """Adds the character before the last one of an n-gram, and the last one of a context: all that the score
    of one character asks for has the same. Null where there is none; such rows belong to every piece."""
    char = lambda c: c.bitwiseAND(0xFFFF).cast("int")
    own = F.when(F.col("logback").isNull(), char(F.shiftrightunsigned("gram", 16))).otherwise(char(F.col("gram")))
    return model.withColumn("pivot", F.when(F.col("size") > 1, own))


def dealt(weights: dict[int, int], bound: int) -> list[list[int]]:
    """Characters dealt to pieces of about ``bound`` values, the heaviest first; one that is heavier has a piece of its own."""
    pieces: list[list[int]] = []
    room = 0
    for pivot, n in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if not pieces or room + n > bound:
            pieces.append([])
            room = 0
        pieces[-1].append(pivot)
        room += n
    return pieces


def sorted_arrays(model: DataFrame, langs: list[str], order: int = ORDER) -> dict:
    """Models as arrays: for each size, keys in increasing order and a column a language."""
    pdf = model.toArrow().to_pandas()
    of = {x: i for i, x in enumerate(langs)}
    out: dict = {"langs": langs, "p": {}, "back": {}}
    for size in range(1, order + 1):
        own = pdf[pdf["size"] == size]
        for name, column in (("p", "logp"), ("back", "logback")):
            some = own[own[column].notna()]
            keys = some["gram"].to_numpy(np.int64).view(np.uint64)
            unique, at = np.unique(keys, return_inverse=True)
            table = np.full((len(unique) + 1, len(langs)), np.nan, np.float32)  # the last row: not there
            table[at, some["lang"].map(of).to_numpy()] = some[column]
            out[name][size] = (unique, table)
    return out


def _row(keys: np.ndarray, part: tuple) -> np.ndarray:
    unique, table = part
    at = np.searchsorted(unique, keys)
    found = (unique[np.minimum(at, len(unique) - 1)] == keys) if len(unique) else np.zeros(len(keys), bool)
    return table[np.where(found, at, len(unique))]


def log_probabilities(keys: np.ndarray, model: dict, order: int) -> np.ndarray:
    """For each n-gram and language, the interpolated log probability of the last character."""
    total = np.full((len(keys), len(model["langs"])), np.log(UNSEEN), np.float32)
    for size in range(1, order + 1):
        own = keys & np.uint64((1 << 16 * size) - 1) if size < 4 else keys
        back = np.nan_to_num(_row(own >> np.uint64(16), model["back"][size]), nan=0.0)
        p = _row(own, model["p"][size])
        total = np.where(np.isnan(p), total + back, p)
    return total


def _entropies(rows: DataFrame, model, order: int) -> DataFrame:
    """Adds to ``(row, text, n, h)`` what one piece of the models gives: each language's sum of minus log probabilities
    over the characters after the piece's. ``n`` counts all characters; h stays empty without letters."""

    def run(batches):
        letters = _letters()
        pivots = np.zeros(1 << 16, bool)
        pivots[model.value["pivots"]] = True
        for b in batches:
            before, texts, at = b.column("h").to_pylist(), b.column("text").to_pylist(), 0
            out, chars = [], []
            while at < len(texts):  # about a million characters at a time
                own, size = [], 0
                while at + len(own) < len(texts) and size < 1_000_000:
                    own.append(grams(codes(texts[at + len(own)] or "", letters), order))
                    size += len(own[-1])
                ids, keys = pd.factorize(np.concatenate(own).view(np.int64))
                keys = keys.view(np.uint64)
                here = pivots[((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
                table = np.zeros((len(keys), len(model.value["langs"])), np.float64)
                table[here] = log_probabilities(keys[here], model.value, order)
                ends = np.cumsum([len(x) for x in own])
                for i, x in enumerate(own):
                    mine = ids[ends[i] - len(x) : ends[i]]
                    if len(x):
                        total = -(np.bincount(mine, minlength=len(keys)) @ table) if len(x) > 4 * len(keys) else -table[mine].sum(0)
                        out.append((total + (before[at + i] or 0.0)).tolist())
                    else:
                        out.append([])
                    chars.append(len(x))
                at += len(own)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(chars, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["row", "text", "n", "h"])

    return rows.mapInArrow(run, rows.schema)


def identify_languages(docs: DataFrame, training: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS, tail: float = TAIL) -> DataFrame:
    """``(row, lang_pred, score, entropy, rejected)`` for each row of ``docs`` (as a struct), by models of
    ``training(doc_id, text, lang)``.

    The language with the least cross-entropy a character is chosen, the first by name among equals;
    ``und`` with score 0 for texts that are null or have no letter, and if nothing was learned. ``score`` is the share of the
    chosen language if each weighs as its likelihood over 25 characters. ``rejected`` marks texts whose
    cross-entropy is ``tail`` standard deviations or more above the mean of texts of their language that its
    model has not seen: one in HELD_BACK of the training texts, by hash. A language of fewer than
    HELD_BACK_FROM texts learns from all of them and is calibrated on them. Rows with null text or lang teach nothing.

    Models larger than ``model_rows`` values are cut by the character before the one that is scored. Each
    piece is a pass of its own over what the pass before it wrote, so a task and the driver hold one piece at a time.
    """
    spark = docs.sparkSession
    training = training.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    many = [r["lang"] for r in training.groupBy("lang").count().collect() if r["count"] >= HELD_BACK_FROM]  # a row a language
    held = F.col("lang").isin(many) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_BACK)) == 0)
    model = saved(with_pivot(kneser_ney(saved(gram_counts(training.where(~held), order)), order)))
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    weights = model.groupBy("pivot").agg(F.count_distinct("size", "gram").alias("n")).where("pivot IS NOT NULL").collect()  # a row a 16-bit code
    pieces = dealt({r["pivot"]: r["n"] * len(langs) for r in weights}, model_rows) or [[0]]

    def index(i: int):
        own = model.where(F.col("pivot").isNull() | F.col("pivot").isin(pieces[i])) if len(pieces) > 1 else model
        rest = np.setdiff1d(np.arange(1 << 16), [x for p in pieces[1:] for x in p])  # the first piece also scores what no text has
        return spark.sparkContext.broadcast(sorted_arrays(own, langs, order) | {"pivots": np.array(pieces[i]) if i else rest})

    rows = lambda frame: frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("h"))
    asked = rows(docs)
    own = rows(training.where(held | ~F.col("lang").isin(many)).select("lang", "text"))
    before: list[DataFrame] = []
    for i in range(len(pieces) if langs else 0):
        shared = index(i)
        asked, own = _entropies(asked, shared, order), _entropies(own, shared, order)
        if i < len(pieces) - 1:
            asked, own = saved(asked), saved(own)
            shared.unpersist()
            discard(*before)
            before = [asked, own]
    mean = F.transform("h", lambda x: x / F.col("n"))
    names = F.lit(langs) if langs else F.array().cast("array<string>")
    spread = own.where("n > 0").select("row.lang", F.get(mean, (F.array_position(names, F.col("row.lang")) - 1).cast("int")).alias("e")).groupBy("lang").agg(F.avg("e").alias("m"), F.coalesce(F.stddev_pop("e"), F.lit(0.0)).alias("s"))
    limit = {r["lang"]: r["m"] + tail * max(r["s"], 0.02) for r in spread.collect()} if langs else {}
    limits = F.array(*[F.lit(float(limit.get(x, 99.0))) for x in langs]) if langs else F.array().cast("array<double>")
    out = asked.select("row", mean.alias("h"))
    least = F.array_min("h")
    best = F.array_position("h", least).cast("int")
    known = F.size("h") > 0
    weight = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(25 * (F.array_min("h") - x)))
    return out.select(
        "row",
        F.when(known, F.get(names, best - 1)).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / weight).otherwise(0.0).alias("score"),
        F.when(known, least).alias("entropy"),
        F.when(known, least >= F.get(limits, best - 1)).otherwise(True).alias("rejected"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    out = identify_languages(docs.select("doc_id", "text"), docs.where(held == F.lit(False)))
    held = F.coalesce(fold(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
