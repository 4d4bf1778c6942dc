"""Language identification by language-bitmask n-gram filters (operator 1).

Each learned language owns one bit.  Its characteristic letter n-grams (those it
uses at least ``SHARE`` times as often as the language that uses them most) go
into a Bloom filter, and the filters of all languages are stored bit-sliced: a
slot holds masks with a bit per language (``BITS`` languages a mask, as many masks as it
takes), so the AND of an n-gram's ``HASHES`` slots gives all languages that contain it at once.  A text's popcounts per
language are corrected for the false positives expected from each filter's fill,
``(hits - n * fpr) / (1 - fpr)``, and the largest corrected count decides; the
score is its share of the sum of all corrected counts.

Fitting reads a sample of about ``SAMPLE`` different labelled texts a language (a
documented bound), taken by a hash of the text; a text that occurs many times counts
once.  n-grams are counted in batches, summed by one shuffle, and reach the driver as at
most ``SLOTS`` masks for every ``BITS`` languages.

Cases: null texts and texts without a letter are ``und`` with score 0; with no
learned language everything is ``und``; if no filter knows any n-gram of a text,
the language with the most training texts is taken with score 0; ties go to the
first language by name; whole texts count, however long; rows repeat as given; an
empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm.common import chunks, code_points, crc_mod, materialise

SIZES = (3, 4)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASHES = 2
SAMPLE = 2000
SHARE = 0.5
MIN_COUNT = 3
BITS = 63  # languages of a mask
CHUNK_CHARS = 1_000_000
UNKNOWN = "und"
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, text after text, and the bounds of each text (one more than texts).

    Texts are lower-cased; anything but letters becomes a blank, which an n-gram
    may hold only as its first or last character.
    """
    low = [t.lower() for t in texts]
    cp = code_points(" " + " ".join(low) + " ")
    a = np.where(_is_letter()[cp], cp, 0).astype(np.uint64)
    cut = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])  # text i: middles from cut[i] + 1
    out, at = [], []
    for n in SIZES:
        m = len(a) - n + 1
        if m <= 0:
            continue
        ok = a[1:m + 1] != 0
        for j in range(2, n - 1):
            ok &= a[j:m + j] != 0
        w = np.nonzero(ok)[0]
        h = np.full(len(w), np.uint64(n))
        for j in range(n):
            h = (h ^ a[w + j]) * _MUL[j % 4]
            h ^= h >> np.uint64(32)
        out.append(h)
        at.append(np.searchsorted(w, cut))
    if len(out) == 1:
        return out[0], at[0]
    k = len(texts)
    sizes = [np.diff(x) for x in at]
    ends = np.concatenate([[0], np.cumsum(sum(sizes))])
    both = np.empty(ends[-1], np.uint64)
    off = ends[:-1].copy()
    for h, x, s in zip(out, at, sizes):
        both[np.repeat(off - x[:-1], s) + np.arange(x[0], x[-1])] = h[x[0]:x[-1]]
        off += s
    return both, ends[:k + 1]


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    s = np.uint64(64 - SLOT_BITS)
    return [(h * _MUL[i]) >> s for i in range(HASHES)]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    common: int  # index of the language with the most training texts
    masks: np.ndarray  # masks by slot, a row for every ``BITS`` languages

    def rates(self) -> np.ndarray:
        """False-positive rate of each language's filter."""
        return np.array([float(np.mean(self.masks[i // BITS] >> i % BITS & 1)) ** HASHES for i in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        rates = self.rates()
        for _, part in chunks([t or "" for t in texts], CHUNK_CHARS):
            h, ends = grams(part)
            p = slots_of(h)
            mask = self.masks[:, p[0]]
            for q in p[1:]:
                mask = mask & self.masks[:, q]
            n = np.diff(ends)
            hits = np.empty((len(part), len(self.languages)))
            for i in range(len(self.languages)):
                upto = np.concatenate([[0], np.cumsum(mask[i // BITS] >> i % BITS & 1, dtype=np.int64)])
                hits[:, i] = upto[ends[1:]] - upto[ends[:-1]]
            c = np.maximum(0.0, (hits - n[:, None] * rates) / (1 - np.minimum(rates, 0.999)))
            total = c.sum(1)
            best = np.where(total > 0, c.argmax(1), self.common)
            top = c.max(1)
            for k in range(len(part)):
                known = n[k] > 0
                names.append(self.languages[best[k]] if known else UNKNOWN)
                scores.append(top[k] / total[k] if known and total[k] > 0 else 0.0)
        return names, np.array(scores)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def sample_limit(found: list, sample: int) -> float:
    """Hashes at or above this are in no language's sample."""
    return max(min(1.0, sample / max(r["texts"], 1)) for r in found) * 1_000_003


def fit(train: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of the rows' ``text`` and ``lang``; None if there is no language to learn."""
    train = train.select("lang", "text", F.xxhash64("text").alias("h"))
    found = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).collect()  # a row a language
    sizes = {r["lang"]: r["n"] for r in found}
    languages = tuple(sorted(sizes))
    if not languages:
        return None
    rates = train.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / max(r["texts"], 1))) for r in found], "lang string, share double")
    picked = train.where(F.pmod("h", F.lit(1_000_003)) < sample_limit(found, sample)).join(F.broadcast(rates), "lang") \
        .where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003).dropDuplicates(["lang", "h"]).select("lang", "text")
    place_of = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for _, part in chunks(texts, CHUNK_CHARS):
                    g, n = np.unique(grams(part)[0].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), place_of[lang], np.int32)), pa.array(g),
                         pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = materialise(picked.mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    few = counts.sparkSession.createDataFrame([(place_of[r["lang"]], min(MIN_COUNT, r["texts"])) for r in found], "lang int, least long")
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")).join(few, "lang"))  # a row a language
    rate = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"))
    own = rate.where(F.col("n") >= F.col("least")).join(most, "gram").where(F.col("rate") >= SHARE * F.col("most")) \
        .select("gram", F.expr(f"lang div {BITS}").cast("int").alias("word"), F.expr(f"shiftleft(1L, lang % {BITS})").alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for s in slots_of(h):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), b.column(1), b.column(2)], names=["slot", "word", "mask"])

    rows = own.groupBy("gram", "word").agg(F.bit_or("mask").alias("mask")).mapInArrow(place, "slot int, word int, mask bigint") \
        .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).collect()  # at most SLOTS rows for every BITS languages
    masks = np.zeros((-(-len(languages) // BITS), SLOTS), np.int64)
    for r in rows:
        masks[r[1], r[0]] = r[2]
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return Model(languages, place_of[max(sizes, key=lambda x: (sizes[x], x))], masks)


def predict(spark: SparkSession, model: Model | None, text: str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score``; the model (bounded by ``SLOTS``) is broadcast."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            names, scores = sent.value.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "struct<lang_pred string, score double>")(text)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learned from the rows that aren't held out."""
    model = fit(train_rows(docs))
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
                       predict(docs.sparkSession, model).alias("p")).select("doc_id", "held_out", "p.*")
