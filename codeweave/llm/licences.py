"""Licence scans (operator 9), with DataFrame functions only.

``TEMPLATES`` are short licence notices, each with a label and a mandatory key
phrase; ``PHRASES`` are key phrases that label on their own (the base).  Words
of them that aren't stop words make up the licence vocabulary.

1. One scan of the documents keeps, of each, the positions of vocabulary words
   that have another vocabulary word within ``NEAR`` words, with the words around
   them (every phrase and notice holds two such words that near, which is checked).
2. Document frequencies of the vocabulary over *all* documents give the IDF.
3. A posting is a rare word of a phrase or notice with its offset there: the
   rarest word of every phrase, the ``POSTINGS`` rarest of every notice.  A
   document looks its words up; position minus offset is where the notice would
   start.  A phrase must then stand there word by word.  A notice needs two of its
   postings to agree on one start, its key phrase in its place, and at least
   ``MIN_SHARE`` of its words by IDF.
4. The score is the largest share found (1 for a phrase that stands whole).

The postings are a bounded table (they come from the fixed lists) and are
broadcast.  Texts are never shuffled.

Cases: null and wordless texts have zero words, no place, null first and last
word, empty labels and score 0; repeated rows each get a result; an empty table
gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import ascii_words, materialise

#: (phrase, label): fixed by contract.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: (label, notice, mandatory key phrase).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl-2", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
)
STOP = frozenset("the a of to is in and or with this are any use into by under on for it be 0 1 2 3 4 v".split())
NEAR = 6
LONGEST = 16
POSTINGS = 3
MIN_SHARE = 0.6


def vocabulary(phrases=PHRASES, templates=TEMPLATES) -> list[str]:
    """Words to look for; raises ``ValueError`` if a phrase or notice could be missed."""
    texts = [p for p, _ in phrases] + [t for _, t, _ in templates]
    words = {w for t in texts for w in t.split() if w not in STOP}
    for t in texts:
        at = [i for i, w in enumerate(t.split()) if w in words]
        if len(t.split()) > LONGEST or any(min((abs(i - j) for j in at if j != i), default=NEAR + 1) > NEAR for i in at):
            raise ValueError(f"phrase too long or without two words of its own within {NEAR}: {t}")
    return sorted(words)


def occurrences(docs: DataFrame, vocab: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, n_words, present, hits)``: one scan; a hit is ``(pos, word, ctx)``."""
    names = ", ".join(f"'{w}'" for w in vocab)
    d = docs.select(F.col(doc_id).alias("doc_id"), ascii_words(F.col(text)).alias("words"))
    d = d.select("doc_id", "words", F.expr(
        f"filter(if(size(words) > 0, sequence(0, size(words) - 1), array()), i -> words[i] in ({names}))").alias("at"))
    return d.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").alias("n_words"),
        F.expr("array_distinct(transform(at, i -> words[i]))").alias("present"),
        F.expr(f"transform(filter(at, (p, i) -> (i > 0 and p - get(at, i - 1) <= {NEAR}) or "
               f"(i + 1 < size(at) and get(at, i + 1) - p <= {NEAR})), p -> struct(p as pos, words[p] as word, "
               f"slice(words, greatest(p - {LONGEST - 1}, 0) + 1, {2 * LONGEST - 1}) as ctx))").alias("hits"))


def idf(occ: DataFrame, vocab: list[str]) -> dict[str, float]:
    """Inverse document frequency of each vocabulary word over all documents."""
    n = occ.count()
    df = {r[0]: r[1] for r in occ.select(F.explode_outer("present").alias("w")).where("w is not null")
          .groupBy("w").count().collect()}  # at most one row a vocabulary word
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocab}


def postings(spark, weights: dict[str, float], phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``(word, off, entry, base, label, tpl, key, key_at, ws)``: the positional rare-token index."""
    rows = []
    for k, (label, text, key, base) in enumerate([(b, p, p, True) for p, b in phrases] + [(b, t, key, False) for b, t, key in templates]):
        tpl, key = text.split(), key.split()
        key_at = next(i for i in range(len(tpl)) if tpl[i:i + len(key)] == key)
        ranked = sorted((i for i, w in enumerate(tpl) if w in weights), key=lambda i: (-weights[tpl[i]], i))
        ws = [float(weights.get(w, 0.1)) for w in tpl]
        for i in ranked[:1 if base else POSTINGS]:
            rows.append((tpl[i], i, k, base, label, tpl, key, key_at, ws))
    return spark.createDataFrame(rows, "pword string, off int, entry int, base boolean, label string, tpl array<string>, "
                                       "key array<string>, key_at int, ws array<double>")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places)``."""
    vocab = vocabulary(phrases, templates)
    occ = materialise(occurrences(docs, vocab, doc_id, text))
    post = F.broadcast(postings(docs.sparkSession, idf(occ, vocab), phrases, templates))
    hit = occ.select("row", "n_words", F.explode_outer("hits").alias("h")).select("row", "n_words", "h.*").where("pos is not null")
    c = hit.join(post, hit.word == post.pword).withColumn("start", F.col("pos") - F.col("off")) \
        .withColumn("lo", F.expr(f"start - greatest(pos - {LONGEST - 1}, 0)"))  # the start, as a place in ctx
    # a notice may begin before the document or end after it; its key phrase may not
    c = c.where(F.expr("start + key_at >= 0 and start + key_at + size(key) <= n_words and "
                       "slice(ctx, greatest(lo + key_at, 0) + 1, size(key)) = key"))
    share = F.expr("aggregate(sequence(0, size(tpl) - 1), 0D, (s, j) -> s + if(lo + j >= 0 and get(ctx, lo + j) = tpl[j], ws[j], 0D)) "
                   "/ aggregate(ws, 0D, (s, x) -> s + x)")
    c = c.select("row", "entry", "base", "label", "start", "off", F.size("tpl").alias("len"), share.alias("share"))
    place = c.groupBy("row", "entry", "base", "label", "start").agg(
        F.max("share").alias("share"), F.countDistinct("off").alias("votes"), F.max("len").alias("len")) \
        .where(f"(base and share > 0.999999) or (not base and votes >= 2 and share >= {MIN_SHARE})")
    found = place.groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(F.col("base"), 1.0).otherwise(F.col("share"))).alias("score"),
        F.array_sort(F.collect_set(F.struct("start", "len", "label"))).alias("places"))
    return occ.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words")).join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "places")
