"""Byte-level BPE, language id, toxicity and URL filters against brute force."""
import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from codeweave.llm import bpe, langid, toxicity, urls
from codeweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [(1, ""), (2, None), (None, "a b"), (3, "Words, words.\n\n  More 'words' don't 12²!"), (3, "again"), (3, "again"), (4, "x" * 30_000), (5, "  \t ")]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "x", 7) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score int")


def test_bpe_equals_library(library):
    c = bpe.Codec(bpe.read_ranks(RANKS))
    rng = random.Random(3)
    alphabet = "ab 'sdtrevlm\n\t  é中²½٣!?_-…ß\x85\x1cÉ🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(1500)]
    texts += ["a" * 5000, "=" * 3000, " " * 700 + "x", "ab" * 3000 + " \n\n  ", "'s", "''s", " 's", "x's", "'re", "'r", "'"]
    for t, ids in zip(texts, c.encode(texts)):
        assert library.encode_ordinary(t) == ids.tolist(), t[:50]
        assert c.decode(ids) == t.encode()


def test_bpe_wide_and_long_trees_agree():
    c = bpe.Codec(bpe.read_ranks(RANKS))
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"theingao ") for _ in range(rng.randint(2, bpe.WIDE))) for _ in range(300)]
    assert [x.tolist() for x in c.merge_rows(pieces)] == [c.merge_long(p).tolist() for p in pieces]


def test_bpe_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    c = bpe.Codec(bpe.read_ranks(RANKS))
    for i in range(20):
        t = " ".join(f"w{i}x{j}" for j in range(100))
        assert c.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_bpe_edge_rows(spark, edge, library):
    out = bpe.encode_texts(edge, RANKS)
    rows = out.collect()
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted(library.encode_ordinary(t or "") for _, t in EDGE)
    assert sorted(r["decoded"].decode() for r in rows) == sorted(t or "" for _, t in EDGE)
    assert {bytes(r["decoded"]) for r in bpe.decode_ids(out, RANKS).collect()} == {(t or "").encode() for _, t in EDGE}
    assert bpe.encode_texts(edge.limit(0), RANKS).count() == 0


def test_op7_whole_table(spark, library):
    import hashlib
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# ------------------------------------------------------------------ languages
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b["lang_pred"] for a, b in held) >= 0.97 * len(held)
    assert all(0 <= b["score"] <= 1 for _, b in held)


def test_language_edges(spark, edge):
    train = spark.createDataFrame([(i, "the thing and then the other", "en") for i in range(1, 9)]
                                  + [(i, "der die das und nicht ein", "de") for i in range(9, 17)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = edge.select("doc_id", "text", langid.predict(spark, model).alias("p")).collect()
    for r in rows:
        known = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["p"]["lang_pred"] == "und") == (not known)
    assert spark.createDataFrame([("the other thing",), ("und nicht die",)], "text string") \
        .select(langid.predict(spark, model).alias("p")).select("p.lang_pred").collect() == [("en",), ("de",)]
    none = langid.identify(edge.withColumn("lang", edge.ids).limit(0))
    assert none.count() == 0


def test_grams_by_hand():
    h, ends = langid.grams(["ab", "", "1 c"])
    # "ab": _ab ab_ _ab_ ; "c": _c_
    assert np.diff(ends).tolist() == [3, 0, 1]
    assert len(h) == 4


# ------------------------------------------------------------------- toxicity
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_levenshtein():
    terms = ("stupid", "scum", "pathetic", "moron", "disgusting")
    a = toxicity.Automaton(terms, 1, 5)
    rng = random.Random(1)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "u"])
        w = "".join(w)
        want = toxicity.EXACT if w in terms else toxicity.FUZZY if any(len(t) >= 5 and _distance(w, t) <= 1 for t in terms) else toxicity.NO_HIT
        assert a.match(w) == want, w


def test_more_languages_than_bits_and_many_copies(spark):
    """70 languages take two masks a slot; a text copied a thousand times is one text of the sample."""
    rng = random.Random(8)
    vocab = [["".join(chr(0x4E00 + 60 * i + rng.randrange(60)) for _ in range(5)) for _ in range(25)] for i in range(70)]
    word = lambda i: rng.choice(vocab[i])
    rows = [(100 * i + j, " ".join(word(i) for _ in range(30)), f"l{i:02d}") for i in range(70) for j in range(12)]
    copy = " ".join(word(3) for _ in range(30))
    rows += [(10_000 + k, copy, "l05") for k in range(1000)]  # one text of another language's letters
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id < 10000 and held_out").collect()
    want = {r[0]: r[2] for r in rows}
    assert len({r["lang_pred"] for r in got}) > 63
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) >= 0.97 * len(got)



def test_quotation_and_abuse():
    f = toxicity.features(["You idiot, you stupid moron!", 'He said the word "idiot" loudly.', "a stuppid thing", None, "", "IDIOT!! CLOWN!!"])
    assert f == [(3, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (2, 0, 0, 0)]
    assert toxicity.features(["idiot " * 5000]) == [(5000, 0, 0, 0)]  # no cap


def test_learned_terms_in_the_trie():
    t = toxicity.Terms((("blorg", 2.0), ("idio", 1.5)), frozenset({"oron"}))
    assert toxicity.features(["Blorgish BLORG blorx", 'she said "blorgs"', "an idiot, idiosyncratic", "oron moran mooron", "xblorg blrg"], t) == \
        [(0, 0, 0, 4.0), (0, 0, 1, 0.0), (1, 0, 0, 1.5), (0, 1, 0, 0.0), (0, 0, 0, 0.0)]
    rng = random.Random(3)
    stems = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 5))): 1.0 + i for i in range(12)}
    chosen = dict(toxicity.choose_stems([(x, 9, 1) for x in stems], 100, 100))
    assert all(x == y or not x.startswith(y) for x in chosen for y in chosen)
    a = toxicity.Automaton(("abcabc",), 1, 4, chosen)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        kind, stem = a.look(w)
        assert stem == max((v for x, v in chosen.items() if w.startswith(x)), default=0.0), w
        assert kind == (toxicity.EXACT if w == "abcabc" else toxicity.FUZZY if _distance(w, "abcabc") <= 1 else toxicity.NO_HIT), w


def test_learned_terms_brute(spark):
    """Stems and words of their own against counts made here from the same rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.learn_terms(docs, labels)
    rows = [(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r["text"].lower()), r["toxic"]) for r in
            docs.join(labels, "doc_id").where("toxic is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    total = Counter(t for _, t in rows)
    held = {t: Counter(x for w, y in rows if y == t
                       for x, n in Counter(v[:k] for v in w for k in range(3, 9) if len(v) >= k).items() if n >= 2) for t in (0, 1)}

    def value(x):
        a, b = held[1][x], held[0][x]
        cells = ((a, total[1], a + b), (b, total[0], a + b), (total[1] - a, total[1], len(rows) - a - b), (total[0] - b, total[0], len(rows) - a - b))
        return sum(k * math.log(k * len(rows) / (of * all_)) for k, of, all_ in cells if k)

    odds = lambda a, b: math.log((a + 0.5) / (total[1] + 1)) - math.log((b + 0.5) / (total[0] + 1))
    best = sorted((x for x, a in held[1].items() if a >= 5 and odds(a, held[0][x]) >= math.log(3) and value(x) >= 12), key=lambda x: (-round(value(x), 9), x))
    want = dict(toxicity.choose_stems([(x, held[1][x], held[0][x]) for x in best], total[1], total[0]))
    assert dict(got.stems) == want and want
    auto = toxicity.Automaton()
    near = Counter((x, y) for w, y in rows for x in set(w) if auto.match(x) == toxicity.FUZZY)
    assert got.own == {x for x, y in near if not y and odds(near[x, 1], near[x, 0]) < math.log(3) and x not in toxicity.NEIGHBOURS}


def test_misspelled_abuse_counts_whole(spark):
    f = toxicity.features(["you mooron", "idi0t sh1t scvm clwn l0ser", "mooron " * 200, 'He said "mooron" once.',
                           "Verein idiom crash where whole count Blut seit reward garage", "shat"])
    assert f == [(0, 1, 0, 0), (0, 5, 0, 0), (0, 200, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").select(*c) for t, c in
                    (("documents", ("doc_id", "text")), ("labels", ("doc_id", "toxic"))))
    bad = spark.createDataFrame([(-1, "you mooron"), (-2, "a stuppid and pathetik text"), (-3, "idi0t " * 200), (-4, "the verein of 1900")], docs.schema)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs.union(bad), labels).where("doc_id < 0").collect()}
    assert [got[i]["predicted"] for i in (-1, -2, -3, -4)] == [1, 1, 1, 0]
    assert got[-3]["score"] > got[-2]["score"] > got[-1]["score"]
    none = toxicity.drop_toxic(bad, labels.limit(0))  # the prior alone
    assert [r["doc_id"] for r in none.collect()] == [-4]


def test_toxicity_held_out(spark):
    """In every language nearly all held-out toxic rows are caught and nearly all clean ones kept."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count()
    seen = Counter((r["lang"], r["toxic"], r["predicted"]) for r in got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").collect())
    for lang in ("en", "fr", "de", "es"):
        assert seen[lang, 1, 1] >= 0.85 * (seen[lang, 1, 1] + seen[lang, 1, 0]), seen
        assert seen[lang, 0, 0] >= 0.96 * (seen[lang, 0, 1] + seen[lang, 0, 0]), seen


def test_toxicity_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(edge, none).collect()
    assert len(rows) == len(EDGE) and all(r["predicted"] == 0 for r in rows)
    twice = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(edge, twice).count() == len(EDGE)
    assert toxicity.drop_toxic(edge, none).columns == edge.columns
    assert toxicity.drop_toxic(edge, none).count() == len(EDGE)
    bad = spark.createDataFrame([(9, "you idiot, you moron, you scum", "x", 1)], edge.schema)
    assert [r["doc_id"] for r in toxicity.drop_toxic(edge.union(bad), none).where("doc_id = 9").collect()] == []


# ----------------------------------------------------------------------- urls
def test_url_rules(spark):
    rows = [("http://a.example.NET/en/1", "example.net/en/", "allow"), ("https://example.net/de/1", "net/", "block"),
            ("https://x.example.com/de/9?q#f", "example.com/de/", "block"), ("http://library.org/fr/", "org/fr/", "allow"),
            ("http://x.net", None, "allow"), ("http://notnet/", None, "allow"), (None, None, None), ("no scheme net/", None, None),
            ("http://h.org?x=/fr/", None, None), ("http://h.org#/fr/", None, None)]
    df = spark.createDataFrame([(i, u, 1) for i, (u, _, _) in enumerate(rows)], "page_id long, url string, score int")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (u, rule, verdict) in enumerate(rows):
        assert got[i]["rule"] == rule, u
        if rule:
            assert got[i]["verdict"] == verdict
        assert got[i]["verdict"] in ("allow", "block")
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/1")
    assert (got[6]["host"], got[6]["path"]) == ("", "") == (got[7]["host"], got[7]["path"])
    assert got[8]["path"] == "" == got[9]["path"]
    assert urls.judge(df.limit(0)).count() == 0


def test_url_model_separates():
    bad = ["www.casino-win.example.org/en/14", "cheap-pills.example.com/", "m.free-bets.example.com/de/9", "spam-farm.example.net/"]
    good = ["www.therti.example.org/en/3", "m.ththth.example.net/fr/825", "blog.garden.example.com/es/1"]
    assert urls.scores(bad).min() > 0.5 > urls.scores(good).max()
    assert np.mean((urls.scores([u for u, _ in urls.LABELLED]) > 0.5) == [y == 1 for _, y in urls.LABELLED]) > 0.97
