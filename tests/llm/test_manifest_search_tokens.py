"""Merkle manifest, lexical search and token files against brute force and exact round trips."""
import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeweave.llm import lexical, merkle, queries, tokenfiles

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, hi string, rank int, digest string"


# ------------------------------------------------------------------- manifest
def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(top, for each leaf its (left, right) siblings on the way)."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % 3:p - p % 3 + 3]
            ways[i].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], ways


def manifest_rows(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, ways, sorted_rows = [], [], []
    for s in order:
        g = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        top, w = tree([leaf(r, r["text"]) for r in g])
        tops.append(top)
        ways.append(w)
        sorted_rows.append(g)
    root, upper = tree(tops) if tops else (None, [])
    out = []
    for k, g in enumerate(sorted_rows):
        for r, w in zip(g, ways[k]):
            way = w + upper[k]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            d = leaf(r, r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"])
            for a, b in way:
                d = sha(a + d + b)
            out.append((r["doc_id"], leaf(r, r["text"]), tops[k], root, sha("".join(a + b for a, b in way)), d, d == root))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_manifest_brute(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # 1, 2: many buckets
    monkeypatch.setattr(merkle, "SPAN", 3 ** levels)
    rng = random.Random(levels)
    rows = [(i, f"text {i}\nline", rng.choice(["en", None]), s, rng.choice([5, None])) for s, n in
            (("hot", 100), ("a", 1), ("b", 2), ("é", 3), ("B", 4), ("", 9), (None, 28)) for i in rng.sample(range(1000), n)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (7, "one\nid", "en", "hot", 2), (7, "other\nid", "en", "hot", 2), (7, "one\nid", "en", "hot", 2),
             (8, "long " * 200_000 + "\n", "en", "long", 3), (12, "", "en", "a=", 0), (13, "\n\n", "en", "a=", 0)]
    rng.shuffle(rows)
    d = docs_of(spark, rows)
    got = [tuple(r) for r in merkle.report(d.repartition(5)).collect()]
    assert by_text(got) == by_text(manifest_rows(d.collect()))
    assert not all(r[6] for r in got) and any(r[6] for r in got)


def test_manifest_labels(spark):
    """Families hold nested intervals: children part the parent's, and every level of a tree covers it."""
    rows = [(i, str(i), "en", "s" if i % 4 else "t", i) for i in range(1300)]
    m = merkle.manifest(docs_of(spark, rows))
    for r in m.trees.families[0].unionByName(m.trees.families[1]).collect():
        assert [k["lo"] for k in r["kids"]] == [r["lo"], *[k["hi"] for k in r["kids"][:-1]]] and r["kids"][-1]["hi"] == r["hi"] <= r["size"]
        assert r["lo"] % 3 ** (r["level"] + 1) == 0 and len(r["kids"]) <= 3
    assert {(r["tree"], r["level"]): r["n"] for r in m.trees.families[0].groupBy("tree", "level").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()} \
        == {(t, j): n for t, n in (("=s", 975), ("=t", 325)) for j in range(6)}


def test_manifest_small(spark):
    assert merkle.report(docs_of(spark, []).limit(0)).count() == 0
    one = docs_of(spark, [(5, "a", "en", "s", 1)])
    r = merkle.report(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("") and r["verified"]
    assert merkle.report(docs_of(spark, [(5, "a", "en", "s", 1)] * 3)).count() == 3


# --------------------------------------------------------------------- search
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def ranking(docs, text, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, b in bags:
        m = 10 + 90 * sum(b.values()) * n // words
        s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
        if s > 0:
            out.append((-s, i is not None, i or 0, i))
    return [(r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(out)[:k])]


def zipf_text(rng, n, vocab):
    return " ".join(rng.choice(["{}", "{},", "{}.\n", "({})"]).format(vocab[min(int(rng.paretovariate(0.6)) - 1, len(vocab) - 1)]) for _ in range(n))


@pytest.mark.parametrize("shard_words,blocks", [(1_500_000, 1 << 17), (300, 1 << 17), (300, 40)])
def test_search_brute(spark, monkeypatch, shard_words, blocks):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", blocks)  # 40: several blocks of queries
    rng = random.Random(shard_words + blocks)
    vocab = [f"{a}{i}" for i in range(150) for a in ("w", "É", "Zw")]
    docs = [(i, zipf_text(rng, rng.choice([1, 5, 40, 120]), vocab)) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)]  # ties
    docs += [(3, docs[9][1]), (3, docs[3][1]), (None, docs[3][1]), (400, None), (401, ""), (402, " .. \n"), (403, "w0 " * 3000)]
    items = [(i, zipf_text(rng, rng.choice([1, 4, 30]), vocab)) for i in range(20)]
    items += [(50, docs[3][1]), (51, None), (52, "--"), (53, "unheard-of"), (7, docs[5][1]), (None, docs[6][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, score int").repartition(7)
    q = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, q string, rank int")
    got = lexical.search(lexical.index(d, shard_words=shard_words), q).collect()
    want = [(i, *r) for i, t in items for r in ranking(docs, t)]
    assert by_text(tuple(r) for r in got) == by_text(want)


def test_search_makes_few_accumulators():
    """Documents of common words alone get none once a rare word has settled the first places."""
    n = 4000
    common = np.arange(n)
    postings = {"the": (common, np.full(n, 3)), "of": (common, np.full(n, 2)), "rare": (np.array([5, 9, 70, 71]), np.array([4, 4, 1, 1]))}
    best = lexical.Best(2)
    made = lexical.rank_shard(list(range(n)), np.full(n, 100), postings, {0: [("rare", 9000), ("of", 40), ("the", 30)]}, n, 100 * n, best)
    assert made == 4 and [i for _, i in best[0]] == [5, 9]
    # a later shard without the rare word is skipped, one with it is not
    assert lexical.rank_shard(list(range(n)), np.full(n, 100), {k: postings[k] for k in ("the", "of")}, {0: [("rare", 9000), ("of", 40), ("the", 30)]}, n, 100 * n, best) == 0


def test_search_small(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(d.limit(0)), q).count() == 0
    assert lexical.search(lexical.index(d), q.limit(0)).count() == 0
    assert lexical.search(lexical.index(d), q).columns == ["item_id", "rank", "doc_id", "score"]
    # a very long text: one document fills a shard of its own; counts above 255 take four bytes
    long = spark.createDataFrame([(1, "a b " * 200_000), (2, "a c"), (3, "c"), (4, "c"), (5, "c")], "doc_id long, text string")
    rows = [(1, "a b " * 200_000), (2, "a c"), (3, "c"), (4, "c"), (5, "c")]
    got = lexical.search(lexical.index(long, shard_words=1000), spark.createDataFrame([(1, "a c b")], "item_id long, text string")).collect()
    assert by_text(tuple(r) for r in got) == by_text((1, *r) for r in ranking(rows, "a c b"))


# ---------------------------------------------------------------- token files
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def token_rows(tok, docs):
    out, start = [], 0
    for i, t in docs:  # in the order of the files
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_of_every_document(spark, tok):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op13_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == token_rows(tok, [(r["doc_id"], r["text"]) for r in docs])


def test_tokens_cases(spark, tok):
    rows = [(5, "five"), (None, "no id"), (3, None), (9, ""), (9, "nine twice"), (9, "nine twice"), (-4, "minus <|endoftext|> é\n\n  x"), (70, "long words " * 300_000), (71, "y" * 5000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(3)
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tokenfiles.write(d, path, PATH)
    back = {}
    for r in tokenfiles.read_tokens(spark, path).collect():
        back.setdefault(r["doc"], []).append((r["start"], r["n_tokens"], r["ids"]))
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    assert Counter((i, tuple(x[2])) for i, xs in back.items() for x in xs) == want
    order = sorted((s, i is not None, i or 0, n, len(ids)) for i, xs in back.items() for s, n, ids in xs)
    assert [x[1:3] for x in order] == sorted(x[1:3] for x in order)
    assert all(n == m for *_, n, m in order) and [x[0] for x in order] == [0, *np.cumsum([x[3] for x in order])[:-1]]
    assert tokenfiles.read_tokens(spark, path, 3, 9).where("doc not between 3 and 9").count() == 0
    assert tokenfiles.read_tokens(spark, path, 3, 9).count() == 5
    empty = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tokenfiles.write(d.limit(0), empty, PATH)
    assert tokenfiles.digests(tokenfiles.read_tokens(spark, empty)).count() == 0


def ids_of(enc, texts):
    ids, n = enc.encode(pa.array(texts, pa.string()), 0)
    assert n.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_long_texts_are_cut_between_words(tok, monkeypatch):
    rng = random.Random(1)
    enc = tokenfiles._encoder(open(PATH).read())
    for _ in range(60):
        t = "".join(rng.choice(["word", "It's", "é", "12", " ", "  ", "\n", "\t ", "!?", "   \n", " a", "<|endoftext|>", "\x1c", "\u00a0", "\u0120", "'s", " '"]) for _ in range(400))
        parts = tokenfiles.pieces(t, 50)
        assert "".join(parts) == t and len(parts) > 3
        for most in (50, 10**6):  # pieces of a text; the whole text
            monkeypatch.setattr(tokenfiles, "LONG", most)
            assert ids_of(enc, [t, "", " ".join(t.split()), t[1:]]) == [[*tok.encode(x, add_special_tokens=False).ids, 0] for x in (t, "", " ".join(t.split()), t[1:])]


def test_parts_are_forgotten_and_learned_again(tok, monkeypatch):
    monkeypatch.setattr(tokenfiles, "KNOWN", 10)
    enc = tokenfiles.Encoder(open(PATH).read())
    rng = random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcé,.") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "\n", "\n\nx"]) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        assert ids_of(enc, texts) == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_files_allow_selective_reads(spark):
    """Dictionary-coded ids, delta-packed metadata, page indexes; bounds and columns reach the scan."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tokenfiles.write(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, PATH, files=3)
    files = sorted(Path(path, "tokens").glob("*.parquet"))
    assert len(files) == 3
    for f in files:
        for g in range((meta := pq.ParquetFile(f).metadata).num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert any("DICTIONARY" in e for e in cols["ids.list.element"].encodings)
            assert all("DELTA_BINARY_PACKED" in cols[c].encodings for c in ("doc", "n_tokens", "part_start"))
            assert all(c.has_offset_index and c.has_column_index for c in cols.values() if c.path_in_schema != "ids.list.element")
            assert cols["doc"].statistics.has_min_max
    first = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in files]
    assert all(a.max < b.min for a, b in zip(first, first[1:]))  # files are ranges in ascending order
    plan = tokenfiles.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    plan = tokenfiles.read_tokens(spark, path, 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc,10)" in plan and "LessThanOrEqual(doc,20)" in plan
