"""Decontamination, Jaccard join, lattice hashing, licences and PII against brute force."""
import hashlib
import random
import re
import unicodedata
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import decontaminate, jaccard, lattice, licences, pii
from codeweave.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


# ------------------------------------------------------------ decontamination
def _hits(doc, items):
    w = words(doc)
    hit, ids = set(), set()
    for item, text in items:
        b = words(text)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == b[i:i + n]:
                    hit |= set(range(p, p + n))
                    ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("in_place", [50_000, 0])
def test_decontamination_brute(spark, monkeypatch, in_place):
    monkeypatch.setattr(decontaminate, "IN_PLACE", in_place)
    rng = random.Random(2)
    vocab = ["a", "B", "c", "é", "d1", "The"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 13, 14, 20, 40])] + [(None, text(15)), (9, None), (10, "  ..."), (2, text(13))]
    docs = [(i, text(rng.choice([3, 30, 60])) + " " + (rng.choice(items)[1] or "") + " " + text(20)) for i in range(25)]
    docs += [(100, None), (101, ""), (None, items[5][1]), (3, docs[3][1]), (3, items[6][1]), (102, "zz " * 3000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, h string, n_words int")
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, len int")
    got = decontaminate.report(d, b).collect()
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=key) == \
        sorted(((i, n, h, tuple(ids)) for i, t in docs for n, h, ids in [_hits(t, items)]), key=key)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not (h and 20 * h >= n) for _, t in docs for n, h, _ in [_hits(t, items)])
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == len(docs)


# --------------------------------------------------------------- Jaccard join
def _shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    n = min(k, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def _components(docs, k, num, den):
    s = {i: _shingles(t, k) for i, t in docs}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                i = len(s[a] & s[b])
                if den * i >= num * (len(s[a]) + len(s[b]) - i):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def _near_copies(rng, n_base, lengths, copies, edits):
    out = []
    for _ in range(n_base):
        w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.choice(lengths))]
        out.append(" ".join(w))
        for _ in range(rng.choice(copies)):
            v = list(w)
            for _ in range(rng.randrange(edits + 1)):
                v[rng.randrange(len(v))] = rng.choice(["x", "Y", "zz"]) + str(rng.randrange(9))
            out.append(" ".join(v[:rng.randint(max(1, len(v) - 2), len(v))]))
    return out


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 512), (5, 80, 100, 512), (3, 80, 100, 2)])
def test_jaccard_brute(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)  # 2: many pairs of blocks
    rng = random.Random(k * num)
    texts = _near_copies(rng, 30, [1, 2, 5, 9, 12, 30, 80, 300], [0, 1, 3, 8], 4) + ["", None, "  ", "same text here", "same text here"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, id string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, k, num, den).collect()}
    assert got == _components(docs, k, num, den)


def test_keep_one_with_repeated_ids(spark):
    """Rows are documents by id and set: a text of its own isn't lost because its id has another row."""
    a, b, c = "one two three four five six", "something else that nobody copied at all", "third text with other words in it"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, None), (4, ""), (5, a + " seven"), (5, a + " seven eight"), (None, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.keep_one(df, 3, 90, 100).collect())
    assert kept == sorted([("1", a), ("2", b), ("3", c), ("4", ""), ("5", a + " seven"), ("5", a + " seven eight"), ("None", a)])
    near = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(100))), (7, " ".join(f"w{i}" for i in range(101))), (8, "z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(near, 3, 90, 100).collect()) == [7, 8]


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (5, 300, 401, 900, 5000):
        for _ in range(20):
            u = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            v = np.unique(np.concatenate([u[rng.permutation(len(u))[rng.integers(0, n // 3 + 1):]], rng.integers(0, 2**63, rng.integers(0, n // 3 + 1), dtype=np.uint64)]))
            apart = len(np.setxor1d(u, v))
            hu, hv = (jaccard._mix(x * jaccard._M[1]) for x in (u, v))
            assert np.bitwise_count((jaccard.sketch(hu) ^ jaccard.sketch(hv)).view(np.uint64)).sum() <= apart
            x, y = jaccard.wide_sketch(u, hu), jaccard.wide_sketch(v, hv)
            if x and y:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) != len(y):
                    x, y = (jaccard._folded(x), y) if len(x) > len(y) else (x, jaccard._folded(y))
                assert np.bitwise_count(x ^ y).sum() <= apart


def test_jaccard_signatures_always_meet():
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for n in (5, 9, 10, 17, 40, 100, 700):
            for _ in range(40):
                u = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                cut = rng.integers(0, n // 4 + 2)
                v = np.unique(np.concatenate([u[rng.permutation(len(u))[cut // 2:]], rng.integers(0, 2**63, (cut + 1) // 2, dtype=np.uint64)]))
                i = len(np.intersect1d(u, v))
                if i < max(len(u), len(v)) and den * i >= num * (len(u) + len(v) - i):
                    assert np.intersect1d(jaccard.signatures(u, num, den), jaccard.signatures(v, num, den)).size


def test_jaccard_hot_passage_and_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))) for i in range(60)]
    base = " ".join(f"b{i}" for i in range(200))
    docs += [(100 + i, base.replace(f"b{3 * i} ", "edit ")) for i in range(60)] + [(200 + i, base) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()}
    assert got == _components(docs, 3, 90, 100)


def test_jaccard_passage_brings_no_pairs(spark, monkeypatch):
    """Texts that share a passage and no more go by their own shingles: rows that are dealt don't grow with the square of their number."""
    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    made, dealt = [], jaccard._dealt

    def counted(members):
        out = dealt(members)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard, "_dealt", counted)
    for n in (60, 240):
        rng = random.Random(n)
        passage = " ".join(f"p{i}" for i in range(60))
        docs = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(n)]
        docs += [(1000 + i, f"{t} more of it") for i, t in docs[:n // 6]]
        made.append(0)
        df = spark.createDataFrame(docs + docs[:n // 4], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, 5, 80, 100).collect()}
        assert got == _components(docs, 5, 80, 100)
    assert made[1] <= 5 * made[0] + 50


def test_jaccard_edges(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (8, "A  B c\td"), (None, "alone at last"), (9, "one"), (9, "one"), (9, "two"), (5, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, dropped int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (8, 2, 7), (None, 1, None), (9, 1, 9), (9, 1, 9), (9, 1, 9), (5, 0, 5)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "9", "None", "None"]
    assert jaccard.join_components(df.limit(0)).count() == 0
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


# ------------------------------------------------------------ lattice hashing
def test_e8_decoder_is_nearest():
    rng = np.random.default_rng(0)
    s = lattice.shortest()
    assert s.shape == (240, 8) and np.allclose((s * s).sum(1), 2)
    x = rng.normal(0, 2, (500, 8))
    p = lattice.decode_e8(x)
    d = ((x - p) ** 2).sum(1)
    for v in s:
        assert (((x - p - v) ** 2).sum(1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9  # the covering radius


def _links(x, t=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T >= t
    np.fill_diagonal(g, False)
    return g


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_lattice_recall(spark, monkeypatch, block_rows):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base[i] + rng.normal(size=(n, 64)) * 0.12 for i, n in ((0, 40), (1, 10), *((i, 1) for i in range(2, 40)))])
    x = np.concatenate([base, near, base[:5], 3 * base[:2]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, id int")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    g = _links(x.astype(float))
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= g.sum(1)).all() and n.sum() >= 0.99 * g.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_lattice_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    for cos, least in ((0.9501, 0.9), (0.97, 0.99)):
        x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * o])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        n = sum(r["n_links"] for r in lattice.near_duplicates(df).collect()) / 2
        assert n >= least * _links(x).sum() / 2, (cos, n)


def test_lattice_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (4, [5.0, -1.0]), (11, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect()]
    want = [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (4, 0, 4), (11, 0, 11)]
    assert sorted(g for g in got if g[0] is not None) == sorted(want)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# ------------------------------------------------------------------- licences
def test_licences_brute(spark):
    rng = random.Random(6)
    parts = ["Released under the MIT License.", "the Apache License, Version 2.0", "CC BY-NC 4.0", "mit", "license", "nc", "under the", "cc by nc cc by nc",
             "GNU General Public License, version 3.", "blah", "été", "version 2", "apache"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 40])))) for i in range(60)] + [(61, None), (62, ""), (3, "cc by nc"), (None, "cc by nc")]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, row string")
    got = licences.scan(df).collect()

    def brute(t):
        w = words(t)
        at = [(i, lab) for p, lab in licences.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == \
        sorted((str(i), n, c, str(a), str(z), labels) for i, t in docs for n, c, a, z, labels in [brute(t)])
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_notices(spark):
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", "licensed under the GNU General Public License, version 3",
             "general public version license gnu 3", "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in licences.scan(df).orderBy("doc_id").collect()] == ["mit", "gpl-3", "", "bsd"]


# ------------------------------------------------------------------------ PII
TEXT = ("Mr. John Smith met Mrs. Smith, and Mr. Smith. Call (212) 555-1234 or +44 20 7946 0958; card 4111 1111 1111 1111 or 4111-1111-1111-1111; "
        "IBAN DE89 3704 0044 0532 0130 00, 123-45-6789, A.B@X.COM a.b@x.com 10.20.30.40 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"")


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii_surrogates(spark):
    df = spark.createDataFrame([(1, TEXT, "p"), (2, "write to a.b@x.com", "p"), (3, None, "p"), (4, "", "p"), (5, "nothing here 12 345", "p")],
                               "doc_id long, text string, pii_text string")
    out = pii.replace_entities(df, found="kinds")
    assert out.columns == [*df.columns, "kinds"]
    got = {r["doc_id"]: r for r in out.collect()}
    t = got[1]["text"]
    for secret in ("John", "Smith", "555-1234", "7946", "4111", "3704", "123-45", "A.B@", "a.b@", "10.20.30.40", "24be"):
        assert secret not in t
    names = re.findall(r"Mrs?\. (?:\w+ )?(\w+)", t)
    assert names[0] == names[2] != names[1]  # coreference; another gender is another person
    assert re.search(r"\(\d{3}\) \d{3}-\d{4} or \+44 \d\d \d{4} \d{4};", t)
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{4}-\d{4}-\d{4}-\d{4})", t)
    assert cards[1].replace(" ", "") == cards[2].replace("-", "") and _luhn(cards[1])
    mail = re.search(r"([A-Z.]+@[A-Z0-9.]+) ([a-z.]+@[a-z0-9.]+)", t)
    assert mail[1].lower() == mail[2] and got[2]["text"] == f"write to {mail[2]}"
    assert re.search(r'token = "[0-9a-f]{40}"', t) and re.search(r" \d+\.\d+\.\d+\.\d+ token", t)
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == (None, "", "nothing here 12 345")
    assert pii.replace_entities(df.limit(0)).count() == 0
    assert pii.replace_entities(df).collect() == out.drop("kinds").collect()  # keyed, so repeatable


def _replaced(spark, *texts):
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("a, b, same, kept", [
    ("+49 30 1234567", "+49301234567", "[^0-9+]", "+49"), ("+1 (212) 555-1234", "+12125551234", "[^0-9+]", "+1"),
    ("+351 21 123 4567", "+351211234567", "[^0-9+]", "+351"),
    ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", " ", "DE"), ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", " ", "GB"),
    ("4111 1111 1111 1111", "4111111111111111", "[ -]", ""), ("Anna.Bell@x.com", "anna.bell@X.COM", None, ""),
    ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF", None, "")])
def test_pii_two_notations_one_surrogate(spark, a, b, same, kept):
    x, y = _replaced(spark, f"at {a} .", f"at {b} .")
    x, y = x[3:-2], y[3:-2]
    shape = [re.sub("[0-9a-zA-Z]", "x", z) for z in (x, y)]
    if same:
        assert re.sub(same, "", x) == re.sub(same, "", y) != re.sub(same, "", a) and x.startswith(kept) and y.startswith(kept)
        assert shape == [re.sub("[0-9a-zA-Z]", "x", z) for z in (a, b)]
    else:
        assert x.lower() == y.lower() != a.lower()


def test_pii_checked_in_every_notation(spark):
    free = _replaced(spark, "at +49 30 1234567 .")[0][3:-2]
    real = free.replace(" ", "")  # the surrogate is a real number, but in another notation
    x, y, z = _replaced(spark, "at +49 30 1234567 .", "at +49301234567 .", f"at {real} .")
    assert x.replace(" ", "") == y.replace(" ", "") not in (free.replace(" ", ""), z.replace(" ", ""))
    a, b = _replaced(spark, "at +212 555 1234 .", "at (212) 555-1234 .")
    assert a.startswith("at +212 ") and re.sub(r"\D", "", a) != re.sub(r"\D", "", b)  # not one number


@pytest.mark.parametrize("local, script", [("иван.петров", "CYRILLIC"), ("Νίκος_Σ", "GREEK"), ("łukasz.šimek", "LATIN"), ("ŁUKASZ", "LATIN"), ("Иван", "CYRILLIC"),
                                           ("王小明", "CJK"), ("दध٣٤", None), ("a", "LATIN"), ("İzmir7", "LATIN"), ("ǅ", "LATIN"), ("ჯონ", "LATIN"), ("x²½", None)])
def test_pii_no_letter_of_an_address_stays(spark, local, script):
    for x, y in zip(*[iter(_replaced(spark, f"at {local}@example.ru .", f"at {local.lower()}@EXAMPLE.ru ."))] * 2):
        got = x[3:].split("@")[0]
        assert len(got) == len(local) and x.split("@")[1].endswith(".example.net .")
        for a, b in zip(local, got):
            if a.isalnum():
                assert a.lower() != b.lower() and b.isalnum()
                assert a.isalpha() <= b.isalpha() and (a.isupper() <= b.isupper()) and (a.islower() <= (not b.isupper()))
                assert not (script and a.isalpha()) or unicodedata.name(b).startswith(script)
            else:
                assert a == b
        if len(local.lower()) == len(local):
            assert x.lower() == y.lower()  # one surrogate


def test_pii_given_names_are_apart(spark):
    given = [a + b for a in "Adam Alan Boris Carl Emil Tom".split() for b in ("", "a", "o", "us", "in", "el", "ke", "ka", "mo", "ta")]  # more than are listed
    texts = [f"Mr. {g} Smith" for g in given] + ["Mr. Smith", "Herr Adam Smith", "Mrs. Adam Smith", "господин Иван Петров", "господин Пётр Петров", "Mr. Adam Jones"]
    got = _replaced(spark, *texts)
    full = [x.split() for x in got[:len(given)]]
    assert len({x[1] for x in full}) == len(given) and not {x[1] for x in full} & set(given)
    assert {x[2] for x in full} == {got[len(given)].split()[1]}  # one family, also without a given name
    more = [x.split() for x in got[len(given) + 1:]]
    assert more[0][1:] == full[0][1:] and more[1][2] != full[0][2]
    assert more[2][2] == more[3][2] and more[2][1] != more[3][1] and re.fullmatch("[А-ЯЁ][а-яё]+", more[2][1])
    assert more[4][2] != full[0][2]


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "_ipv4", lambda d: f"concat('9.9.9.', string({pii._nth(d, '3', 60)}))")  # 60 surrogates only
    ips = [f"1.2.{a}.{b}" for a, b in product(range(5), range(5))] + ["9.9.9.7", "9.9.9.8"]  # two of them real
    df = spark.createDataFrame([(i, f"at {ip} and {ips[0]}") for i, ip in enumerate(ips)] + [(99, f"{ips[3]}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(df).collect()}
    sur = [got[i].split()[1] for i in range(len(ips))]
    assert len(set(sur)) == len(ips) and not set(sur) & set(ips)
    assert all(got[i].split()[3] == sur[0] for i in range(len(ips))) and got[99] == sur[3]


def test_pii_has_no_python(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    for plan in (pii.replace_entities(df), decontaminate.report(df, df.withColumnRenamed("doc_id", "item_id")), licences.scan(df)):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().optimizedPlan().toString())


def test_sha_of_items_is_of_sorted_strings(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    b = spark.createDataFrame([(10, "a b"), (9, "c d")], "item_id long, text string")
    r = decontaminate.report(d, b).select(F.sha2(F.array_join("items", ",").cast("binary"), 256)).first()[0]
    assert r == hashlib.sha256(b"10,9").hexdigest()


def test_long_mail_hosts(spark):
    """A host of any number of labels neither ends the JVM nor loses what was a mention before."""
    rows = [(1, "a@" + "b." * 20_000 + "com x"), (2, "a@" + "b." * 20_000 + "1 x"), (3, "me@mail.example.com, x@y.org. z@q.com1"), (4, "no@host, a@b..com, a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(df).collect()}
    assert got[1] != rows[0][1] and got[1].endswith(" x") and "b.b" not in got[1]
    assert got[2].endswith(" x") and got[4] == rows[3][1]
    assert not any(m in got[3] for m in ("me@mail.example.com", "x@y.org", "z@q.com")) and got[3].endswith("1")
