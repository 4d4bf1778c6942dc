"""Toxicity scores (operator 10).

A lexicon is kept as a trie: insults, and stems learned from the labels.  Its
intersection with Levenshtein automata of distance ``MAX_EDITS`` is one deterministic
automaton, built as words need it: a state is the set of (trie node, edits so far) that a
word's letters can have reached.  A word ends in an accepting state if it is a term (or,
for terms of ``FUZZY_MIN`` letters and more, one edit away from one and not a word of its
own); one that passes a learned stem's node without an edit begins with that stem.  Around
every hit a context window decides between abuse and quotation: quotation marks that
enclose it, or a word of reporting or naming shortly before it.

*Learned stems.*  Beginnings of words (``STEM`` letters) that more toxic training rows hold
than clean ones do, by the likelihood ratio of presence and label (``EVIDENCE`` at least); a row
holds a beginning if ``REPEATS`` of its words have it, since single words of any kind turn
up by chance.  Of a beginning and its extensions the best one is kept.  A stem weighs its log-odds.  *Learned words of their
own*: words one edit from a term that clean training rows hold and toxic ones hardly.  Both
come from at most about ``FIT_ROWS`` labelled training rows, taken by a hash of the id.

A document's abuse, quoted terms and learned stems are the features of a logistic
regression.  Abuse is the count of exact terms and, with ``FUZZY_SHARE`` each, of misspelled
ones; they share a weight, so misspellings count even if the labelled rows hold none.
It is fitted to *all* labelled training rows through one aggregation to a few cells
(counts in powers of two, each cell with its mean counts), with a Gaussian prior, so it is
defined without labels too.  No count is capped.

Cases: null and empty texts have no hits and get the score of the intercept;
labels that are null don't train; several labels of one document count as toxic
if any is; repeated rows each get a result; an empty table gives an empty one;
only the named columns are read, others of any name do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import crc_mod, materialise

#: Insults, in English and some in the corpus's other languages.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "clown", "clowns", "loser", "losers", "scum", "trash",
    "pathetic", "worthless", "disgusting", "imbecile", "bastard", "retard", "retarded", "filth", "vermin",
    "garbage", "dumbass", "asshole", "bitch", "whore", "slut", "fuck", "fucking", "shit", "bullshit", "cunt",
    "wanker", "jerk", "creep", "freak", "degenerate", "parasite", "subhuman", "ignorant", "hideous",
    "arschloch", "vollidiot", "dummkopf", "schlampe", "missgeburt", "connard", "salope", "enculé", "imbécile",
    "gilipollas", "estúpido", "imbécil", "cabrón", "pendejo",
)
#: Words of their own one edit away from a term (English, German, French, Spanish); more are learned.
NEIGHBOURS = frozenset((
    "idiom idioms boron moran morn moro mormon mormons morton moroni crown crowns blown flown clow lover lovers lower lowers "
    "laser lasers loner loners closer closers looser poser posers loper luser hoser moser lose loses losen löser leser loyer "
    "oser doser scam scud scrum scut sum cum slum swum crash brash thrash rash tash tras trask apathetic bustard dastard "
    "reward rewarded regard regarded petard retarde retarder retardé retardo retarda fifth filch firth tilth verein termin "
    "vermis garage ditch pitch witch hitch fitch mitch titch itch aitch batch botch butch birch where whole whose whorl whorf "
    "shore chore wore hore slit slot slat smut glut slug slur salut shut saut blut flut scut duck luck tuck suck buck muck "
    "puck ruck yuck huck zuck cuck funk ducking tucking sucking bucking mucking rucking shot ship shin shim shiv shia shat "
    "sit hit spit suit skit snit whit chit shift shirt smit sait soit seit aunt hunt bunt punt runt cut cult cant count curt "
    "cent cont cuit cuna sunt banker tanker ranker canker hanker wander walker winker anker wacker wanken wanner perk werk "
    "merk berk kerk jerky creed creek creel cree creepy break wreak creak regenerate degenerated ignorent galope salopp "
    "schlappe").split())
#: Words that announce a quotation or a mention.
REPORTING = frozenset((
    "said", "says", "say", "called", "calls", "calling", "wrote", "writes", "quoted", "quote", "quotes", "word",
    "words", "term", "terms", "phrase", "slur", "insult", "insults", "shouted", "replied", "titled", "named",
))
QUOTES = (("“", "”"), ("«", "»"), ("„", "“"), ('"', '"'), ("‘", "’"))
MAX_EDITS = 1
FUZZY_MIN = 4
WINDOW_WORDS = 6
WINDOW_CHARS = 80
#: Learned stems: letters, words that make a row hold one, least evidence, toxic rows and ratio of shares, number; rows to learn
#: from; candidates looked at.
STEM = range(3, 9)
REPEATS = 2
EVIDENCE = 12.0
STEM_ROWS = 5
STEM_RATIO = 3.0
STEMS = 500
FIT_ROWS = 10_000
CANDIDATES = 5_000
COUNTED = 40_000  # counts of a task before they are given on
#: What a misspelled term counts towards abuse.
FUZZY_SHARE = 0.75
#: Prior of the weights: intercept, abuse, quoted, learned stems.
PRIOR_MEAN = (-2.5, 3.0, 0.0, 0.5)
PRIOR_SD = (3.0, 2.0, 1.0, 1.0)
THRESHOLD = 0.3
CACHE_WORDS = 50_000
NO_HIT, EXACT, FUZZY, STEMMED = 0, 1, 2, 3
# bytes of ASCII other than letters and digits part words
_BREAK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Automaton:
    """Product of the lexicon's trie and the Levenshtein automaton, determinised as needed."""

    def __init__(self, lexicon=LEXICON, edits: int = MAX_EDITS, fuzzy_min: int = FUZZY_MIN, stems: dict[str, float] | None = None) -> None:
        self.edits, self.fuzzy_min = edits, fuzzy_min
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # length of the term that ends at the node
        self.weight: dict[int, float] = {}  # of the stem that ends at the node
        self.passed: list[float] = []  # weight of the stem that a state has just passed
        for term in lexicon:
            node = self._insert(term)
            self.ends[node] = len(term)
        self.stem_only = [False] * len(self.child)  # nodes of stems alone: reached without an edit only
        for stem, w in (stems or {}).items():
            self.weight[self._insert(stem)] = w
        self.stem_only += [True] * (len(self.child) - len(self.stem_only))
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accept: list[int] = []
        self.step: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _insert(self, term: str) -> int:
        node = 0
        for ch in term:
            if ch not in self.child[node]:
                self.child[node][ch] = len(self.child)
                self.child.append({})
                self.ends.append(0)
            node = self.child[node][ch]
        return node

    def _state(self, reach: dict[int, int]) -> int:
        """Number of the state; ``reach``: node -> least edits, closed here under skipped letters."""
        todo = list(reach)
        while todo:
            node = todo.pop()
            e = reach[node] + 1
            if e <= self.edits:
                for nxt in self.child[node].values():
                    if not self.stem_only[nxt] and reach.get(nxt, self.edits + 1) > e:
                        reach[nxt] = e
                        todo.append(nxt)
        key = frozenset(reach.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(reach)
            self.step.append({})
            self.passed.append(max((self.weight.get(n, 0.0) for n, e in reach.items() if not e), default=0.0))
            self.accept.append(EXACT if any(self.ends[n] and not e for n, e in reach.items()) else
                               FUZZY if any(self.ends[n] >= self.fuzzy_min for n in reach) else NO_HIT)
        return self.states[key]

    def _next(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e < self.edits:
                out[node] = min(out.get(node, e + 1), e + 1)  # a letter too many
                for nxt in self.child[node].values():
                    if not self.stem_only[nxt]:
                        out[nxt] = min(out.get(nxt, e + 1), e + 1)  # a wrong letter
            if ch in self.child[node] and not (e and self.stem_only[self.child[node][ch]]):
                nxt = self.child[node][ch]
                out[nxt] = min(out.get(nxt, e), e)
        self.step[state][ch] = to = self._state(out)
        return to

    def look(self, word: str) -> tuple[int, float]:
        """(NO_HIT, EXACT or FUZZY; weight of the stem that the word begins with)."""
        s, step, stem = self.start, self.step, 0.0
        for ch in word:
            s = step[s][ch] if ch in step[s] else self._next(s, ch)
            if s == self.dead:
                return NO_HIT, stem
            stem = stem or self.passed[s]
        return self.accept[s], stem

    def match(self, word: str) -> int:
        return self.look(word)[0]


@dataclass(frozen=True)
class Terms:
    """What is learned about words: stems with weights, and words of their own."""

    stems: tuple[tuple[str, float], ...] = ()
    own: frozenset[str] = frozenset()


class _Seen(dict):
    """Kinds (and weights of learned stems) of the words seen so far (bounded); words are UTF-8 with A-Z lower-cased."""

    def __init__(self, terms: Terms) -> None:
        self.terms, self.automaton = terms, Automaton(stems=dict(terms.stems))
        self.weight: dict[bytes, float] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.weight.clear()
        w = word.decode("utf-8", "replace").lower()
        hit, stem = self.automaton.look(w)
        if hit == FUZZY and (w in NEIGHBOURS or w in self.terms.own):
            hit = NO_HIT
        if not hit and stem:
            hit, self.weight[word] = STEMMED, stem
        self[word] = hit
        return hit


_SEEN: dict[Terms, _Seen] = {}


def _quoted(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - WINDOW_CHARS):start], text[end:end + WINDOW_CHARS]
    for a, b in QUOTES:
        if a == b:
            if before.count(a) % 2 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    words = before.lower().encode("utf-8", "replace").translate(_BREAK).split()[-WINDOW_WORDS:]
    return any(w.decode("utf-8", "replace") in REPORTING for w in words)


def features(texts: list[str | None], terms: Terms = Terms()) -> list[tuple[int, int, int, float]]:
    """(exact abuse, misspelled abuse, quoted, weight of learned stems) of every whole text."""
    if terms not in _SEEN:
        _SEEN.clear()
        _SEEN[terms] = _Seen(terms)
    seen, out = _SEEN[terms], []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().translate(_BREAK).split()
        hits = set(np.nonzero(np.fromiter(map(seen.__getitem__, words), np.int8, len(words)))[0].tolist())
        if not hits:
            out.append((0, 0, 0, 0.0))
            continue
        forms = {words[i] for i in hits}
        n, learned = [0, 0, 0], 0.0
        for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text):
            w = m.group().encode("utf-8", "replace").lower()
            if w in forms:
                kind = seen[w]
                if _quoted(text, *m.span()):
                    n[2] += 1
                elif kind == STEMMED:
                    learned += seen.weight[w]
                else:
                    n[kind - 1] += 1
        out.append((*n, learned))
    return out


FEATURES = "abuse int, misspelled int, quoted int, learned double"


def feature_udf(text: Column | str, terms: Terms) -> Column:
    """Struct of the features."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame(features(s.tolist(), terms), columns=["abuse", "misspelled", "quoted", "learned"]) \
                .astype({"abuse": "int32", "misspelled": "int32", "quoted": "int32", "learned": "float64"})

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"struct<{FEATURES}>")(text)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]

    def score(self, feats: Column) -> Column:
        b, abuse, quoted, learned = self.weights
        z = F.lit(b) + F.lit(abuse) * F.log1p(feats["abuse"] + F.lit(FUZZY_SHARE) * feats["misspelled"]) \
            + F.lit(quoted) * F.log1p(feats["quoted"].cast("double")) + F.lit(learned) * F.log1p(feats["learned"])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_cells(cells: list[tuple[tuple[float, float, float, float], int, int]]) -> Model:
    """Logistic regression on (features, rows, toxic rows) with a Gaussian prior, by Newton steps."""
    mean, precision = np.array(PRIOR_MEAN), 1 / np.square(PRIOR_SD)
    if not cells:
        return Model(PRIOR_MEAN)
    x = np.array([[1.0, np.log1p(a + FUZZY_SHARE * m), np.log1p(q), np.log1p(v)] for (a, m, q, v), _, _ in cells])
    n, y = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    w = mean.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(n * np.logaddexp(0, z) - y * z) + 0.5 * np.sum(precision * (v - mean) ** 2))

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (n * p - y) + precision * (w - mean)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(precision), grad)
        t = 1.0
        while t > 1e-8 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-10:
            break
    return Model(tuple(map(float, w)))


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learned."""
    return docs.where(crc_mod(F.col(id_col), 4) != 2)


def _truth(labels: DataFrame) -> DataFrame:
    return train_rows(labels).where("toxic is not null and doc_id is not null") \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """``(kind, word, toxic, n)`` of ``rows(text, toxic)``: rows that hold a beginning (kind 0) or a word one edit from a term (1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = _Seen(Terms()), Counter()

        def flush() -> pa.RecordBatch:
            kind, word, toxic = zip(*counts) if counts else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(word, pa.string()), pa.array(toxic, pa.int32()),
                                              pa.array(counts.values(), pa.int64())], names=["kind", "word", "toxic", "n"])
            counts.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):  # one text at a time
                words = Counter((text.as_py() or "").encode("utf-8", "replace").lower().translate(_BREAK).split())
                near = {w for w in words if seen[w] == FUZZY}
                begin: Counter = Counter()
                for w, n in words.items():
                    form = w.decode("utf-8", "replace").lower()
                    for k in STEM:
                        if len(form) >= k:
                            begin[form[:k]] += n
                counts.update((0, s, toxic) for s, n in begin.items() if n >= REPEATS)
                counts.update((1, w.decode("utf-8", "replace").lower(), toxic) for w in near)
                if len(counts) >= COUNTED:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "kind int, word string, toxic int, n long") \
        .groupBy("kind", "word").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("a"),
                                     F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("b"))


def choose_stems(found: list[tuple[str, int, int]], a_rows: int, b_rows: int) -> tuple[tuple[str, float], ...]:
    """Of (stem, toxic rows, clean rows), best first: no stem that begins with or is the beginning of a better one."""
    kept: dict[str, float] = {}
    starts: set[str] = set()
    for stem, a, b in found:
        if stem not in starts and not any(stem[:k] in kept for k in range(1, len(stem) + 1)):
            kept[stem] = round(math.log((a + 0.5) / (a_rows + 1)) - math.log((b + 0.5) / (b_rows + 1)), 6)
            starts.update(stem[:k] for k in range(1, len(stem) + 1))
            if len(kept) == STEMS:
                break
    return tuple(kept.items())


def learn_terms(docs: DataFrame, labels: DataFrame) -> Terms:
    """Stems and words of their own, from about ``FIT_ROWS`` labelled training rows."""
    truth = _truth(labels)
    n = truth.count()
    if not n:
        return Terms()
    share = min(1.0, FIT_ROWS / n)
    few = train_rows(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < math.ceil(10_000 * share)).select("doc_id", "text")
    rows = materialise(few.join(truth, "doc_id").select("text", "toxic"))
    total = rows.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
    a_rows, b_rows = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    counts = materialise(_word_counts(rows).where("a >= 1 or kind = 1"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (a_rows + 1)) - F.log((b + 0.5) / (b_rows + 1))

    def part(k: Column, of: float, held: Column) -> Column:  # k log(k / expected)
        return F.when(k > 0, k * F.log(k * (a_rows + b_rows) / (held * of))).otherwise(0.0)

    miss = F.lit(float(a_rows + b_rows)) - (a + b)
    ratio = part(a, a_rows, a + b) + part(b, b_rows, a + b) + part(a_rows - a, a_rows, miss) + part(b_rows - b, b_rows, miss)
    stems = counts.where((F.col("kind") == 0) & (F.col("a") >= STEM_ROWS)).where((odds >= math.log(STEM_RATIO)) & (ratio >= EVIDENCE)) \
        .orderBy(ratio.desc(), "word").limit(CANDIDATES).select("word", "a", "b").collect()
    own = counts.where((F.col("kind") == 1) & (F.col("b") >= 1)).where(odds < math.log(STEM_RATIO)) \
        .orderBy(F.desc("b"), "word").limit(CANDIDATES).select("word").collect()
    return Terms(choose_stems([tuple(r) for r in stems], a_rows, b_rows), frozenset(r["word"] for r in own))


def fit(feats: DataFrame, labels: DataFrame) -> Model:
    """From ``feats(doc_id, f)`` and ``labels(doc_id, toxic)``: one join of small rows, one aggregation."""
    names = ("abuse", "misspelled", "quoted", "learned")
    bits = [F.length(F.bin(F.ceil(F.col(f"f.{c}")).cast("long"))).alias(f"b_{c}") for c in names]
    some = [(F.col(f"f.{c}") > 0).alias(f"s_{c}") for c in names]
    cells = feats.select("doc_id", "f").join(_truth(labels), "doc_id").groupBy(*bits, *some) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y"), *[F.round(F.avg(f"f.{c}"), 6).alias(c) for c in names]).collect()  # powers of two
    return fit_cells(sorted((tuple(r[c] for c in names), r["n"], r["y"]) for r in cells))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, abuse, misspelled, quoted, learned, score, predicted)`` of every row."""
    terms = learn_terms(docs, labels)
    feats = materialise(docs.select("doc_id", feature_udf("text", terms).alias("f")))
    model = fit(feats, labels)
    return feats.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "f.*",
                        model.score(F.col("f")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    terms = learn_terms(docs, labels)
    feats = train_rows(docs).select("doc_id", feature_udf("text", terms).alias("f"))
    model = fit(feats, labels)
    return docs.where(model.score(feature_udf("text", terms)) < THRESHOLD)
