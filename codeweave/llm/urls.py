"""URL filters (operator 4): rules by host and path, else a logistic regression.

The regression sees hashed character n-grams of ``host + path`` (``SIZES``, into
``DIMS`` weights) and is trained on the driver from ``LABELLED``, a small fixed
table.  Scoring is one Arrow-batched function over the two columns; the rules are
plain column expressions.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule
and is judged by the regression on the empty text; ties between rules of one
length go to the first given; repeated rows each get a verdict; an empty table
gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import UPPER

SIZES = (3, 4, 5)
DIMS = 1 << 14
THRESHOLD = 0.5
#: (verdict, host, path): fixed by contract.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: The labelled table: unwanted and wanted addresses.
UNWANTED = """
www.casino-royal.com/ win-casino.example.net/slots/ casino-bonus.org/en/12 m.lucky-casino.com/play best-casino.example.org/
blog.casino-jackpot.net/5 casino-wins.net/ m.casino-winners.com/en/3 online-win.org/ casino-slots.example.com/es/ win-big.example.com/ big-win.org/en/ www.win-prizes.com/fr/8 win-cash.example.net/
cheap-meds.com/ cheap-pills-online.example.org/ cheap-tabs.net/en/ www.cheap-viagra.com/de/4 diet-pills.example.com/
pills-direct.net/ m.pills-shop.org/buy blog.weight-pills.example.net/3 cheap-watches.com/ cheap-loans.example.org/
free-spins.com/ free-bets-now.example.org/ free-money.net/ m.free-cash.com/en/7 free-iphone.example.net/
sport-bets.com/ live-bets.example.org/ www.best-bets.net/ m.bets-online.com/odds horse-bets.example.com/
spam-mail.com/ spam-links.example.net/ link-spam.org/ www.spam-net.com/en/2 spam-host.example.org/
link-farm.com/ content-farm.example.org/ www.click-farm.net/ like-farm.com/ seo-farm.example.net/
ads-server.com/ ads-click.example.org/ www.ads-network.net/ m.pop-ads.com/ blog.ads-banner.example.com/
click-track.com/ track-user.example.net/ www.track-pixel.org/ ad-track.com/ tracking-ads.example.com/
adult-video.com/ adult-cams.example.net/ www.adult-chat.org/ m.adult-dating.com/ adult-xxx.example.org/
x-videos.com/ xxx-adult.example.com/ x-rated.net/ hot-x.example.org/ poker-win.com/ payday-loan.net/
"""
WANTED = """
www.wikipedia.org/ en.wikipedia.org/wiki/Bread news.example.com/en/12 blog.example.org/fr/8 www.example.net/de/4
library.example.org/ museum.example.com/en/300.html m.weather.example.net/ recipes.example.com/es/17/ www.theatre.org/
mathematics.example.org/ blog.thornton.com/en/5 m.northern.example.org/ thinker.example.net/en/77 therapy.example.com/
www.thought.org/en/9 other.example.com/ lighthouse.net/ m.heather.example.org/fr/3 thirteen.example.net/
www.leather.com/ feather.example.org/ together.net/en/41 blog.another.example.com/ breathe.org/ smith.example.net/
within.example.com/ m.earth.org/en/6 blog.health.example.net/ thunder.com/ rhythm.example.org/ depth.net/es/9
station.example.com/ nation.org/ www.motion.example.net/ blog.ration.com/ action.example.org/en/8 m.section.net/
docs.python.org/ spark.apache.org/docs/ www.gnu.org/licenses/ archive.example.com/ university.example.org/de/2
school.example.net/ garden.example.com/ www.river.org/ mountain.example.net/ history.example.org/en/1900.html
science.example.com/ m.physics.net/ blog.chemistry.example.org/ music.com/ opera.example.net/fr/55 painting.org/
thread.example.com/ m.thick.example.org/ www.the.net/ ther.example.com/ blog.then.org/ thing.example.net/en/31
bread.com/ www.train.example.org/ m.hand.net/ blog.stone.example.com/en/640 wood.example.net/ letter.org/fr/12/
"""
LABELLED = tuple((u, 1) for u in UNWANTED.split()) + tuple((u, 0) for u in WANTED.split())
_MUL = np.uint64(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one after the other, and the number of each text's."""
    rows, counts = [], []
    for t in texts:
        a = np.frombuffer(f"^{t}$".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        mine = []
        for n in SIZES:
            if len(a) >= n:
                h = np.full(len(a) - n + 1, np.uint64(n))
                for j in range(n):
                    h = (h ^ a[j:len(a) - n + 1 + j]) * _MUL
                    h ^= h >> np.uint64(29)
                mine.append(h >> np.uint64(50))
        rows += mine
        counts.append(sum(map(len, mine)))
    return (np.concatenate(rows) if rows else np.empty(0, np.uint64)).astype(np.int64), np.array(counts, np.int64)


@cache
def fit(ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept, by gradient descent with momentum on the labelled table."""
    idx, n = features([u for u, _ in LABELLED])
    y = np.array([v for _, v in LABELLED], float)
    row = np.repeat(np.arange(len(n)), n)
    unit = (1 / np.sqrt(n))[row]
    w, b, dw, db = np.zeros(DIMS), 0.0, np.zeros(DIMS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[idx] * unit, len(n)) + b)))
        g = (p - y) / len(y)
        dw = 0.9 * dw - 2.0 * (np.bincount(idx, g[row] * unit, DIMS) + ridge / len(y) * w)
        db = 0.9 * db - 0.2 * g.sum()
        w, b = w + dw, b + db
    return w, b


def scores(texts: list[str]) -> np.ndarray:
    """Probability of each text (host + path) to be unwanted."""
    w, b = fit()
    idx, n = features(texts)
    row = np.repeat(np.arange(len(n)), n)
    z = np.bincount(row, w[idx], len(n)) / np.sqrt(np.maximum(n, 1)) + b
    return 1 / (1 + np.exp(-z))


def score(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(s.tolist()), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, url, host, path, rule, score, verdict)`` of every row."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("by_rule"), score(F.concat("host", "path")).alias("score"))
    return p.select("page_id", "url", "host", "path", "rule", "score",
                    F.coalesce("by_rule", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"))
