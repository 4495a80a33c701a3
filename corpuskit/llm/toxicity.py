"""Toxic passages: maximum-scoring segments of token log-odds.

A bounded sample of labelled documents gives log-odds under a Dirichlet prior,
and the constants of the extreme-value law.  Every document is then scanned once,
in its own task, in time linear in its length; nothing of the corpus is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import packed, small_batches, unpacked, whole_text
from corpuskit.llm.tokenizing import Cache

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
# Labelled rows that are fitted on; the broadcast tables are bounded by them.
TRAIN_ROWS = 20_000
# Toxic documents that must have a feature, and the prior's weight in documents.
LEAST_DOCUMENTS = 4
PRIOR = 1.0
# What a token without toxic evidence adds to a segment.
DRIFT = -0.25
SIGNIFICANT = 0.05


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def features(word: str) -> list[str]:
    """The word, and its openings of 4 to 6 letters marked with a caret."""
    return [word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]
    scale: float = 1.0     # lambda of the extreme-value law
    size: float = 1.0      # K of it
    slope: float = 0.0
    intercept: float = 0.0

    def token_score(self, word: str) -> float:
        return max((self.odds[f] for f in features(word) if f in self.odds), default=DRIFT)

    def surprise(self, best: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """-log of the chance that a clean text of this length has such a segment."""
        expected = self.size * np.maximum(tokens, 1) * np.exp(-self.scale * best)
        chance = np.where(best > 0, -np.expm1(-expected), 1.0)
        return -np.log(np.maximum(chance, 1e-300))

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.minimum(surprise, 50.0))))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, start, end), in one pass.

    Candidates carry the running sum before (left) and after (right).  A new one
    joins back to the nearest candidate with a smaller left sum when its right
    sum is the larger; ties stay apart.
    """
    found: list[tuple[float, float, int, int]] = []
    total = 0.0
    for at, score in enumerate(scores):
        left, total = total, total + score
        if score <= 0:
            continue
        start, right = at, total
        while found:
            back = len(found) - 1
            while back >= 0 and found[back][0] >= left:
                back -= 1
            if back < 0 or found[back][1] >= right:
                break
            left, start = found[back][0], found[back][2]
            del found[back:]
        found.append((left, right, start, at + 1))
    return [(right - left, start, end) for left, right, start, end in found]


def scan(texts: pd.Series, model: Model, cache: Cache) -> pd.DataFrame:
    """Per text: tokens, the best segment, how many are significant and their joint surprise."""
    out = []
    for text in texts:
        words = TOKEN.findall(text.lower())
        scores = list(map(cache.__getitem__, words))
        if not scores or max(scores) <= 0:
            out.append((len(scores), 0.0, -1, -1, 0, 0.0))
            continue
        parts = segments(scores)
        best = max(parts, key=lambda s: (s[0], -s[1]))
        heights = np.array([p[0] for p in parts])
        surprise = model.surprise(heights, np.full(len(parts), len(scores)))
        rare = surprise > -math.log(SIGNIFICANT)
        out.append((len(scores), best[0], best[1], best[2], int(rare.sum()), float(
            max(surprise.max(), surprise[rare].sum()))))
    return pd.DataFrame(out, columns=["n_tokens", "best", "start", "end", "n_passages", "surprise"]).astype({
        "n_tokens": "int64", "best": "float64", "start": "int64", "end": "int64", "n_passages": "int64",
        "surprise": "float64"})


def _odds(train: DataFrame) -> dict[str, float]:
    """Lower ends of the features' log-odds, those above 1 only.

    Counts are of documents, and equal texts count once, so that one text that
    was copied gives no evidence for its odd words.
    """
    train = train.dropDuplicates(["_hash", "toxic"])
    n = dict(train.groupBy("toxic").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return {}

    def count(wanted: set[str] | None):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch["_text"]:
                    found = {f for w in set(TOKEN.findall(text.lower())) for f in features(w)}
                    seen.update(found if wanted is None else found & wanted)
            yield pd.DataFrame(list(seen.items()), columns=["feature", "n"])
        return of

    def counted(label: int, wanted: set[str] | None, least: int) -> dict[str, int]:
        rows = train.filter(F.col("toxic") == label).select("_text").mapInPandas(
            count(wanted), "feature string, n long")
        rows = rows.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r.feature: r.n for r in rows.toLocalIterator()}

    toxic = counted(1, None, LEAST_DOCUMENTS)
    clean = counted(0, set(toxic), 1)
    odds = {}
    for feature, a in toxic.items():
        b = clean.get(feature, 0)
        rate = (a + b) / (n_toxic + n_clean)
        alpha = PRIOR * (0.5 + rate)
        up, down = a + alpha, b + alpha
        value = math.log(up / max(n_toxic + PRIOR - up, 0.5)) - math.log(down / max(n_clean + PRIOR - down, 0.5))
        low = value - 1.645 * math.sqrt(1 / up + 1 / down)
        if low > 1:
            odds[feature] = low
    return odds


def _law(rows: pd.DataFrame, model: Model) -> Model:
    """Lambda by Karlin's equation, K from the clean rows."""
    clean = rows[rows["toxic"] == 0]
    height = float(np.mean(list(model.odds.values()))) if model.odds else 1.0
    share = (float((clean["best"] > 0).sum()) + 1) / (float(clean["n_tokens"].sum()) + 2)
    low, high = 1e-6, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        # In logarithms: share * exp(mid * height) against what the drift leaves open.
        above = math.log(share) + mid * height > math.log(-math.expm1(mid * DRIFT) + share * math.exp(mid * DRIFT))
        low, high = (low, mid) if above else (mid, high)
    scale = max(low, 0.05)
    least = min(model.odds.values(), default=1.0)
    seen = (float((clean["best"] >= least).sum()) + 1) / (len(clean) + 2)
    reach = float((clean["n_tokens"].clip(lower=1)).mean()) if len(clean) else 1.0
    size = -math.log1p(-min(seen, 0.99)) / (reach * math.exp(-scale * least))
    return Model(model.odds, scale, size)


def _line(rows: pd.DataFrame, model: Model) -> Model:
    """The logistic line from the joint surprise to the label."""
    x = np.minimum(rows["surprise"].to_numpy(), 50.0)
    y = rows["toxic"].to_numpy(dtype=float)
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(
            (design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.odds, model.scale, model.size, float(beta[1]), float(beta[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        train_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``train_rows`` labelled rows that are not held out.

    Rows are taken by a hash of the key.  Null labels are left out; a key with
    several labels is toxic if one of them is.  Without any labelled row all
    scores are one half.
    """
    named = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    named = named.groupBy(F.col(key).alias("_key")).agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.orderBy(F.xxhash64("_key"), "_key").limit(train_rows)
    train = docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text")).join(
        F.broadcast(named), "_key").withColumn("_hash", F.xxhash64("_text"))
    model = Model(_odds(train))

    def measured(model: Model) -> pd.DataFrame:
        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache = Cache(model.token_score)
            for batch in batches:
                done = scan(batch["_text"], model, cache)
                yield done[["n_tokens", "best", "surprise"]].assign(toxic=batch["toxic"])

        schema = "n_tokens long, best double, surprise double, toxic int"
        return train.select("toxic", "_text").mapInPandas(measure, schema).toPandas()

    rows = measured(model)
    if not len(rows):
        return model
    model = _law(rows, model)
    return _line(measured(model), model)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", at: float = 0.7,
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Add ``held_out``, ``score``, ``predicted``, ``n_passages`` and the worst passage.

    ``worst_start`` and ``worst_end`` are word positions (-1 without a passage).
    Only the text decides a score; null and empty texts get that of a text
    without toxic evidence.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, train_rows))

    @F.pandas_udf("score double, n_passages long, start long, end long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = model.value
        cache = Cache(known.token_score)
        for batch in batches:
            done = scan(batch, known, cache)
            yield pd.DataFrame({
                "score": known.probability(done["surprise"].to_numpy()), "n_passages": done["n_passages"],
                "start": done["start"], "end": done["end"]})

    df = packed(docs, _text=whole_text(text), held_out=held_out(F.col(key))).withColumn("_judged", judge("_text"))
    df = df.select("_row", "held_out", "_judged.score", "_judged.n_passages",
                   F.col("_judged.start").alias("worst_start"), F.col("_judged.end").alias("worst_end"))
    df = df.withColumn("predicted", (F.col("score") >= at).cast("int"))
    return unpacked(df, docs, "held_out", "score", "predicted", "n_passages", "worst_start", "worst_end")
