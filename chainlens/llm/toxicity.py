"""Operator 1: severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, release, ship, table, tidy, written

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)  # letters of the word starts that are features beside whole words
GRADES = 4  # 0: not toxic; 1 to 3: thirds of toxic texts by how toxic a model that has not seen them takes them for
DERIVED = 0.1  # what a threshold between derived grades counts for against that of the labels
_CACHE = 100_000  # words whose features a task holds at once


@dataclass(frozen=True)
class Model:
    """weights by feature, shared by all thresholds: P(grade > k) = 1 / (1 + exp(thresholds[k] - sum of weight * log1p(count)))."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def features(word: str) -> list[str]:
    """A word and its starts (marked by a hyphen)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]


def counts(text: str | None) -> dict[str, int]:
    """How often each word of the whole lower-cased text occurs."""
    return Counter(_WORD.findall((text or "").lower()))


def _known(text: str | None, weights: dict, cache: dict) -> dict[str, int]:
    """Counts of those features of the text that have a weight."""
    out: dict[str, int] = {}
    for w, n in counts(text).items():
        known = cache.get(w)
        if known is None:
            if len(cache) >= _CACHE:
                cache.clear()
            known = cache[w] = tuple(f for f in features(w) if f in weights)
        for f in known:
            out[f] = out.get(f, 0) + n
    return out


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic and fold (0 or 1) of at most max_labelled labelled documents, the first by a hash of doc_id.

    A doc_id that is labelled several times is toxic if one label says so; one that several rows share stands for one of
    them, the least text, so max_labelled bounds rows.
    """
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64(F.lit("labelled"), "doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold"))


_SIDES = ("c0", "t0", "c1", "t1")  # documents by fold and label: clean, toxic


def counted(labelled: DataFrame) -> DataFrame:
    """feature ('' for any text) and in how many documents of each of _SIDES it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in _SIDES]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, side in enumerate(held):
                if side:
                    numbers = np.zeros((len(_SIDES), len(side)), np.int64)
                    numbers[k] = list(side.values())
                    yield pa.RecordBatch.from_arrays([pa.array(list(side), pa.string()), *map(pa.array, numbers)], names=["feature", *_SIDES])
                side.clear()

        for some in pieces(batches):
            for text, toxic, fold in zip(some.column(0), some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                held[2 * fold + (toxic > 0)].update({"", *(f for w in counts(text.as_py()) for f in features(w))})
                if sum(map(len, held)) > 50_000:
                    yield from flush()
        yield from flush()

    rows = labelled.mapInArrow(count, "feature string, " + ", ".join(f"{s} long" for s in _SIDES))
    return rows.groupBy("feature").agg(*[F.sum(s).alias(s) for s in _SIDES])


def telling(summed: DataFrame, clean: Column, toxic: Column, most: int = 4000, least_docs: int = 4, least_gain: float = 15.0, least_odds: float = 1.0) -> list[str]:
    """The features that toxic documents have far more, or far less, often than others: at most `most`, by the likelihood ratio statistic."""
    n_clean, n_toxic = summed.where("feature = ''").select(clean, toxic).first() or (0, 0)
    t, c, share = F.col("t"), F.col("c"), n_toxic / max(1, n_toxic + n_clean)
    odds = F.log((t + 0.5) / (n_toxic + 1.0)) - F.log((c + 0.5) / (n_clean + 1.0))
    own = lambda k, p: F.when(k > 0, k * F.log(k / ((t + c) * F.lit(max(p, 1e-9))))).otherwise(0.0)
    gain = 2 * (own(t, share) + own(c, 1 - share))
    rows = summed.where("feature <> ''").select("feature", clean.alias("c"), toxic.alias("t")).where(t + c >= least_docs)
    ranked = rows.select("feature", gain.alias("gain"), odds.alias("odds")).where((F.col("gain") > least_gain) & (F.abs("odds") > least_odds))
    return [r["feature"] for r in ranked.orderBy(F.desc("gain"), "feature").limit(most).collect()]


class _Matrix:
    """Documents by features as log1p of counts, in coordinate form."""

    def __init__(self, at: list, n: list, names: list[str]) -> None:
        self.rows, self.names = len(at), names
        self.doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
        self.feature = np.concatenate([np.asarray(x, np.int64) for x in at]) if at else np.zeros(0, np.int64)
        self.value = np.log1p(np.concatenate([np.asarray(x, float) for x in n])) if n else np.zeros(0)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows, weights=weights[self.feature] * self.value)

    def back(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, minlength=len(self.names), weights=error[self.doc] * self.value)


def regress(x: _Matrix, y: np.ndarray, rows: np.ndarray, allowed: np.ndarray, rounds: int = 400, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the allowed features, and ordered thresholds, by the rows that are true: y is their grade from 0 on.

    One weight a feature serves all thresholds; the first one, that labels tell of, counts whole, and each further one,
    whose grades are only derived, DERIVED as much. Gradient steps (Adam) with a small ridge; the gaps between thresholds are
    exponentials, so they stay in order.
    """
    n_cuts = int(y.max())
    above = y[:, None] > np.arange(n_cuts)
    share = np.where(np.arange(n_cuts) > 0, DERIVED, 1.0)
    first = np.linspace(2.0, 2.0 * n_cuts, n_cuts)
    p = np.concatenate([np.zeros(len(x.names)), first[:1], np.log(np.diff(first))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    split = len(x.names)
    for step in range(1, rounds + 1):
        w, gaps = p[:split], np.exp(p[split + 1 :])
        cuts = p[split] + np.concatenate(([0.0], np.cumsum(gaps)))
        error = (1 / (1 + np.exp(np.clip(cuts - x.dot(w)[:, None], -30, 30))) - above) * rows[:, None] * share  # of P(grade > k)
        to_cut = -error.sum(0)
        g_gaps = np.array([to_cut[k + 1 :].sum() for k in range(n_cuts - 1)]) * gaps
        g = np.concatenate([(x.back(error.sum(1)) + ridge * w) * allowed, [to_cut.sum()], g_gaps]) / rows.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:split], p[split] + np.concatenate(([0.0], np.cumsum(np.exp(p[split + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model:
    """The model of at most max_labelled labelled rows (a documented bound).

    Labels say toxic or not. Features are those that toxic and other documents have far from equally often, for or
    against. How grave a toxic document is, is told by evidence that has not seen it: the sample is halved, each half
    chooses features and fits a model of toxic or not by itself, and scores the other half; by the thirds of these scores
    toxic documents have the grades 1 to 3. The ordinal model of all grades is then fitted to the whole sample. Without
    toxic or without clean labels, nothing is toxic.
    """
    ship(docs.sparkSession)
    labelled = written(sample(docs, labels, max_labelled), "labelled")
    summed = written(counted(labelled).where(f"feature = '' or {' + '.join(_SIDES)} >= 4"), "features")
    own = [set(telling(summed, F.col(f"c{k}"), F.col(f"t{k}"))) for k in (0, 1)]
    whole = telling(summed, F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"))
    names = whole + sorted((own[0] | own[1]) - set(whole))
    index = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for some in pieces(batches):
            found = [_known(t.as_py(), index, cache) for t in some.column(0)]
            columns = [some.column(1), some.column(2), pa.array([[index[f] for f in x] for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "fold", "at", "n"])

    rows = labelled.mapInArrow(vectors, "toxic int, fold int, at array<int>, n array<int>").toArrow()
    y, fold = (rows["toxic"].to_numpy() > 0).astype(np.int64), rows["fold"].to_numpy()
    if not names or not y.any() or y.all():
        return Model({}, (30.0,) * (GRADES - 1))
    x = _Matrix(rows["at"].to_pylist(), rows["n"].to_pylist(), names)
    unseen = np.zeros(len(y))
    for k in (0, 1):
        if y[fold == k].any() and not y[fold == k].all():
            w, cuts = regress(x, y, fold == k, np.array([f in own[k] for f in names]))
            unseen[fold != k] = (x.dot(w) - cuts[0])[fold != k]
    lower, upper = np.quantile(unseen[y > 0], [1 / 3, 2 / 3])
    grades = y + y * ((unseen > lower).astype(int) + (unseen > upper))
    if grades.max() < GRADES - 1:  # too few toxic texts, or all alike: their order decides
        order = np.flatnonzero(y)[np.argsort(unseen[y > 0], kind="stable")]
        grades[order] = 1 + np.arange(len(order)) * (GRADES - 1) // len(order)
        grades[order[-1]] = GRADES - 1
    w, cuts = regress(x, grades, np.ones(len(y), bool), np.array([i < len(whole) for i in range(len(names))]))
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if v}, tuple(float(c) for c in cuts))


def grade(model: Broadcast) -> Column:
    """A function of a text column: struct of severity (the expected grade), p_toxic (that of a grade over 0) and grade (the likeliest).

    Each row is judged by its whole text alone; null and empty texts are not toxic.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        weights, cuts = model.value.weights, np.array(model.value.thresholds)
        cache: dict = {}
        for batch in texts:
            s = np.array([sum(weights[f] * np.log1p(n) for f, n in _known(t.as_py(), weights, cache).items()) if t.as_py() else -1e9 for t in batch], float)
            over = 1 / (1 + np.exp(np.clip(cuts - s[:, None], -30, 30)))
            each = -np.diff(np.hstack([np.ones((len(s), 1)), over, np.zeros((len(s), 1))]), axis=1)
            yield pa.StructArray.from_arrays([pa.array(over.sum(1)), pa.array(over[:, 0].copy()), pa.array(each.argmax(1).astype(np.int32))], names=["severity", "p_toxic", "grade"])
            tidy()

    return F.arrow_udf(run, "severity double, p_toxic double, grade int")


def learn(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The model as a broadcast: at most `most` features of telling() for the whole sample, whatever the input."""
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by grade(); null and empty texts have grade 0, repeated rows and doc_ids each give their row."""
    docs = table(spark, sf_dir, "documents")
    judged = grade(learn(docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", judged("text").alias("_g"))
    return out.select("doc_id", "_g.severity", "_g.p_toxic", "_g.grade", (F.col("_g.p_toxic") >= 0.5).alias("toxic"))


def keep_civil(docs: DataFrame, labels: DataFrame, least_p: float = 0.5) -> DataFrame:
    """docs without those whose chance of a grade over 0 is least_p or more, all columns as they were.

    Null and empty texts stay; repeated rows stay or go together; where no labels name rows of docs, all stay.
    """
    judged = grade(learn(docs, labels))
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), judged(docs["text"]).alias("g"))
    return out.where(F.col("g.p_toxic") < least_p).select("row.*")
