"""Operator 3: language by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, release, ship, table, tidy

LANGUAGES = 128  # that are learned at most: 32 MB of weights
BUCKETS_LOG2 = 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
SLICE = 2**20  # characters looked at at once
HELD = 2**19  # n-grams scored at once
ODD = 16.0  # standard deviations below what a language's own texts have, beyond which a text is in no learned language
_LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased text, where each run of characters that are no letters counts as one space.

    A space stands before the text and after it. None if there is no letter. A long text comes in slices; each n-gram is
    in just one, that of its last character, and is the same as if the text had come whole.
    """
    longest, text = max(ORDERS), text.lower()
    tail = np.full(1, 32, np.uint64)  # what stood last, for n-grams that reach back
    for at in range(0, len(text) + 1, SLICE):
        piece = text[at : at + SLICE]
        raw = np.frombuffer((piece if at + SLICE <= len(text) else piece + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _LETTER[np.minimum(raw, 0xFFFF)]
        if len(far := np.flatnonzero(raw > 0xFFFF)):
            c[far] = [x if chr(x).isalpha() else 32 for x in raw[far].tolist()]
        gap = c == 32
        c = c[~(gap & np.concatenate(([tail[-1] == 32], gap[:-1])))].astype(np.uint64)
        if not len(c):
            continue
        old = len(tail)
        c = np.concatenate((tail, c))
        out, h = [], np.zeros(len(c), np.uint64)
        for n in range(1, longest + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                out.append(((h[max(0, old - n + 1) :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32))
        tail = c[-(longest - 1) :]
        yield np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """log P(bucket | language), float32 of buckets by languages, and what a text of a language has for each n-gram.

    mean, within and between are that log-probability's mean over the language's texts, its variance from n-gram to n-gram
    and that of texts' own means beyond it.
    """

    langs: list[str]
    weights: np.ndarray
    mean: np.ndarray
    within: np.ndarray
    between: np.ndarray


def sums(texts: list[str | None], weights: np.ndarray, squares: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text and language the summed log-probabilities and (if asked for) squares, and of each text the n-grams.

    Texts of a batch are one sparse matrix, its rows' buckets one after the other: their weights are gathered at once and
    added up by row.
    """
    total, second, n = np.zeros((len(texts), weights.shape[1])), np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal size
        if held:
            w = weights.take(np.concatenate(held), axis=0)
            at = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(total, rows, np.add.reduceat(w, at, axis=0, dtype=np.float64))
            if squares:
                np.add.at(second, rows, np.add.reduceat(w * w, at, axis=0, dtype=np.float64))
        rows.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for g in grams(text) if text else ():
            rows.append(i)
            held.append(g)
            n[i] += len(g)
            size += len(g)
            if size >= HELD:
                add()
    add()
    return total, second, n


def fit(docs: DataFrame, per_language: int = 4000, languages: int = LANGUAGES) -> Model:
    """What docs (doc_id, text, lang) teach; rows without text or lang teach nothing.

    lang is a free column, so at most `languages` of its values are learned, those that most documents have (ties by name):
    the model has a bound whatever else is in it. Documents of other values are judged like any.

    About per_language documents of a language are read, or all if there are no more: a documented sample, drawn by a
    hash of doc_id. What reaches the driver is one count for each language and bucket, and five sums for each language.
    """
    ship(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    langs = sorted(n)
    none = np.zeros(len(langs))
    if not langs:
        return Model([], np.zeros((2**BUCKETS_LOG2, 0), np.float32), none, none, none)
    share = F.try_element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / n[k]))]), F.col("lang"))
    sample = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit("train"), "doc_id"), 11) / float(2**53) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for some in pieces(batches):
            for text, lang in zip(some.column(0), some.column(1).to_pylist(), strict=True):
                for g in grams(text.as_py()):
                    if lang not in held:
                        held[lang] = np.zeros(2**BUCKETS_LOG2, np.int64)
                    held[lang] += np.bincount(g, minlength=2**BUCKETS_LOG2)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((2**BUCKETS_LOG2, len(langs)))
    counts[counted["bucket"].to_numpy(), [place[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    smooth = counts + 0.5
    weights = np.log(smooth / smooth.sum(0)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            at = np.array([place[x] for x in some.column(1).to_pylist()], np.int64)
            total, second, n = sums(some.column(0).to_pylist(), shared.value, True)
            own, kept = np.arange(len(at)), n > 0
            m, v = total[own, at] / np.maximum(n, 1), second[own, at] / np.maximum(n, 1)
            columns = [pa.array(at[kept]), pa.array(m[kept]), pa.array(np.maximum(v - m * m, 0)[kept]), pa.array(1 / n[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "m", "v", "inv"])

    told = sample.mapInArrow(measure, "lang long, m double, v double, inv double").groupBy("lang").agg(F.avg("m").alias("m"), F.var_pop("m").alias("s"), F.avg("v").alias("v"), F.avg(F.col("v") * F.col("inv")).alias("c"))
    mean, within, between = none.copy(), none + 1.0, none.copy()
    for r in told.collect():
        mean[r["lang"]], within[r["lang"]], between[r["lang"]] = r["m"], r["v"], max(r["s"] - r["c"], 0.0)
    return Model(langs, weights, mean, within, between)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the language, its posterior share, and how many standard deviations its n-grams lie off that language's own."""
    total, _, n = sums(texts, model.weights)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best, seen = total.argmax(1), n > 0
    share = np.where(seen, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
    n = np.maximum(n, 1)
    off = (total[np.arange(len(texts)), best] / n - model.mean[best]) / np.sqrt(model.between[best] + model.within[best] / n + 1e-12)
    return [model.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen.tolist(), strict=True)], share, np.where(seen, off, 0.0)


def identify(model: Broadcast) -> Column:
    """A function of a text column: struct of lang_pred, score (the posterior share of that language, equal priors) and off.

    off says how far the text's mean log-probability lies from what the language's own texts have, in standard deviations
    that a text of its length has. und, with score 0, if the text is null or has no letter, or nothing was learned; ties
    go to the first language by name. Each row is judged by its text alone.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for whole in texts:
            out = [predict(whole.slice(at, 500).to_pylist(), model.value) for at in range(0, len(whole), 500)]
            langs = pa.array([x for a, _, _ in out for x in a], pa.string())
            numbers = [pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.float64()) for k in (1, 2)]
            yield pa.StructArray.from_arrays([langs, *numbers], names=["lang_pred", "score", "off"])
            tidy()

    return F.arrow_udf(run, "lang_pred string, score double, off double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Broadcast:
    """The model of what docs say outside the held-out quarter; its size is fixed by buckets and languages."""
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return docs.sparkSession.sparkContext.broadcast(model)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by identify(); null doc_ids teach nothing and are not held out; repeated rows are rows like any other."""
    docs = table(spark, sf_dir, "documents")
    guess = identify(learn(docs))
    out = docs.select("doc_id", held_out().alias("held_out"), guess("text").alias("_g"))
    return out.select("doc_id", "held_out", "_g.lang_pred", "_g.score", "_g.off")


def keep_known(docs: DataFrame, least_score: float = 0.5, odd: float = ODD) -> DataFrame:
    """docs without rows in no learned language.

    Those are texts without letters (null, empty), those whose best language has less than least_score of the posterior,
    and those whose n-grams lie more than odd standard deviations below what that language's own texts have. Where no row
    has a lang, none is learned and none is kept. Repeated rows stay or go together; all columns come back as they were.
    """
    guess = identify(learn(docs))
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), guess(docs["text"]).alias("g"))
    return out.where((F.col("g.lang_pred") != UNKNOWN) & (F.col("g.score") >= least_score) & (F.col("g.off") >= -odd)).select("row.*")
