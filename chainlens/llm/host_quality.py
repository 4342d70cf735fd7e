"""Operator 4: quality rules whose failures are judged by host."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, table, written

SYMBOLS = b"#*$%&|<>"
GAPS = b" \t\n\x0b\x0c\r"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What a document fails by: its base, symbols (over one in ten words), repeated lines (over half of those with a
#: word), mean word length (under 3 or over 10 code points).
RULES = {
    "base_failed": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols_failed": "10 * n_symbols > n_words",
    "lines_failed": "2 * n_dup_lines > n_lines",
    "length_failed": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
SURE = 3.0  # posterior standard deviations that a host's rate must lie beyond a bound


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text (null: none)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at GAPS alone
    inside = raw.translate(None, GAPS)
    word_chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.translate(None, GAPS)]
    return len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text holds twice or more, compared exactly by rank."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    rank: dict[bytes, int] = {}
    ids = np.array([rank.setdefault(w, len(rank)) for w in words], np.int64)
    width = 1
    while width < window:  # ranks of windows of twice the width, from pairs of ranks
        pairs = ids[:-width] * np.int64(len(words) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, host, text to doc_id, host and COUNTS."""
    for some in pieces(batches):
        found = np.array([counts_of(t.as_py()) for t in some.column(2)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, found.T.copy())], names=["doc_id", "host", *COUNTS])


def posterior(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, and how many documents fail each rule) with, for each rule, the shrunk rate, its spread and the prior's mean.

    The beta prior of a rule is fitted over all hosts by moments: the mean rate, and the variance of rates beyond what
    counting alone makes. A host's posterior mean is its rate shrunk to the prior's.
    """
    rate = lambda r: F.col(r) / F.col("n")
    sums = [F.avg(1 / F.col("n")).alias("inv")]
    for r in RULES:
        sums += [(F.sum(r) / F.sum("n")).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}")]
    prior = hosts.agg(*sums).first()
    out = hosts
    for r in RULES:
        m = min(max(prior[f"m_{r}"] if prior[f"m_{r}"] is not None else 0.5, 1e-4), 1 - 1e-4)
        between = max((prior[f"v_{r}"] or 0.0) - m * (1 - m) * (prior["inv"] or 0.0), 1e-6)
        k = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
        p = (F.col(r) + F.lit(m * k)) / (F.col("n") + F.lit(k))
        out = out.withColumn(f"rate_{r}", p).withColumn(f"mean_{r}", F.lit(m))
        out = out.withColumn(f"spread_{r}", F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("n") + F.lit(k) + 1)))
    return out


def verdicts(hosts: DataFrame) -> DataFrame:
    """host, host_rate (the base rule's shrunk rate), host_bad, and for each further rule whether the host is surely better than most.

    A host is bad if for some rule its rate surely (by SURE posterior standard deviations) lies over twice the prior's
    mean, but not less than 0.2 nor more than 0.8; it is better if its rate surely lies under the mean.
    """
    out = posterior(hosts)
    at = lambda part, r: F.col(f"{part}_{r}")
    bad = [at("rate", r) - SURE * at("spread", r) > F.least(F.greatest(2 * at("mean", r), F.lit(0.2)), F.lit(0.8)) for r in RULES]
    better = [(at("rate", r) + SURE * at("spread", r) < at("mean", r)).alias(f"better_{r}") for r in [*RULES][1:]]
    return out.select("host", at("rate", "base_failed").alias("host_rate"), reduce(or_, bad).alias("host_bad"), *better)


def judge(docs: DataFrame, host: str = "source", broadcast_hosts: int = 50_000, salts: int = 64) -> DataFrame:
    """Counts of each row of docs (doc_id, text, host), which RULES it fails, its host's verdict, and whether it is kept.

    Failures of each rule are summed by host, and each host's rates are shrunk to the beta prior fitted over all hosts
    (posterior). All documents of a bad host go (verdicts). Of any other host, those that fail their base go, and those
    that fail another rule, unless the host is surely better than most by that rule: its few failures are forgiven.

    Null text counts as no words, a null host as the host ''; null and repeated doc_ids and repeated rows are rows like
    any other; further columns are not looked at; an empty table gives an empty result. Hosts are broadcast only where
    they are counted to be few; beyond that the join is salted, so that a host with a third of all rows is dealt to as
    many tasks as there are salts.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = written(rows.mapInArrow(_counts, kind).withColumns({r: F.expr(x) for r, x in RULES.items()}), "counts")
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES]), "hosts")
    found = verdicts(hosts)
    if hosts.count() <= broadcast_hosts:
        out = rows.join(F.broadcast(found), "host")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)))
        out = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["host", "salt"])
    own: Column = reduce(or_, [F.col(r) & ~F.col(f"better_{r}") for r in [*RULES][1:]])
    return out.select("doc_id", *COUNTS, *RULES, "host_rate", "host_bad", (~F.col("base_failed") & ~F.col("host_bad") & ~own).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by judge(), which says what null, empty and repeated rows give."""
    return judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def _host_sql() -> str:
    """The host's part of the SQL: sums, moments, priors and verdicts of each rule."""
    rules = [*RULES]
    each = lambda form, joint=", ": joint.join(form.format(r=r) for r in rules)
    return f"""
f AS (SELECT *, {", ".join(f"({x}) AS {r}" for r, x in RULES.items())} FROM c),
h AS (SELECT host, count(*) AS n, {each("count(*) FILTER ({r}) AS {r}")} FROM f GROUP BY host),
p AS (SELECT avg(1 / n) AS inv, {each("least(greatest(sum({r}) / sum(n), 1e-4), 1 - 1e-4) AS m_{r}, var_pop({r} / n) AS v_{r}")} FROM h),
s AS (SELECT *, {each("least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, 1e-6) - 1, 1), 1e6) AS k_{r}")} FROM p),
q AS (SELECT host, n, s.*, {each("({r} + m_{r} * k_{r}) / (n + k_{r}) AS rate_{r}")} FROM h, s),
t AS (SELECT *, {each("{sure} * sqrt(rate_{r} * (1 - rate_{r}) / (n + k_{r} + 1)) AS d_{r}".replace("{sure}", str(SURE)))} FROM q),
r AS (SELECT host, rate_base_failed AS host_rate, {each("rate_{r} - d_{r} > least(greatest(2 * m_{r}, 0.2), 0.8)", " OR ")} AS host_bad,
  {", ".join(f"rate_{x} + d_{x} < m_{x} AS better_{x}" for x in rules[1:])} FROM t)
SELECT doc_id, {", ".join(COUNTS)}, {", ".join(rules)}, round(host_rate, 9) AS host_rate, host_bad,
  (NOT base_failed AND NOT host_bad AND NOT ({" OR ".join(f"({x} AND NOT better_{x})" for x in rules[1:])})) AS kept
FROM f JOIN r USING (host)
"""


OP4_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]') GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
),"""
    + _host_sql()
)
