"""Quality classifier by hierarchical empirical Bayes.

A logistic model on cheap text statistics, fitted on a bounded sample of labelled documents, gives each
document's evidence: its log-odds of good quality less those of the training sample. Sites get posteriors
on two levels, host (``source``) and path (``source``, ``lang``: documents have no URL, and the language stands
for the path): the expected number of good documents is shrunk towards the host's rate, which itself is
shrunk towards the global rate, with strengths taken from the spread between sites (method of moments). Sparse
sites thus fall back on their host, and sparse hosts on all. A document's posterior log-odds are its evidence
plus the log-odds of its path's rate, taken without the document itself, so that its evidence counts once.

Texts pass through Python once: what they yield is written beside the columns asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Workspace, pieces

UPPER = bytes(range(65, 91))
DIGIT = b"0123456789"
PROSE = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or c in b" \n\t\r.,;:'\"-")
N_STATS = 12
#: No evidence outweighs odds of e^EVIDENCE.
EVIDENCE = 12.0
#: Columns that scoring adds.
EXTRA = ("host", "path", "site_rate", "site_logit", "evidence", "posterior")


def stats(text: str) -> list[float]:
    """Text statistics, each between 0 and about 3; all 0 for a text without words."""
    b = text.encode("utf-8", "surrogatepass")
    w = b.lower().split()
    n, nw = len(b), len(w)
    if not nw:
        return [0.0] * N_STATS
    lines = b.split(b"\n")
    solid = sum(map(len, w))
    return [
        (n - len(b.translate(None, UPPER))) / n,
        len(b.translate(None, PROSE)) / n,
        (n - len(b.translate(None, DIGIT))) / n,
        b.count(b"|") / nw,
        b.count(b"!") / nw,
        len(set(w)) / nw ** 0.85,
        sum(map(eq, w, w[1:])) / nw,
        solid / nw / 10,
        1 - len(set(lines)) / len(lines),
        log(1 + nw) / 5,
        log(1 + nw / len(lines)) / 5,
        (b.count(b".") + b.count(b",")) / nw,
    ]


@dataclass
class Model:
    """Logistic regression on the statistics, their squares and quantile steps."""

    cuts: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        steps = (x[:, :, None] > self.cuts[None, :, :]).reshape(len(x), -1)
        return np.concatenate((np.ones((len(x), 1)), x, x * x, steps), 1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.weights - self.prior, -EVIDENCE, EVIDENCE)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Penalised likelihood by Newton steps. With labels of one class only (or none) evidence is 0."""
    model = Model(np.quantile(x, np.linspace(0.05, 0.95, 10), axis=0).T if len(x) else np.zeros((N_STATS, 10)), np.zeros(1 + 12 * N_STATS), 0.0)
    if len(set(y.tolist())) < 2:
        return model
    e = model.expand(x)
    w = np.zeros(e.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        h = (e * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ e + ridge * np.eye(len(w))
        step = np.linalg.solve(h, e.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    model.weights, model.prior = w, float(np.log(y.mean() / (1 - y.mean())))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fit on the ``sample`` labelled documents whose ids have the least hashes (the bound on what the
    driver holds: ``sample`` rows of 12 numbers). Contradictory labels count as bad; others than 0 and 1 and
    null ids are left out."""
    some = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches):
        for batch in batches:
            x = [stats(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    t = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(t.column("x").to_pylist(), float).reshape(-1, N_STATS)
    return fit(x, t.column("quality").to_numpy().astype(float))


def name(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\0"))


def with_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with a string column text) plus evidence double; text is the last column and is kept."""

    def run(batches):
        for batch in pieces(batches):
            x = np.array([stats(t) if t else [0.0] * N_STATS for t in batch.column("text").to_pylist()], float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.evidence(x))], names=[*batch.schema.names, "evidence"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("evidence", DoubleType())]))


def strength(groups: DataFrame, rate: Column, mean: Column) -> float:
    """Beta prior strength from groups (n, good): mean * (1 - mean) over the variance between groups, less
    1; between 1 and 10,000."""
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"), F.sum(F.col("n") * (rate - mean) ** 2).alias("ss"), F.sum(F.col("n") * mean * (1 - mean)).alias("v")).first()
    if not r.n or r.k < 2:
        return 10_000.0
    within = r.v / r.n
    between = (r.ss - (r.k - 1) * within) / (r.n - r.n2 / r.n) if r.n > r.n2 / r.n else 0.0
    return float(min(10_000.0, max(1.0, within / between - 1))) if between > 0 else 10_000.0


@dataclass
class Sites:
    """A row for each path that occurs, (host, path, __n, __good, __host_n, __host_good: documents and expected
    good ones), with the mean over all and the strengths of both levels."""

    table: DataFrame
    mean: float
    host_strength: float
    path_strength: float

    def rate(self, own: Column | float = 0.0, one: int = 0) -> Column:
        """A path's shrunken rate of good documents; with ``one`` = 1 without a document of probability ``own``."""
        k, k2 = self.host_strength, self.path_strength
        host = (F.col("__host_good") - own + k * self.mean) / (F.col("__host_n") - one + k)
        return F.least(F.greatest((F.col("__good") - own + k2 * host) / (F.col("__n") - one + k2), F.lit(1e-6)), F.lit(1 - 1e-6))


def sites(rows: DataFrame, ws: Workspace) -> Sites:
    """rows: (host, path, p), p a document's probability by its text alone. Expected counts are summed map-side
    first, so a host with very many documents costs no more."""
    paths = ws.written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = total.good / total.n if total.n else 0.5
    k = strength(hosts.toDF("host", "n", "good"), F.col("good") / F.col("n"), F.lit(mean))
    table = ws.written(paths.join(hosts, "host").select("host", "path", "n", "good", "host_n", "host_good"), "sites")
    host_rate = (F.col("host_good") + k * mean) / (F.col("host_n") + k)
    path_strength = strength(table, F.col("good") / F.col("n"), host_rate)
    return Sites(table.toDF("host", "path", "__n", "__good", "__host_n", "__host_good"), mean, k, path_strength)


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20_000, small: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, lang and any others), or its columns ``keep``, plus host, path, site_rate,
    site_logit, evidence and posterior (columns of these names in ``docs`` are replaced). The table is
    written once with its evidence. Sites are broadcast when a count shows at most ``small`` of them (10 MB),
    else joined by a shuffle.

    Null or empty texts have statistics of 0; null sources and languages are a site of their own; a
    repeated row is scored like its twin; an empty table stays empty."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(docs, labels, sample)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in EXTRA]
    rows = docs.withColumns({"host": name("source"), "path": name("lang"), "text": F.col("text").cast("string")})
    rows = ws.written(with_evidence(rows.select(*dict.fromkeys([*keep, "host", "path", "text"])), model).select(*keep, "host", "path", "evidence"), "evidence")
    own = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior))))
    found = sites(rows.select("host", "path", own.alias("p")), ws)
    rows = rows.join(F.broadcast(found.table) if found.table.count() <= small else found.table, ["host", "path"])
    rows = rows.withColumn("site_rate", found.rate(own, 1)).withColumn("site_logit", F.log(F.col("site_rate") / (1 - F.col("site_rate"))))
    return rows.select(*keep, *EXTRA[:-1], (1 / (1 + F.exp(-(F.col("evidence") + F.col("site_logit"))))).alias("posterior"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``threshold``, with the columns of ``docs``."""
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in EXTRA})
    kept = scored(safe, labels, sample).where(F.col("posterior") >= threshold)
    return kept.select(*[F.col(f"__own_{c}").alias(c) if c in EXTRA else c for c in docs.columns])
