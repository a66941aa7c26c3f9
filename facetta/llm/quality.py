"""Quality by hierarchical empirical Bayes.

A classifier, a logistic regression fitted in numpy on a bounded sample of labelled documents, gives each document its
own evidence. Grouped aggregation turns the evidence into a mean quality for every host and every path of a host: a
path's mean is shrunk toward its host's, a host's toward the global one, the more the sparser it is, with strengths
estimated from the spread between hosts and between paths. A document's posterior adds its own evidence to what its
path's posterior says beyond the global prior.

``documents`` has no URL: its ``source`` is the host, and its ``lang`` the path below it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, join_grouped, staged, table

#: Labelled documents the classifier is fitted on, at most (about).
SAMPLE = 20_000
RIDGE, ROUNDS = 1e-3, 30
THRESHOLD = 0.5
#: Bounds of the estimated strengths of the priors, in documents.
STRENGTH = (1.0, 1e4)
SEED = 5
FEATURES = 12


def features(text: str | None) -> list[float]:
    """Shape of a text: length, words, case, marks, repetition. A null text is empty."""
    text = text or ""
    n = len(text)
    words = text.split()
    letters = n - sum(map(text.count, "0123456789 \n\t.,;:!?|-_%$#&*()'\""))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    m = max(1, len(words))
    marks = sum(map(text.count, "%$#&*|!<>{}[]=+~^@"))
    return [
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        letters / max(1, n),
        upper / m,
        marks / m,
        text.count("!") / m,
        text.count("|") / m,
        sum(map(text.count, ".,;:?")) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        len(set(lines)) / max(1, len(lines)),
        n / m / 20,
    ]


@dataclass
class Classifier:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -12, 12)


def train(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method; without labels of both kinds it knows only their share."""
    if not len(y):
        return Classifier(np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(FEATURES + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        penalty = RIDGE * len(y) * np.diag([*[1.0] * FEATURES, 1e-6])
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
    return Classifier(w, mean, scale)


def extract(docs: DataFrame, *carry: str) -> DataFrame:
    """The features of ``text`` as an array, with the columns ``carry``."""
    at = docs.select("text", *carry)

    def apply(batches):
        for b in batches:
            x = pa.array([features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, *b.columns[1:]], names=["x", *carry])

    kinds = dict(docs.dtypes)
    return at.mapInArrow(apply, ", ".join(["x array<double>", *(f"{c} {kinds[c]}" for c in carry)]))


def _share(key: Column, share: float) -> Column:
    return F.pmod(key, F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = SEED) -> Classifier:
    """Fit on about ``sample`` labelled documents at most, chosen by hash of their doc_id and, if many documents share a
    doc_id, of their text. Documents alike in doc_id and text count once, and a doc_id with several labels has the best."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.where(_share(F.xxhash64(F.lit(seed), "doc_id"), sample / max(1, known.count())))  # about ``sample`` rows
    chosen = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")).join(F.broadcast(some), "doc_id")
    got = staged(extract(chosen.dropDuplicates(["key"]), "doc_id", "quality", "key"), "sample", few=True)
    n = got.count()
    got = (got.where(_share(F.col("key"), sample / n)) if n > 2 * sample else got).toArrow()
    x = got.column("x").combine_chunks()
    order = np.lexsort([got.column("key").to_numpy(), got.column("doc_id").to_numpy()])
    y = got.column("quality").to_numpy().astype(float)
    return train(x.values.to_numpy().reshape(-1, FEATURES)[order], y[order])


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, up: str) -> float:
    """Documents that the prior above a group weighs: within-group over between-group variance, by moments.

    ``groups`` has ``n``, ``s`` (sum of evidence), ``q`` (of squares) and ``up``, the mean above.
    """
    r = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).alias("within"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(up)) ** 2).alias("between"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n").cast("double") ** 2).alias("nn"),
    ).first()
    if not r["groups"] or r["groups"] < 2 or r["n"] <= r["groups"]:
        return STRENGTH[1]
    inside = r["within"] / (r["n"] - r["groups"])
    spread = (r["between"] - (r["groups"] - 1) * inside) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(np.clip(inside / spread, *STRENGTH)) if spread > 0 else STRENGTH[1]


def quality(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``evidence`` (the classifier's probability), ``host_quality``, ``path_quality``, ``posterior``, ``keep``.

    A null text counts as empty; null hosts and paths are groups of their own; repeated rows come back as often as given
    and count as often; without labels every evidence is 0.5; an empty table gives an empty result; other columns are
    ignored.
    """
    model = fit(docs, labels)
    slim = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))

    def score(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-model.logit(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(p)], names=["doc_id", "host", "path", "evidence"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = staged(slim.mapInArrow(score, f"doc_id {kind}, host string, path string, evidence double"), "evidence", docs.count(), texts=True)

    e = F.col("evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")]
    paths = staged(scored.groupBy("host", "path").agg(*sums), "paths", few=True)
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"])
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    prior = total[1] / total[0] if total[0] else 0.5
    hosts = hosts.withColumn("up", F.lit(prior))
    k = strength(hosts, "up")
    hosts = staged(hosts.select(F.col("host").alias("h"), ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_quality")), "hosts", few=True)
    n_hosts, n_paths = hosts.count(), paths.count()
    above = join_grouped(paths, hosts, {"host": "h"}, n_hosts, F.xxhash64("path"))
    k = strength(above, "host_quality")
    means = above.select(
        F.col("host").alias("h"), F.col("path").alias("p"), "host_quality", ((F.col("s") + k * F.col("host_quality")) / (F.col("n") + k)).alias("path_quality")
    )
    out = join_grouped(scored, staged(means, "means", n_paths), {"host": "h", "path": "p"}, n_paths, F.xxhash64("doc_id", "evidence"))
    posterior = 1 / (1 + F.exp(-(logit(e) + logit(F.col("path_quality")) - float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))))
    out = out.select("doc_id", "evidence", "host_quality", "path_quality", posterior.alias("posterior"))
    return few_files(out.withColumn("keep", F.col("posterior") >= threshold), int(total[0] or 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
