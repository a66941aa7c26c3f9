"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax follow, all trained
together by stochastic gradient descent in numpy on a bounded sample of labelled documents. For prediction embedding and
layer fold into one table of scores per n-gram and language, so a whole text costs one lookup for each of its n-grams.
The softmax is calibrated by a temperature, and a document is rejected if its calibrated score is below a threshold; both
are fitted on a part of the sample that training doesn't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_files, table

#: Documents a language gives to the training sample; all languages together, though each gives LEAST_PER_LANGUAGE or all it has.
PER_LANGUAGE, SAMPLE_ROWS, LEAST_PER_LANGUAGE = 500, 100_000, 20
#: N-gram shares of all of the sample's documents together, 8 bytes each on the driver: by the mean length of the texts.
SAMPLE_ENTRIES = 8_000_000
BUCKET_BITS, DIM, EPOCHS, RATE = 16, 16, 4, 0.5
NGRAMS = (2, 3, 4)
FOLDS = 5
UNDETERMINED = "und"
#: Share of rightly labelled calibration documents that may be rejected; the threshold at least, in even shares.
REJECT_RIGHT, LEAST_SHARES = 0.001, 1.3
SEED = 77
_CHUNK = 1 << 20
_WORDISH = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDISH.finditer(text))


def ngram_buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of all byte n-grams of a text, chunk by chunk."""
    for start in range(0, max(len(data), 1), _CHUNK):
        x = data[start : start + _CHUNK + max(NGRAMS) - 1].astype(np.uint32)
        x[(x >= 65) & (x <= 90)] += 32
        h = x + np.uint32(1)
        for n in range(2, max(NGRAMS) + 1):
            if len(x) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(1)
            if n in NGRAMS:
                own = h[: _CHUNK]
                yield ((own ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of a text and their shares."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in ngram_buckets(as_bytes(text)):
        counts += np.bincount(b, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (buckets, languages)
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for b in ngram_buckets(as_bytes(text)):
            total += self.scores[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated score; ``und`` for null and for texts without letters."""
        if text is None or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = SEED) -> Model:
    """Fit on (buckets, shares, language) rows; a fifth of them calibrates."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    rng = np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(langs)}
    order = rng.permutation(len(rows))
    n_cal = len(rows) // 5 if len(rows) >= 20 else 0
    calibration, training = order[:n_cal], order[n_cal:]
    emb = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIM)).astype(np.float32) / DIM
    out = np.zeros((DIM, len(langs)), np.float32)
    seen = np.zeros(1 << BUCKET_BITS, bool)
    step, steps = 0, EPOCHS * max(1, len(training))
    for _ in range(EPOCHS):
        for i in rng.permutation(training):
            at, share, lang = rows[i]
            if not len(at):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            doc = share @ emb[at]
            grad = softmax(doc @ out)
            grad[index[lang]] -= 1
            back = out @ grad
            out -= rate * np.outer(doc, grad)
            # A mean over hundreds of n-grams gives each a tiny gradient: scaled by the shares' own norm.
            emb[at] -= (rate / float(share @ share) ** 0.5) * np.outer(share, back)
            seen[at] = True
    emb[~seen] = 0
    model = Model(langs, (emb @ out).astype(np.float32))
    return calibrate(model, [rows[i] for i in calibration])


def calibrate(model: Model, rows: list) -> Model:
    """Temperature by likelihood on a grid; threshold under which few right predictions fall.

    The labels are smoothed by what their number leaves open, so that a sample without errors doesn't call for certainty.
    """
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return model
    z = np.stack([share.astype(np.float64) @ model.scores[at] for at, share, _ in rows])
    y = np.array([model.langs.index(r[2]) for r in rows])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
    doubt = 1 / (len(y) + 2)
    goal = np.full(z.shape, doubt / max(1, z.shape[1] - 1))
    goal[np.arange(len(y)), y] = 1 - doubt
    loss = [-(goal * np.log(np.maximum(softmax(z / t), 1e-300))).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    floor = LEAST_SHARES / len(model.langs) if len(model.langs) > 1 else 0.0
    model.threshold = float(max(floor, np.quantile(p.max(axis=1)[right], REJECT_RIGHT))) if right.any() else 0.0
    return model


def fold_of(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model:
    """Train on up to about ``per_language`` documents of each language outside fold 0, chosen by hash.

    Every language that occurs is learned. Beyond SAMPLE_ROWS rows or SAMPLE_ENTRIES n-gram shares in all, each language
    gives fewer, but LEAST_PER_LANGUAGE. Rows alike in doc_id and text count once. Executors turn the sample's whole texts
    into n-gram shares; the driver gets these, at most 2**BUCKET_BITS a row, and holds a model of 2**BUCKET_BITS floats a
    language.
    """
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    entries = F.sum(F.least(F.octet_length("text") * len(NGRAMS), F.lit(1 << BUCKET_BITS)).cast("long"))  # at most
    counts = sorted(((r[1], r[0], r[2]) for r in pool.groupBy("lang").agg(F.count(F.lit(1)), entries).collect()), reverse=True)
    if not counts:
        return train([], seed)
    each = sum(e / n for n, _, e in counts)  # of one document of each language
    per_language = min(per_language, max(LEAST_PER_LANGUAGE, min(SAMPLE_ROWS // len(counts), int(SAMPLE_ENTRIES / max(1.0, each)))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for n, lang, _ in counts for x in (lang, min(1.0, per_language / n))])
    chosen = pool.where(u < F.element_at(share, F.col("lang"))).select("text", "lang", F.xxhash64("doc_id", "text").alias("k")).dropDuplicates(["k", "lang"])

    def extract(batches):
        for b in batches:
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float32())), b.column(1), b.column(2)],
                names=["at", "share", "lang", "k"],
            )

    got = chosen.mapInArrow(extract, "at array<int>, share array<float>, lang string, k long").toArrow()
    if not got.num_rows:
        return train([], seed)
    at, shares = (got.column(i).combine_chunks() for i in (0, 1))
    cut, buckets, values = at.offsets.to_numpy(), at.values.to_numpy(), shares.values.to_numpy()
    keys, langs = got.column(3).to_pylist(), got.column(2).to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], langs[i]))
    return train([(buckets[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]], langs[i]) for i in order], seed)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted``; existing columns of these names are replaced.

    A null text or one without letters gives ``und``, 0 and false. Very long texts are read in pieces. The prediction
    depends on the text alone, so repeated rows agree.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS floats a language
    where = docs.columns.index(text)

    def apply(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(where)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([x[0] for x in got], pa.string()),
                    pa.array([x[1] for x in got], pa.float64()),
                    pa.array([x[0] != UNDETERMINED and x[1] >= m.threshold for x in got], pa.bool_()),
                ],
                names=[*b.schema.names, "lang_pred", "score", "accepted"],
            )

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *new])
    return docs.mapInArrow(apply, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``, and ``accepted``."""
    model = fit(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "accepted").transform(few_files, docs.count(), texts=True)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``documents`` without those the model rejects."""
    out = identify(docs, fit(docs.select("doc_id", "text", "lang")))
    return few_files(out.where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns]), docs.count(), texts=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))
