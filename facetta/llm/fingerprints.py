"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of pieces: its paragraphs, cut at sentence ends, each with its place among equal pieces. The fingerprint
is a sketch of fixed size: CELLS cells that hold the count and the xor of the digests, which carry their own checks. Two
sketches subtract cell by cell; equal pieces cancel, and peeling cells that hold one digest recovers those in which the
versions differ. If peeling gets stuck, both versions are sketched again, four times larger; an estimate of the difference
from the least digests of both tells which size to begin with.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import input_bytes
from .common import few_files, table

HASHES, CELLS, GROWTH = 3, 24, 4
#: Sizes tried before the digests themselves are compared.
TRIES = 12
PIECE_CHARS = 240
#: Ranges of doc_id: so many a shuffle partition at least, and of so many input bytes at most.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 4, 8 << 20
#: Least digests from which a difference is estimated, and cells a digest that differs takes.
LEAST, LOAD = 32, 1.5
_MASK = (1 << 64) - 1
_CHECK, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PIECE = re.compile(r"[^\n.!?|]*[\n.!?|]+|[^\n.!?|]+")


def pieces(text: str) -> list[str]:
    """A text's paragraphs, cut at sentence ends and, where there are none, after PIECE_CHARS characters."""
    out = []
    for piece in _PIECE.findall(text):
        piece = piece.strip()
        if len(piece) <= PIECE_CHARS:
            if piece:
                out.append(piece)
        else:
            out += [piece[at : at + PIECE_CHARS] for at in range(0, len(piece), PIECE_CHARS)]
    return out


def digests(text: str) -> set[int]:
    """Keys of the pieces: 44 bits of a hash, and 20 bits that check them. The second of two equal pieces has another key."""
    hashed = [h >> 20 for h in map(xxhash.xxh3_64_intdigest, pieces(text))]
    out = {h << 20 | h * _CHECK >> 30 & 0xFFFFF for h in hashed}
    if len(out) < len(hashed):
        out, reached = set(), {}
        for piece in hashed:
            h = reached.get(piece, piece)  # of a piece that comes often, only the last key is passed again
            while (k := h << 20 | h * _CHECK >> 30 & 0xFFFFF) in out:
                h = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little")) >> 20
            out.add(k)
            reached[piece] = h
    return out


class Sketch:
    """Cells of an invertible Bloom lookup table; a key sits in one cell of each of three stretches."""

    __slots__ = ("counts", "size", "sums")

    def __init__(self, size: int, keys=()):
        n = self.size = size // HASHES
        counts, sums = [0] * size, [0] * size
        for k in keys:
            x = (k ^ n) * _SPREAD & _MASK
            i, j, m = (x & 0xFFFFF) % n, n + (x >> 20 & 0xFFFFF) % n, 2 * n + (x >> 40 & 0xFFFFF) % n
            counts[i] += 1
            counts[j] += 1
            counts[m] += 1
            sums[i] ^= k
            sums[j] ^= k
            sums[m] ^= k
        self.counts, self.sums = counts, sums

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0)
        out.size = self.size
        out.counts = [a - b for a, b in zip(self.counts, other.counts)]
        out.sums = [a ^ b for a, b in zip(self.sums, other.sums)]
        return out

    def peel(self) -> tuple[set[int], set[int]] | None:
        """Keys of the first version only and of the second only, or None if peeling gets stuck. Uses the cells up."""
        counts, sums, n = self.counts, self.sums, self.size
        first, second = set(), set()
        queue = [i for i, c in enumerate(counts) if c == 1 or c == -1]
        steps = 2 * len(counts)  # a sum that passes for a key by chance could go round for ever
        while queue and steps:
            i = queue.pop()
            sign, k = counts[i], sums[i]
            if (sign != 1 and sign != -1) or (k >> 20) * _CHECK >> 30 & 0xFFFFF != k & 0xFFFFF:
                continue  # not the cell of a single key
            x = (k ^ n) * _SPREAD & _MASK
            cells = (x & 0xFFFFF) % n, n + (x >> 20 & 0xFFFFF) % n, 2 * n + (x >> 40 & 0xFFFFF) % n
            if i not in cells:
                continue
            steps -= 1
            (first if sign > 0 else second).add(k)
            for j in cells:
                c = counts[j] = counts[j] - sign
                sums[j] ^= k
                if c == 1 or c == -1:
                    queue.append(j)
        return None if any(counts) or any(sums) or first & second else (first, second)

    def __str__(self) -> str:
        return struct.pack(f">{len(self.counts)}h{len(self.sums)}Q", *[(c + 0x8000) % 0x10000 - 0x8000 for c in self.counts], *self.sums).hex()


class Version:
    """A text's digests with its sketches by size, made as they are needed."""

    def __init__(self, text: str):
        self.keys = digests(text)
        self.least = sorted(self.keys)[:LEAST]
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, size: int = CELLS) -> Sketch:
        if size not in self.sketches:
            self.sketches[size] = Sketch(size, self.keys)
        return self.sketches[size]


def expected_difference(a: Version, b: Version) -> float:
    """How many digests differ, from the share that the least of both have in common."""
    common = set(a.least).intersection(b.least)
    both = sorted({*a.least, *b.least})[:LEAST]
    alike = len(common.intersection(both)) / max(1, len(both))
    return (len(a.keys) + len(b.keys)) * (1 - alike) / (1 + alike)


def differing(a: Version, b: Version) -> tuple[set[int], set[int]]:
    """Digests of only ``a`` and of only ``b``, by subtraction and peeling; larger sketches after each failure."""
    size, need = CELLS, LOAD * expected_difference(a, b)
    while size < need:
        size *= GROWTH
    for _ in range(TRIES):
        found = a.sketch(size).minus(b.sketch(size)).peel()
        if found is not None:
            return found
        size *= GROWTH
    return a.keys - b.keys, b.keys - a.keys


def likeness(a: Version, b: Version) -> float:
    """Share of the pieces of both that don't differ: 1 for equal sets, 0 for disjoint ones."""
    total = len(a.keys) + len(b.keys)
    return 1.0 - sum(map(len, differing(a, b))) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first characters of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _numbers(values: list) -> Column:
    """A constant array, made from one string however many there are."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _rank(key: Column, marks: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``marks`` are at most ``key``, by binary search in two constant arrays."""
    if not marks:
        return F.lit(0)
    ids, hashes = (_numbers(list(v)) for v in zip(*marks))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a.lo + a.hi) / 2).cast("int")
        at = F.get(ids, mid)
        right = (at < key["id"]) | ((at == key["id"]) & (F.get(hashes, mid) <= key["h"]))
        lo = F.when((a.lo < a.hi) & right, mid + 1).otherwise(a.lo)
        hi = F.when((a.lo < a.hi) & ~right, mid).otherwise(a.hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(marks).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(marks)).alias("hi")), halve).lo


def _range_starts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Sorted (id, hash) keys at which about ``parts`` ranges of as many rows begin. An id that is several quantiles of all
    ids is cut by quantiles of its rows' hashes."""
    quantiles = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    least = -(1 << 63)
    found = {(q, least) for q in quantiles}
    hot = [(q, n) for q, n in Counter(quantiles).items() if n > 1]  # parts at most
    if hot:
        own = rows.where(F.col("id").isin([q for q, _ in hot])).groupBy("id")
        cuts = own.agg(F.percentile_approx("h", [i / parts for i in range(1, parts)], 10_000).alias("h")).collect()
        for q, hs in ((r["id"], r["h"]) for r in cuts):
            n = dict(hot)[q] + 1
            found |= {(q, hs[i * len(hs) // n]) for i in range(n)}
    return sorted(found)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``.

    A null text counts as empty. The next document is the next in order of doc_id, a null doc_id last, and for repeated
    doc_ids in order of the text's hash; the last is followed by the first. One document alone is followed by itself.
    An empty table gives an empty result.

    Rows are dealt into ranges of (doc_id, hash of the text); the first of each range is also sent to the range before, so
    each partition reads its rows in order and holds two texts at a time. A doc_id, or null, that fills several ranges is
    cut by the hash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("h")
    ).withColumn("key", F.struct("id", "h"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION, input_bytes(docs) // BUCKET_BYTES)
    marks = _range_starts(rows, parts)
    bucket = _rank(F.col("key"), marks)
    # One row a bucket; the number of buckets is fixed by the number of partitions.
    heads = sorted((r[0], tuple(r[1])) for r in rows.groupBy(bucket.alias("b")).agg(F.min("key").alias("k")).collect())
    first, before = [(None, None)] * (len(marks) + 1), [None] * (len(marks) + 1)
    for i, (b, k) in enumerate(heads):
        first[b], before[b] = k, heads[i - 1][0]
    # The head of a bucket also goes to the one before.
    again = (F.get(_numbers([k[0] for k in first]), bucket) == F.col("id")) & (F.get(_numbers([k[1] for k in first]), bucket) == F.col("h"))
    own = F.struct(bucket.alias("b"), F.lit(0).alias("late"))
    late = F.struct(F.get(_numbers(before), bucket).cast("int").alias("b"), F.lit(1).alias("late"))
    copies = F.when(again, F.array(own, late)).otherwise(F.array(own))
    dealt = (
        rows.withColumn("__to", F.explode(copies))
        .select(F.col("__to.b").alias("b"), F.col("__to.late").alias("late"), "id", "h", "doc_id", "text")
        .repartition("b")
        .sortWithinPartitions("b", "late", "id", "h")
    )
    hexed = lambda v: f"{len(v.keys):08x}{v.sketch()}"

    def finish(doc_id, text, own: Version, following: str, follower: Version):
        other = edited(text, following)
        after = Version(other)
        return (
            doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(after),
            likeness(own, after), likeness(own, follower),
        )

    def apply(batches):
        held, out = None, []
        for batch in batches:
            for b, late, doc_id, text in zip(*(batch.column(i) for i in (0, 1, 4, 5))):
                b, late, text = b.as_py(), late.as_py(), text.as_py()
                same = held is not None and held[0] == b
                if late and not same:
                    continue  # the bucket's last row already has its next
                now = Version(text)
                if same:
                    out.append(finish(held[1], held[2], held[3], text, now))
                held = None if late else (b, doc_id.as_py(), text, now)
                if len(out) >= 1000:
                    yield as_batch(out)
                    out = []
        yield as_batch(out)

    def as_batch(out):
        columns = list(zip(*out)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return few_files(dealt.mapInArrow(apply, schema), docs.count(), texts=True, per_core=4)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
