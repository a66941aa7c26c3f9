"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if at most TAU bits differ. The bits are dealt into parts, correlated bits together; part i
gets a threshold t_i with sum(t_i + 1) = TAU + 1, so that of two linked fingerprints at least one part differs in at most
t_i bits. Dynamic programming picks the thresholds, and the number of parts, by the rows they make and the candidates
that the bit statistics of the whole corpus let expect. A part is probed by its exact value (t = 0), by exact values
against values with up to one bit flipped (t = 1), or by flipped against flipped (t = 2); candidates are verified on all
64 bits inside their bucket.

Equal fingerprints are one node from the start. A bucket gives a spanning forest of its links, not all its pairs, and the
links are joined to components by alternating star contractions.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, join_grouped, staged, table, unstage

BITS = 64
SHINGLE, SEED, TAU = 4, 42, 4
#: Cost of a verified candidate against a probe row.
CANDIDATE_COST = 0.02
PARTS = (2, 3, 4, 5)
#: Rows of a bucket beyond which its fingerprints are probed once more, by SPLIT_PARTS parts of the bits outside its own.
SPLIT_ROWS = 20_000
#: Buckets up to this size are compared pair by pair with their neighbours in sort order, larger ones by search.
SMALL_BUCKET = 48
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    data = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    k = min(SHINGLE, len(words))
    begin, end = (ends - length)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), 65_536):
        h = np.array([digest(data[b:e], SEED) for b, e in zip(begin[at : at + 65_536], end[at : at + 65_536])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (long, the 64 bits as a signed number) and ``text_hash`` of every row of ``docs``."""

    def apply(batches):
        for b in batches:
            got = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), b.column(2)], names=["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(apply, "doc_id long, fp long, text_hash long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together, over all of them."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["at", "n"]
        )

    rows = nodes.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # BITS**2 + 1
    both = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        both[r[0]] = r[1]
    return int(both[-1]), both[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for i in range(parts):
        width = BITS * (i + 1) // parts - BITS * i // parts
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def distance_odds(part: list[int], n: int, both: np.ndarray) -> np.ndarray:
    """Odds that two fingerprints differ in 0, 1, 2, ... of a part's bits.

    The bits of a part correlate, so they are taken as a chain in which each is followed by the one most correlated with
    it: whether two fingerprints differ in a bit depends on whether they differ in the one before, as the joint counts of
    both bits tell.
    """
    p = np.diag(both) / max(1, n)

    def differ(b: int, c: int) -> np.ndarray:
        """Odds of two fingerprints to differ (1) or not (0) in ``b`` and in ``c``."""
        joint = np.array([[n - both[b, b] - both[c, c] + both[b, c], both[c, c] - both[b, c]], [both[b, b] - both[b, c], both[b, c]]], float) / max(1, n)
        out = np.zeros((2, 2))
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            out[x, y] = sum(joint[u, v] * joint[u ^ x, v ^ y] for u in (0, 1) for v in (0, 1))
        return out

    cov = np.abs(both / max(1, n) - np.outer(p, p))
    order, left = [part[0]], list(part[1:])
    while left:
        order.append(max(left, key=lambda b: cov[b, order[-1]]))
        left.remove(order[-1])
    first = 2 * p[order[0]] * (1 - p[order[0]])
    odds = np.zeros((2, len(part) + 1))  # by whether the last bit differs and by how many do
    odds[0, 0], odds[1, 1] = 1 - first, first
    for b, c in zip(order, order[1:]):
        step = differ(b, c)
        step = step / np.maximum(step.sum(axis=1, keepdims=True), 1e-300)
        stay, move = odds[0] * step[0, 0] + odds[1] * step[1, 0], odds[0] * step[0, 1] + odds[1] * step[1, 1]
        odds[0], odds[1] = stay, np.append(0, move[:-1])
    return odds.sum(axis=0)


def probe_cost(part: list[int], t: int, n: int, both: np.ndarray) -> float:
    """Rows that probing a part at threshold t makes, and the candidates to expect, weighed."""
    if t < 0:
        return 0.0
    if t > 2:
        return float("inf")
    w, odds, pairs = len(part), distance_odds(part, n, both), n * n / 2
    odds = np.append(odds, [0, 0])
    if t == 0:
        return n + CANDIDATE_COST * pairs * odds[0]
    if t == 1:
        return n * (w + 2) + CANDIDATE_COST * pairs * (odds[0] * (w + 2) + odds[1] * 2 + odds[2] * 2)
    return n * (w + 1) + CANDIDATE_COST * pairs * (odds[0] * (w + 1) + odds[1] * 2 + odds[2] * 2)


def allocate(n: int, both: np.ndarray, tau: int = TAU, choices=PARTS) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least expected cost, by dynamic programming over the parts and what is left of tau + 1."""
    best: tuple[float, list, list] = (float("inf"), [], [])
    for m in choices:
        parts = group_bits(n, both, m)
        reach = {0: (0.0, [])}
        for part in parts:
            step: dict = {}
            for used, (cost, ts) in reach.items():
                for t in range(-1, tau - used + 1):
                    c = cost + probe_cost(part, t, n, both)
                    if c < step.get(used + t + 1, (float("inf"),))[0]:
                        step[used + t + 1] = (c, [*ts, t])
            reach = step
        if tau + 1 in reach and reach[tau + 1][0] < best[0]:
            best = (reach[tau + 1][0], parts, reach[tau + 1][1])
    return best[1], best[2]


def _extract(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def probes(nodes: DataFrame, parts: list[list[int]], ts: list[int]) -> DataFrame:
    """``key``, ``fp`` rows: a fingerprint's exact and flipped values in each part."""

    def apply(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, (part, t) in enumerate(zip(parts, ts)):
                if t < 0:
                    continue
                value = _extract(fp, part)
                for flip in [0] if t == 0 else [0, *(1 << j for j in range(len(part)))]:
                    # Parts have at most 32 bits, so a key tells the part from the value.
                    key = (value ^ np.uint64(flip)) * np.uint64(len(parts)) + np.uint64(i)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(apply, "key long, fp long")


def split_hot(rows: DataFrame, parts: list[list[int]], tau: int) -> DataFrame:
    """``key``, ``fp`` rows in which no bucket holds many fingerprints that have only its own part in common.

    Two linked ones differ in ``tau`` of the other bits at most; of ``tau`` + 1 parts of these one is equal in both. So a
    bucket of over SPLIT_ROWS rows becomes the buckets of those parts' values, and no link is lost.
    """
    hot = rows.groupBy("key").count().where(F.col("count") > SPLIT_ROWS).select("key", F.lit(True).alias("hot"))
    hot = staged(hot, "hot", few=True)  # rows / SPLIT_ROWS at most
    n = hot.count()
    if not n:
        return rows
    met = join_grouped(rows, hot.withColumnRenamed("key", "k"), {"key": "k"}, n, F.col("fp"))
    others = [[b for b in range(BITS) if b not in part] for part in parts]
    finer = [[rest[len(rest) * i // (tau + 1) : len(rest) * (i + 1) // (tau + 1)] for i in range(tau + 1)] for rest in others]

    def apply(batches):
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            own = key.view(np.uint64) % np.uint64(len(parts))  # the part that the key is a value of
            for i, pieces in enumerate(finer):
                at = np.flatnonzero(own == i)
                for k, piece in enumerate(pieces):
                    value = _extract(fp[at], piece) * np.uint64(tau + 1) + np.uint64(k)
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(value.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["key", "v", "fp"])

    again = met.where("hot").select("key", "fp").mapInArrow(apply, "key long, v long, fp long").select(F.xxhash64("key", "v").alias("key"), "fp")
    return met.where("hot is null").select("key", "fp").unionByName(again)


def _forest(fp: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all links in one bucket: breadth first, each step compares one node to the unseen."""
    left, links = np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= tau
            if near.any():
                found = left[near].tolist()
                links += [(at, x) for x in found]
                queue += found
                left = left[~near]
    return links


def verified_links(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """``u`` < ``v``: links among the rows that share a key. Links of a bucket are a spanning forest at least."""

    def bucket_links(key, fp):
        edge = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.append(start, len(key)))
        a, c = [], []
        last = np.repeat(start + size, size)  # one past the bucket's end, for each row
        small = np.repeat(size <= SMALL_BUCKET, size)
        at = np.flatnonzero(small & (np.arange(len(key)) + 1 < last))
        step = 1
        while len(at):
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= tau]
            a.append(near)
            c.append(near + step)
            step += 1
            at = at[at + step < last[at]]
        for s, n in zip(start[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist()):
            own, first = np.unique(fp[s : s + n], return_index=True)
            links = np.array(_forest(own, tau), np.int64).reshape(-1, 2)
            a.append(s + first[links[:, 0]])
            c.append(s + first[links[:, 1]])
        x, y = (fp[np.concatenate(i)].view(np.int64) if i else np.zeros(0, np.int64) for i in (a, c))
        keep = x != y
        u, v = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def apply(batches):
        held = [np.zeros(0, np.int64)] * 2
        for b in batches:
            now = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            if cut:
                yield bucket_links(now[0][:cut], now[1][:cut].view(np.uint64))
            held = [x[cut:] for x in now]
        if len(held[0]):
            yield bucket_links(held[0], held[1].view(np.uint64))

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(apply, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is joined to, for every node of ``links`` (``u``, ``v``).

    Alternating large-star and small-star contractions (Kiveris et al. 2014): all links stay in tables, each round is
    written to the shared folder, and the links of a hub are only ever aggregated, not gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if large:  # every node's larger neighbours go to its smallest one
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        else:  # every node's smaller neighbours, and itself, go to the smallest one
            down = both.where("v < u")
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            out = down.join(least, "u").select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        return out.where("u < v").distinct()

    now, mark = staged(links.where("u < v").distinct(), "links", few=True), None
    while True:
        new = staged(star(star(now, True), False), "stars", few=True)
        unstage(now)
        now = new
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            break
        mark = state
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def near_duplicates(docs: DataFrame, *, tau: int = TAU) -> DataFrame:
    """``doc_id``, ``fp`` (long), ``text_hash``, ``component`` (its smallest fp) and ``component_id``: the smallest doc_id
    reachable over links of at most ``tau`` bits.

    Null and empty texts have fingerprint 0 and link like others; a null doc_id counts as the largest and comes back as
    null; repeated rows come back as often as given; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.count()
    own = staged(fingerprints(docs), "fingerprints", rows, texts=True)
    nodes = staged(own.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep")), "nodes", rows)
    n, both = bit_statistics(nodes)
    merged = nodes.withColumn("component", F.col("fp"))
    if n > 1:
        parts, ts = allocate(n, both, tau)
        rows_ = staged(probes(nodes, parts, ts), "probes", few=True)
        found = components(verified_links(split_hot(rows_, parts, tau), tau))
        joined = nodes.join(found.withColumnRenamed("component", "least"), nodes.fp == found.node, "left")
        merged = staged(joined.select("fp", "rep", F.coalesce("least", "fp").alias("component")), "merged", n)
    least = merged.groupBy("component").agg(F.min("rep").alias("id"))
    named = merged.select("fp", "component").join(least, "component")
    out = own.join(named, "fp").select(
        "doc_id", "fp", "text_hash", "component", F.when(F.col("id") != NO_ID, F.col("id")).alias("component_id")
    )
    return few_files(out, rows)


def simhash_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: one of the smallest doc_id, null counting as the largest."""
    groups = near_duplicates(docs)
    chosen = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.text_hash").alias("__hash"))
    same = docs.doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs.text) == F.col("__hash"))
    kept = docs.join(chosen, same, "left_semi")
    repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        kept = kept.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return few_files(kept, docs.count(), texts=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_documents(table(spark, sf_dir, "documents"))
