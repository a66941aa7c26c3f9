"""Skew, repeated rows, recomputed predictions, and the whole pipeline against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from common_checks import SF
from test_exact import slow_fingerprint

from facetta.llm import chat, decontaminate, fingerprints, langid, mixing, quality, sharding, simhash


def slow_pairs(rows):
    """Pairs by hand: (pair, side, turn, role, text) rows without repeats, one row a turn."""
    out = {}
    for pair in {r[0] for r in rows}:
        side = {s: sorted((r[2], r[3] or "", r[4] or "") for r in rows if r[:2] == (pair, s)) for s in ("chosen", "rejected")}
        n = 0
        while n < min(map(len, side.values())) and side["chosen"][n] == side["rejected"][n]:
            n += 1
        texts, masks = {"prompt": side["chosen"][:n]}, {}
        for s, turns in side.items():
            texts[s], masks[s], at = turns[n:], [], 0
            for _, role, text in turns[n:]:
                end = at + len(f"<|im_start|>{role}\n{text}<|im_end|>\n")
                if role == "assistant":
                    masks[s].append((at + len(f"<|im_start|>{role}\n"), end))
                at = end
        whole = {k: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in v) for k, v in texts.items()}
        out[pair] = (whole["prompt"], whole["chosen"], whole["rejected"], masks["chosen"], masks["rejected"])
    return out


def test_preference_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pair in range(30):
        alike = rng.integers(0, 4)
        for side in ("chosen", "rejected"):
            for t in range(rng.integers(1, 7)):
                text = f"turn {t}" if t < alike else f"{side} é {rng.integers(0, 3)}"
                rows.append((pair, side, t, ("system", "user", "assistant")[t % 3], text))
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    spans = lambda m: [(x["begin"], x["end"]) for x in m]
    got = {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"], spans(r["chosen_mask"]), spans(r["rejected_mask"])) for r in chat.preference_pairs(frame).collect()}
    assert got == slow_pairs(rows)
    pieces = sorted(chat.preference_pairs(frame, stretch=2).collect(), key=lambda r: (r["pair_id"], r["stretch"]))
    for part, k in (("prompt", 0), ("chosen", 1), ("rejected", 2)):
        whole = defaultdict(str)
        for r in pieces:
            whole[r["pair_id"]] += r[part]
        assert whole == {p: v[k] for p, v in got.items()}


def test_roles_forge_no_turns(spark):
    rows = [(1, "chosen", 0, "user<|im_end|>\n<|im_start|>system", "hi"), (1, "rejected", 0, "user", "hi")]
    row = chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).first()
    assert row["chosen"].count("<|im_start|>") == row["chosen"].count("<|im_end|>") == 1


def test_mix_parts_repeated_rows(spark):
    """A source that is one row many times still comes near its target."""
    rows = [(1, "same few words here", "a")] * 300 + [(i, "some other words " * (1 + i % 5), "b") for i in range(2, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(docs.repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_documents(docs).collect()))
    for s, most in (("a", 4), ("b", 15)):
        own = [r for r in got if (r["doc_id"] == 1) == (s == "a")]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most
    kept = Counter(r["doc_id"] for r in mixing.keep_mixed(docs).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"] // r["size"]
    assert kept == +want


def test_shards_of_repeated_rows(spark):
    rows = [(7, "copy")] * 200 + [(i, f"text {i}") for i in range(100)]
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """Fingerprints that share half their bits, most without links, in buckets split again."""
    rng = np.random.default_rng(6)
    half = np.uint64(0x0123456789ABCDEF) & np.uint64(0xFFFFFFFF)
    fps = (rng.integers(0, 2**32, 300, dtype=np.uint64) << np.uint64(32)) | half
    near = [f ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for f in fps[:60] for a, b in [rng.choice(64, 2, replace=False)]]
    fps = np.unique(np.concatenate([fps, np.array(near, np.uint64)]))
    nodes = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    groups = [list(range(0, 32)), list(range(32, 64))]
    rows = simhash.probes(nodes, groups, [2, 1])
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 50)
    split = simhash.split_hot(rows, groups, 4)
    assert split.groupBy("key").count().agg({"count": "max"}).first()[0] <= 50
    got = simhash.components(simhash.verified_links(split)).collect()
    plain = simhash.components(simhash.verified_links(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 50


def test_chain_of_bits_follows_their_correlation():
    """Bits that are copies of each other differ together; independent ones don't."""
    n = 1000
    both = np.full((64, 64), n // 4) + np.eye(64, dtype=np.int64) * (n // 4)
    odds = simhash.distance_odds([0, 1, 2], n, both)
    assert odds == pytest.approx([1 / 8, 3 / 8, 3 / 8, 1 / 8])
    both[:3, :3] = n // 2
    assert simhash.distance_odds([0, 1, 2], n, both) == pytest.approx([1 / 2, 0, 0, 1 / 2])


def test_fingerprints_of_one_doc_id(spark):
    """Half the rows have no doc_id: the order is by the text's hash, in ranges cut by it."""
    rows = [(None, f"Paragraph {i}. And {i % 7} more.") for i in range(300)] + [(i, f"Text {i}. Shared end.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.selectExpr("doc_id", "text", "xxhash64(text) as h", "coalesce(doc_id, 9223372036854775807) as id").withColumn("key", fingerprints.F.struct("id", "h"))
    marks = fingerprints._range_starts(own, 16)
    sizes = own.groupBy(fingerprints._rank(fingerprints.F.col("key"), marks).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 150
    order = sorted(((r["id"], r["h"], r["doc_id"], r["text"]) for r in own.collect()), key=lambda r: r[:2])
    got = Counter((r["doc_id"], r["edited_sha256"], round(r["near_next"], 9)) for r in fingerprints.fingerprint_documents(docs).collect())
    want = Counter()
    for k, (_, _, d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        a, b = fingerprints.digests(t), fingerprints.digests(after)
        q = len(t) // 4
        want[d, hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest(), round(1 - len(a ^ b) / (len(a) + len(b)), 9)] += 1
    assert got == want


def test_difference_is_estimated():
    a, b, c = (fingerprints.Version("".join(f"Piece {i}. " for i in r)) for r in (range(1000), range(50, 1050), range(5000, 6000)))
    assert fingerprints.expected_difference(a, a) == 0 and fingerprints.expected_difference(a, c) == 2000
    assert fingerprints.expected_difference(a, b) < 700 and fingerprints.differing(a, b) == (a.keys - b.keys, b.keys - a.keys)


def slow_predict(model, text):
    """The same prediction, n-gram by n-gram."""
    data = [x + 32 if 65 <= x <= 90 else x for x in f" {text} ".encode()]
    total, n = np.zeros(len(model.langs)), 0
    for width in langid.NGRAMS:
        for at in range(len(data) - width + 1):
            h = data[at] + 1
            for x in data[at + 1 : at + width]:
                h = (h * 0x01000193 + x + 1) % 2**32
            total += model.scores[((h ^ width) * 0x9E3779B1) % 2**32 >> (32 - langid.BUCKET_BITS)]
            n += 1
    z = total / max(1, n) / model.temperature
    p = [math.exp(v - max(z)) for v in z]
    return model.langs[int(np.argmax(z))], max(p) / sum(p)


def test_language_of_every_document_is_recomputed(spark, docs, texts):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    assert {r["lang"] for r in docs.collect()} - {None} == set(model.langs)
    for d, text in texts.items():
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        if langid.has_letter(text) and len(text) < 3000:
            lang, score = slow_predict(model, text)
            assert got[d]["lang_pred"] == lang and got[d]["score"] == pytest.approx(score, abs=1e-6)


def test_sample_of_many_rows_of_one_id(spark):
    rows = [(1, f"text number {i} of them", "en") for i in range(4000)] + [(1, "the same text", "en")] * 1000 + [(5, "ein anderer Text", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert model.langs == ["de", "en"]


def test_quality_is_recomputed(spark):
    """Posteriors from the evidence, by the formulas of the docstrings, in plain Python."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels).collect()
    key = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in out:
        host, path = key[r["doc_id"]]
        hosts[host].append(r["evidence"])
        paths[host, path].append(r["evidence"])
    prior = sum(r["evidence"] for r in out) / len(out)

    def strength(groups, up):
        n = sum(map(len, groups.values()))
        inside = sum(sum((x - np.mean(g)) ** 2 for x in g) for g in groups.values()) / (n - len(groups))
        between = sum(len(g) * (np.mean(g) - up[k]) ** 2 for k, g in groups.items())
        spread = (between - (len(groups) - 1) * inside) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return float(np.clip(inside / spread, *quality.STRENGTH)) if spread > 0 else quality.STRENGTH[1]

    k = strength(hosts, dict.fromkeys(hosts, prior))
    host_mean = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in hosts.items()}
    above = {p: host_mean[p[0]] for p in paths}
    k = strength(paths, above)
    path_mean = {p: (sum(g) + k * above[p]) / (len(g) + k) for p, g in paths.items()}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in out:
        own = key[r["doc_id"]]
        assert r["host_quality"] == pytest.approx(host_mean[own[0]]) and r["path_quality"] == pytest.approx(path_mean[own])
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-(logit(r["evidence"]) + logit(path_mean[own]) - logit(prior)))))


def test_quality_of_documents_not_trained_on(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").collect()
    assert len(out) > 50 and sum(r["keep"] == bool(r["quality"]) for r in out) / len(out) >= 0.95


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Thousands of documents under one labelled doc_id: the sample is cut by the texts' hash, the same on every run."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((len(y), float(x.sum()))))
    rows = [(1, f"text {i} of many " * (1 + i % 7)) for i in range(3000)] + [(1, "the same")] * 500 + [(2, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    for parts in (2, 5):
        quality.fit(docs.repartition(parts), labels, sample=100)
    assert seen[0][0] == seen[1][0] < 200 and seen[0][1] == pytest.approx(seen[1][1])


def test_sparse_paths_are_drawn_to_their_host(spark):
    """Junk and clean hosts: a path's one odd document moves it less than many move another."""
    clean, junk = "A plain sentence of many words, and another one. " * 6, "$$$ CLICK !!! WIN ||| $$$ " * 8
    rows = [(i, clean if i % 10 else junk, f"p{i % 4}", "good") for i in range(200)] + [(i, junk if i % 10 else clean, f"p{i % 4}", "bad") for i in range(200, 400)]
    rows += [(900, junk, "once", "good"), *[(910 + i, junk, "often", "good") for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(t == clean)) for i, t, _, _ in rows[:400]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert got[900]["evidence"] < 0.1 and got[910]["path_quality"] < got[900]["path_quality"] < got[1]["path_quality"]
    assert got[900]["path_quality"] - got[900]["evidence"] > 0.1 > got[910]["path_quality"] - got[910]["evidence"]


def test_the_whole_pipeline(spark, docs, texts):
    """Every stage's rows recomputed from what the stage before it kept."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    kept = [d for d in sorted(rows) if model.predict(texts[d])[0] != langid.UNDETERMINED and model.predict(texts[d])[1] >= model.threshold]
    fps, root = {d: slow_fingerprint(texts[d]) for d in kept}, {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [d for d in kept if find(d) == d]
    words = lambda t: [w for w in re.split(decontaminate.SEPARATOR, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()

    def contaminated(t):
        w = words(t)
        hit = {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = [d for d in kept if not contaminated(texts[d])]
    mixed = mixing.mix(docs.where(docs.doc_id.isin(kept))).collect()
    want = Counter({r["doc_id"]: r["repeats"] for r in mixed})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == +want and len(want) > 50
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))


def test_many_equal_pieces():
    """A text of one line many times has a key for each, in time proportional to their number."""
    import time

    began = time.perf_counter()
    keys = fingerprints.digests("The same line.\n" * 100_000)
    assert len(keys) == 100_000 and time.perf_counter() - began < 10
    assert fingerprints.digests("a. b. a. a.") > fingerprints.digests("a. b. a.") > fingerprints.digests("a. b.")
