"""Operators against brute force on the small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from common_checks import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from facetta.llm import fingerprints, langid, mixing, oracle, queries, sharding, simhash, suffixes


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_decontamination_of_extremes(spark, duck):
    from facetta.llm.decontaminate import contamination, digested

    docs = [(1, "A b, C"), (2, "x a b c y a b c"), (3, None), (4, "a b"), (5, "Müller über alle " * 3), (6, " ".join("abcdefghijklmnopqrst") + " z")]
    items = [(10, "a B c"), (9, "über ALLE"), (8, None), (7, "..."), (11, " ".join("abcdefghijklmnopqrst"))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    same_rows(digested(contamination(d, b)), c, oracle.OP3)
    row = contamination(d, b).where("doc_id = 2").first()
    assert row["item_ids"] == ["10"] and [tuple(h) for h in row["hits"]] == [(1, 4), (5, 8)]


def test_decontamination_in_blocks(spark, duck, monkeypatch):
    from facetta.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    same_rows(decontaminate.op3_decontamination(spark, SF), duck, oracle.OP3)


def test_sharding_is_balanced_and_repeatable(spark, docs, texts):
    a, b = (sharding.shard_documents(d).collect() for d in (docs, docs.repartition(7)))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in a} == {(r["doc_id"], r["shard"], r["slot"]) for r in b}
    shards = defaultdict(list)
    for r in a:
        shards[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["law"], r["grown_shard"]) == (len(raw) + 1, "rows", None)
        import zlib

        assert r["text_crc32"] == zlib.crc32(raw)
    assert set(shards) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_sharding_of_one_repeated_row(spark):
    rows = spark.range(5000).selectExpr("7 as doc_id", "'t' as text")
    out = sharding.shuffle_into_shards(rows, shards=3, bucket_rows=100).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [1666, 1667, 1667]


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    assert spark.read.parquet(f"file://{tmp_path}/out").groupBy("shard").count().count() == 4
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


def test_sharding_moves_whole_documents(spark, docs, monkeypatch):
    """The documents' own columns go through both passes, in buckets that their texts' bytes bound."""
    held = []
    keep = lambda df, tag, *a, **k: (held.append(df.persist()) if tag == "scatter" else None) or df
    monkeypatch.setattr(sharding, "staged", keep)
    sharding.shard_documents(docs).collect()
    assert set(docs.columns) <= set(held[0].columns)
    sharding.shuffle_into_shards(docs, bucket_bytes=2000).collect()
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert held[1].agg({"__bucket": "max"}).first()[0] >= 0.9 * total / 2000 > sharding.MIN_BUCKETS


def removed(rows):
    """Brute force: every window of every text, counted."""
    raw = {d: (t or "").encode() for d, t in rows}
    seen = Counter(w[i : i + 400] for w in raw.values() for i in range(len(w) - 399))
    out = {}
    for d, w in raw.items():
        hit = np.zeros(len(w) + 1, int)
        for i in range(len(w) - 399):
            if seen[w[i : i + 400]] > 1:
                hit[i] += 1
                hit[i + 400] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(w, np.uint8)[~gone])
        out[d] = (len(w), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def suffix_result(frame):
    return {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["begin"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in frame.collect()}


def test_suffix_dedup(spark, docs, texts):
    assert suffix_result(suffixes.remove_repeats(docs)) == removed(texts.items())


def test_suffix_dedup_of_borders(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    p, long = word(600), word(1500)
    rows = [
        (1, word(300) + p[:399] + word(300)), (2, word(20) + p[:450]), (3, p + word(900)), (4, "ab" * 700), (5, "z" * 400), (6, "z" * 401), (7, long), (8, long), (9, long[1:]),
        (10, word(50) + long[100:520] + word(90) + long[700:1150]), (11, word(5000)), (12, "q" + word(399)), (13, (word(100) + "\n") * 9), (14, None), (15, ""),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_result(suffixes.remove_repeats(frame)) == removed(rows)


def test_suffix_dedup_gives_what_is_left(spark):
    shared = "".join(np.random.default_rng(8).choice(list("xyzü é"), 700))
    rows = [(1, "é" + shared + "è tail one"), (2, "ä" + shared + "é tail two"), (3, "nothing shared")]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        raw, at, whole = text.encode(), 0, ""
        for run in [*got[d]["removed"], None]:
            whole += raw[at : run["begin"] if run else None].decode("utf-8", "ignore")
            at = run["end"] if run else 0
        assert got[d]["kept"] == whole and "\ufffd" not in whole
    assert got[1]["kept"].startswith("é") and got[1]["kept"].endswith(" tail one") and got[3]["kept"] == "nothing shared"


@pytest.mark.parametrize("hot", [[], [1], [1, 2]])
def test_suffixes_of_all_strings_in_order(spark, hot):
    """Sorted triples, recursion and the merge against plain sorting, with runs of one symbol and equal strings."""
    rng = np.random.default_rng(3)
    sym = [[int(x) for x in rng.integers(1, 4, rng.integers(1, 14))] for _ in range(60)] + [[1] * 40, [1] * 38, [2, 1] * 15, [1], [2]]
    frame = spark.createDataFrame(list(enumerate(sym)), "sid long, syms array<long>")
    got = suffixes.all_ranks(frame, 10_000, hot).collect()
    order = sorted((rank, tuple(sym[r["sid"]][j:])) for r in got for j, rank in enumerate(r["ranks"]))
    assert all(x[1] == y[1] for x, y in zip(order, order[1:]) if x[0] == y[0])  # equal suffixes may tie
    tails = [t for _, t in order]
    assert tails == sorted(tails)


def test_suffix_dedup_with_frequent_phrases(spark, docs, texts, monkeypatch):
    """Every phrase that comes more than twice is ordered over all tasks, in the recursion too."""
    monkeypatch.setattr(suffixes, "hot_limit", lambda spark, n: 2)
    assert suffix_result(suffixes.remove_repeats(docs)) == removed(texts.items())


def test_suffix_dedup_sends_the_driver_few_keys(spark, monkeypatch):
    """Beyond BROADCAST_TEXTS only texts with more rows than a task's share are broadcast; no row is multiplied."""
    monkeypatch.setattr(suffixes, "BROADCAST_TEXTS", 10)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    pairs = [word(500) for _ in range(60)]
    texts = [*[word(700)] * 40, *pairs, *pairs, *[p[:450] + word(30) for p in pairs[:30]], *[word(450) for _ in range(20)], *[""] * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffixes.remove_repeats(frame)
    assert suffix_result(out) == removed(enumerate(texts))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no rows times SALT
    keys = spark.createDataFrame([(k, 50 if k < 2 else 1) for k in range(100)], "did long, copies long")
    rows = spark.range(300).selectExpr("id % 150 AS did", "id")
    for how, n in (("left_semi", 200), ("left_anti", 100)):
        got = suffixes._having(rows, keys, 100, 10, how)
        assert got.count() == n and {r["did"] < 100 for r in got.collect()} == {how == "left_semi"}


def test_broadcasts_of_texts_fit_the_driver():
    """A million keys took up to 177 MB of a heap of 750; two lists are held at a time."""
    assert 2 * suffixes.BROADCAST_TEXTS * 177 < 0.1 * 750e6


def test_fingerprints(spark, docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs.repartition(5)).collect()}
    ids = sorted(texts)
    for k, d in enumerate(ids):
        t, after = texts[d], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (fingerprints.digests(x) for x in (t, e, after))
        share = lambda x, y: 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0
        assert r["near_edited"] == pytest.approx(share(a, b)) and r["near_next"] == pytest.approx(share(a, c))
    prints = {d: got[d]["fingerprint"] for d in ids}
    assert all((texts[a] != texts[b]) or prints[a] == prints[b] for a in ids for b in ids)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_sketches_recover_differences(a, b, both):
    x, y = fingerprints.Version(""), fingerprints.Version("")
    key = lambda h: (h >> 20) << 20 | (h >> 20) * fingerprints._CHECK >> 30 & 0xFFFFF
    x.keys, y.keys = ({key(h) for h in s | both} for s in (a, b))
    assert fingerprints.differing(x, y) == (x.keys - y.keys, y.keys - x.keys)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, texts):
    got = {r["doc_id"]: r for r in simhash.simhash_documents(docs).collect()}
    ids = sorted(texts)
    fps = {d: slow_fingerprint(texts[d]) for d in ids}
    assert all(int(got[d]["fingerprint"], 16) == fps[d] and len(got[d]["fingerprint"]) == 16 for d in ids)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got[d]["component_id"] == find(d) for d in ids)


@pytest.mark.parametrize("parts, ts", [(5, [0] * 5), (4, [1, 0, 0, 0]), (3, [1, 1, 0]), (3, [2, 0, 0]), (2, [2, 1])])
def test_every_allocation_finds_all_links(spark, parts, ts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for _ in range(4):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.append(np.bitwise_xor.reduce([b, *(np.uint64(1) << np.uint64(k) for k in flips)]))
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    both = np.eye(64, dtype=np.int64) * (len(fps) // 2)
    groups = simhash.group_bits(len(fps), both, parts)
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t + 1 for t in ts) == 5
    got = {(r["u"], r["v"]) for r in simhash.verified_links(simhash.probes(nodes, groups, ts)).collect()}
    want = {tuple(sorted((int(a.view(np.int64)), int(b.view(np.int64))))) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4}
    assert got == want


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64) ^ rng.integers(0, 2**10, 300).astype(np.uint64))
    links = simhash._forest(fp, 4)
    assert len(links) == len(fp) - 1 and all(int(fp[a] ^ fp[b]).bit_count() <= 4 for a, b in links)


def test_components_of_a_long_path(spark):
    n = 40
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200)], "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(1, n + 1)}, 200: 100}


def test_allocation_is_cheap():
    both = np.full((64, 64), 250_000, np.int64) + np.eye(64, dtype=np.int64) * 250_000
    for n in (1_000, 1_000_000, 100_000_000):
        parts, ts = simhash.allocate(n, both * n // 1_000_000)
        assert sum(t + 1 for t in ts) == 5 and sorted(b for p in parts for b in p) == list(range(64))


def test_mixing(spark, docs, texts):
    rows = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(6)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    names = sorted(size)
    want = dict(zip(names, mixing.targets_for([(s, size[s]) for s in names])))
    assert target == pytest.approx(want)
    largest = {s: max(r["size"] for r in rows if source[r["doc_id"]] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


def test_targets():
    assert mixing.targets_for([("a", 100), ("b", 100), (None, 100)]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets_for([]) == [] and mixing.targets_for([("a", 0)]) == [0.0]
    assert sum(mixing.targets_for([("a", 1), ("b", 1000), ("c", 5)])) == pytest.approx(1.5 * 1006)


def test_language_id(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.identify_documents(docs).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) >= 0.98
    assert sum(r["accepted"] for r in rows) / len(rows) >= 0.99


def test_language_id_rejects(spark, docs):
    model = langid.fit(docs)
    assert model.predict(None) == ("und", 0.0) and model.predict("123 !! ²") == ("und", 0.0) and model.predict("") == ("und", 0.0)
    lang, score = model.predict("これは日本語の文章です。学習したことのない言語です。")
    assert lang in model.langs and score < model.threshold
    text = "The " * 5
    assert model.predict(text)[0] in model.langs
