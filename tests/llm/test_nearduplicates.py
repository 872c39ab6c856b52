import random

import numpy as np

from docmill.llm import nearduplicates as nd

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=5, families=40):
    rng, texts = random.Random(seed), []
    for _ in range(families):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 90))]
        texts.append(words)
        for _ in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts.append(edited)
    return [" ".join(t) for t in texts]


def brute(rows, threshold):
    sets = []
    for key, title, body in rows:
        words = f"{title or ''} {body or ''}".lower().split()
        if len(words) >= 30:
            sets.append((key, set(zip(words, words[1:], words[2:]))))
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(x & y) / len(x | y) >= threshold}


def test_same_pairs_as_brute_force(spark):
    texts = corpus()
    rows = [(i, "Title" if i % 3 else None, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)]
    rows += [(1000, None, texts[0]), (1001, None, texts[0]), (1002, "short", "text"), (1003, None, None), (1004, None, "")]
    df = spark.createDataFrame(rows, "row_id bigint, section_title string, chunk_text string").selectExpr("*", "'x' as content", "'y' as id")
    found = nd.NearDuplicates(df, "row_id", "section_title", "chunk_text")
    pairs = found.pairs().collect()
    assert {(r["id_a"], r["id_b"]) for r in pairs} == brute(rows, 0.5) and len(pairs) == len(brute(rows, 0.5))
    groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows, 0.5):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert groups == {i: root(i) for i in parent}


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, section_title string, chunk_text string")
    found = nd.NearDuplicates(df, "row_id", "section_title", "chunk_text")
    assert found.pairs().collect() == [] and found.groups().collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 120).astype(np.uint64)
    x, y = np.arange(0, 90), np.arange(30, 120)
    wx, wy = rng.uniform(0.5, 3, 120), rng.uniform(0.5, 3, 120)
    shared = [sum(max((wx[j] / wx[i]) if j < 90 else 0, (wy[j] / wy[i]) if j >= 30 else 0) for j in range(120)) for i in range(30, 90)]
    expected = sum(1 / s for s in shared)
    owner = np.concatenate([np.zeros(90, np.int64), np.ones(90, np.int64)])
    got = nd.prob_minhash(owner, np.concatenate([items[x], items[y]]), 2, 4096, np.concatenate([wx[x], wy[y]]))
    assert abs(float((got[0] == got[1]).mean()) - expected) < 0.04
    plain = nd.prob_minhash(owner, np.concatenate([items[x], items[y]]), 2, 4096)
    assert abs(float((plain[0] == plain[1]).mean()) - 0.5) < 0.04


def test_band_partitions_follow_the_stated_size(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert nd.band_partitions(spark.createDataFrame([], "a string")) == least
    assert nd.band_partitions(spark.range(1 << 30)) == (8 << 30) * nd.BAND_SHARE // nd.PARTITION_BYTES
    assert nd.band_partitions(spark.createDataFrame(spark.sparkContext.emptyRDD(), "a string")) >= least
