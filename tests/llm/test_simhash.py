"""SimHash near-duplicates against all pairs of plain fingerprints."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from pitwall.llm import simhash
from pitwall.llm.components import components

SF = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(rb"[^\x20\x09-\x0D]+", low.encode())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(values):
    """The least place reachable from each."""
    a = np.array(values, np.uint64)
    up = list(range(len(a)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            p, q = top(i), top(int(j))
            up[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(a))]


def result(df):
    return [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]


def test_documents_equal_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(df.select("doc_id", "text").collect())
    ids = sorted(texts)
    values = [plain(texts[i]) for i in ids]
    least = all_pairs(values)
    assert sorted(result(df)) == [(i, f"{v:016x}", ids[least[k]]) for k, (i, v) in enumerate(zip(ids, values, strict=True))]


@pytest.mark.parametrize("bucket", [4096, 6])
def test_links_of_crowded_rings_equal_all_pairs(spark, monkeypatch, bucket):
    """Chains and dense groups; with tiny buckets every group goes through those of three segments."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    pick = random.Random(5)
    base = [pick.getrandbits(64) for _ in range(60)]
    values = set()
    for k in range(1200):
        value = base[pick.randrange(4 if k % 2 else 60)]
        for bit in pick.sample(range(64), pick.randrange(9)):
            value ^= 1 << bit
        values.add(value)
    step = 1
    for bit in range(0, 60, 3):  # a chain, each link three bits
        step ^= 7 << bit
        values.add(step)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    got = dict(tuple(r) for r in components(simhash.links(df)).collect())
    labels = {}
    for k, top in enumerate(all_pairs(values)):
        labels.setdefault(top, set()).add(got.get(signed[k], signed[k]))
    assert all(len(x) == 1 for x in labels.values())
    assert len(set.union(*labels.values())) == len(labels)


def test_every_close_pair_keeps_the_chain_budgets():
    pick = random.Random(2)
    for _ in range(2000):
        gap = sum(1 << b for b in pick.sample(range(64), pick.randrange(4)))
        rings = [int(simhash._turned(np.array([gap], np.uint64), s)[0]) for s in range(4)]
        assert any(r >> 48 == 0 and (r >> 32).bit_count() <= simhash.TWO and (r >> 16).bit_count() <= simhash.THREE for r in rings)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "a b"), (6, "a b"), (7, long), (None, "one"), (8, "É x\x1fy z")]
    df = spark.createDataFrame([(i, t, "f", "k", "n") for i, t in rows], "doc_id long, text string, fp string, key string, node string")
    got = result(df)
    assert sorted((i or 0, f) for i, f, _ in got) == sorted((i or 0, f"{plain(t):016x}") for i, t in rows)
    component = {i: c for i, _, c in got}
    assert {component[i] for i in (1, 2, 3)} == {1} and component[5] == 4 and component[6] == 6 and component[None] is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0
