"""op12: fingerprints and components against comparisons of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from .helpers import awkward, frame, prose


def plain_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, most=3):
    """doc_id -> least doc_id reachable; nodes are (doc_id, fingerprint)."""
    up = {d: d for d, _ in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[i + 1 :]:
            if (x ^ y).bit_count() <= most:
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d in up}


def test_simhash(spark):
    from cellweave.llm.simhash import simhash_duplicates

    rng = random.Random(3)
    rows = awkward(90, seed=4)
    base = prose(rng, 400).split()
    for i in range(40):  # near copies, a few words apart
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(400)] = "changed" + str(rng.randrange(9))
        rows.append((2000 + i, " ".join(words), "en", "hot", *[None] * 7))
    rows += [(2000, "one doc_id twice", "en", "hot", *[None] * 7)]
    docs = frame(spark, rows)
    out = simhash_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows if r[0] is not None])
    assert sorted((r.doc_id or -1, r.fingerprint) for r in out) == sorted((r[0] or -1, f"{plain_fingerprint(r[1]):016x}") for r in rows)
    for r in out:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    assert len({want[d] for d in range(2000, 2040)}) < 40
    assert simhash_duplicates(docs.limit(0)).collect() == []


def test_hashes_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    from cellweave.llm.simhash import shingle_hashes

    got = np.concatenate(list(shingle_hashes("Der Übér  fluß\tist A\x0bb c".encode(), 3)))
    texts = ["der Übér fluß", "Übér fluß ist", "fluß ist a", "ist a b c"]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got.view(">i8").ravel().tolist() == want


@pytest.mark.parametrize("leaf, joined", [(4096, None), (8, None), (8, 2)])
def test_links_of_clusters(spark, monkeypatch, leaf, joined):
    """Dense clusters, chains and strangers; small leaves, so that buckets are dealt anew, and wide parts with probes."""
    from cellweave.llm import simhash as S
    from cellweave.llm.components import components

    monkeypatch.setattr(S, "LEAF", leaf)
    if joined:
        monkeypatch.setattr(S, "cheapest", lambda distinct, bits, counts, most: S.Index(bits, counts, joined, most))
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(4):
        center = int(rng.integers(0, 1 << 63))
        loose = rng.choice(64, 9, replace=False)
        fps |= {center ^ sum(1 << int(b) for b in rng.choice(loose, rng.integers(0, 5), replace=False)) for _ in range(60)}
    chain = int(rng.integers(0, 1 << 63))
    for _ in range(30):
        fps.add(chain)
        for b in rng.choice(64, 3, replace=False):
            chain ^= 1 << int(b)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 150)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, id long")
    got = {r["id"]: r.comp for r in components(S.links(nodes, 3)).collect()}
    want = plain_components(list(zip(signed, fps, strict=True)))
    assert {x: got.get(x, x) for x in signed} == want


def test_thresholds_are_the_cheapest():
    from itertools import product
    from math import comb

    from cellweave.llm.simhash import GROUPS, ROW_COST, WIDTH, Index

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (GROUPS, 1 << WIDTH)) * (rng.random((GROUPS, 1 << WIDTH)) < 0.01)
    counts[0, 77] = 90_000
    for joined in (1, 2):
        index = Index(np.arange(64).reshape(4, 16), counts, joined, 3)
        candidates = rng.integers(0, 60_000, (index.parts, 4, 25)).cumsum(1).astype(float)
        t, cost = index.thresholds(candidates)
        balls = np.cumsum([comb(index.width, r) for r in range(4)])
        price = lambda i, r, k: 0 if r < 0 else candidates[i, r, k] + ROW_COST * balls[r]
        for k in range(25):
            every = [x for x in product(range(-1, 4), repeat=index.parts) if sum(x) == 3 - index.parts + 1]
            assert cost[k] == min(sum(price(i, r, k) for i, r in enumerate(x)) for x in every)
            assert cost[k] == sum(price(i, r, k) for i, r in enumerate(t[:, k].tolist())) and t[:, k].sum() == 4 - index.parts


def test_counts_at_a_distance():
    from cellweave.llm import simhash as S

    rng = np.random.default_rng(2)
    counts = np.zeros((S.GROUPS, 1 << S.WIDTH), np.int64)
    counts[:, rng.integers(0, 1 << S.WIDTH, 300)] = rng.integers(1, 9, 300)
    near = S.at_distance(counts, 3)
    for v in rng.integers(0, 1 << S.WIDTH, 20).tolist():
        apart = np.bitwise_count(np.arange(1 << S.WIDTH) ^ v)
        assert near[1, :, v].tolist() == [counts[1][apart == r].sum() for r in range(4)]


def test_correlated_bits_share_a_group():
    from cellweave.llm.simhash import grouped_bits

    rng = np.random.default_rng(3)
    causes = rng.random((4000, 4)) < 0.5
    deal = rng.permutation(64)
    bits = np.zeros((4000, 64))
    for k, b in enumerate(deal):
        bits[:, b] = causes[:, k // 16] ^ (rng.random(4000) < 0.1)
    got = grouped_bits(bits.T @ bits, 4000)
    assert {frozenset(g) for g in got.tolist()} == {frozenset(deal[k : k + 16].tolist()) for k in range(0, 64, 16)}


def test_pieces_part_the_varying_bits():
    from cellweave.llm.simhash import pieces

    varying = np.array([0, 1, 0b1011, (1 << 64) - 1, 0xF0F0F0F0F0], np.uint64)
    got = pieces(varying, 4)
    for v, row in zip(varying.tolist(), got.tolist(), strict=True):
        assert sum(row) == v and max(x.bit_count() for x in row) - min(x.bit_count() for x in row) <= 1
