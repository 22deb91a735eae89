"""Joins and components against brute force."""

import random
import re

import numpy as np
import pytest

from lattica.llm import embedding_dedup, jaccard_join
from lattica.llm.components import connected_components


def brute_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 450)] + [(500, k) for k in range(501, 560)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == brute_components(nodes, pairs)
    assert connected_components(df.limit(0)).count() == 0


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked(a, b):
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= 75 * (len(a) + len(b) - common)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = ["", None, " \n ", "É é", "é É"]
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 80, 120, 300] * 8:
        base = [rng.choice(vocabulary) for _ in range(size)]
        if size > 100 and rng.random() < 0.5:
            base[10:10] = passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                k, i = rng.randrange(3), rng.randrange(len(words)) if words else 0
                if k == 0 and words:
                    words[i] = rng.choice(vocabulary)
                elif k == 1 and words:
                    del words[i]
                else:
                    words.append(rng.choice(vocabulary))
            texts.append("\t".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    big = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(120):
        words = list(big)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


#: Plain; many targets and blocks; targets cut into pieces that overflow; too few parts at first.
WAYS = {"plain": {}, "targets": {"part_mb": 0.02, "block_docs": 32}, "pieces": {"part_mb": 0.01, "targets": 3, "held": 300, "block_docs": 16}, "few parts": {"scale": 0.2}}


@pytest.mark.parametrize("way", WAYS)
def test_jaccard_components_equal_brute_force(spark, way):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    sets = [shingles(t) for t in texts]
    pairs = [(ids[i], ids[j]) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])]
    expected = brute_components(ids, pairs)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)] + [(None, "a b c", "x")], "doc_id long, text string, component_id string")
    rows = jaccard_join.jaccard_components(df, **WAYS[way]).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] is not None} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]


def test_a_chain_of_hubs_and_shared_passages(spark):
    """Sets that share signatures along a chain, none of whose far ends link, and lists whose members link past their hub."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    text = words[:150]
    texts = []
    for k in range(60):  # each step changes a few words: neighbours link, distant ones don't
        texts.append(" ".join(text))
        for i in rng.sample(range(150), 3):
            text[i] = rng.choice(words)
    shared = [rng.choice(words) for _ in range(40)]
    for _ in range(40):  # a passage that all share, linked in pairs only
        own = [rng.choice(words) for _ in range(40)]
        texts += [" ".join(shared + own), " ".join(shared + own + [rng.choice(words)])]
    short = [rng.choice(words) for _ in range(9)]
    for _ in range(60):
        texts.append(" ".join(short + [rng.choice(words) for _ in range(rng.randrange(3))]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets = [shingles(t) for t in texts]
    expected = brute_components(ids, [(ids[i], ids[j]) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])])
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, block_docs=8).collect()}
    assert found == expected


def test_jaccard_repeats_and_nothing(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(4, t), (4, t), (2, t + " more"), (9, None), (9, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert rows == [(2, 2), (4, 2), (4, 2), (9, 9), (9, 9)]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 4, 6, 9, 13, 41, 48, 62, 100, 211, 1000])
def test_allocation_bounds_the_difference(size):
    """Whatever linked partner a set has, both index a common band, and need covers their difference."""
    for other in range(-(-size * 3 // 4), size * 4 // 3 + 1):
        shared = {k for k, _ in jaccard_join.memberships(size)} & {k for k, _ in jaccard_join.memberships(other)}
        assert shared
        which = {k: w for k, w in jaccard_join.memberships(size)}
        assert any(jaccard_join.needed(size, which[k]) > jaccard_join.differ(size, other) for k in shared)


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**60, 80, dtype=np.uint64)
    sets = []
    for _ in range(90):
        keep = base[rng.random(80) < rng.uniform(0.6, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**60, rng.integers(0, 12), dtype=np.uint64)])))
    links = jaccard_join.block_links(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            assert links[i, j] == (i != j and 100 * common >= 75 * (len(a) + len(b) - common))


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(300, 16))
    rows = [list(map(float, c)) for c in centres]
    for c in centres[:60]:
        rows += [list(map(float, c + rng.normal(size=16) * s)) for s in (0.02, 0.1, 0.2)]
    rows += [list(map(float, centres[0] + rng.normal(size=16) * 0.02)) for _ in range(150)]
    rows += [rows[5]] * 40 + [[2 * x for x in rows[6]]]
    return rows


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    ids = list(range(10, 10 + len(rows)))
    random.Random(2).shuffle(ids)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    expected = brute_components(ids, pairs)
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [None] + [1.0] * 15), (6, [float("inf")] * 16), (7, [1.0] * 3), (None, rows[5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*zip(ids, rows, strict=True), *odd]], "vec_id long, embedding array<double>, component_id int")
    found = embedding_dedup.near_duplicates(df, block=32).collect()
    assert len(found) == len(rows) + len(odd)
    got = {r["vec_id"]: r for r in found}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(1, 8))
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, close.sum(1), strict=True))
    assert sum(got[i]["n_links"] for i in ids) >= 0.99 * close.sum()
    assert np.mean([got[i]["component_id"] == expected[i] for i in ids]) >= 0.99
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_more_shared_bits_need_more_passes():
    assert embedding_dedup.passes_for({}) == 1
    assert embedding_dedup.passes_for({2: 100}) < embedding_dedup.passes_for({12: 100}) < embedding_dedup.passes_for({12: 50, 20: 50})


def test_window_edges_connect_what_all_candidates_connect():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    codes = np.concatenate([centres, np.repeat(centres[:4], [3, 8, 40, 200], axis=0)])
    flips = rng.integers(0, 128, (len(codes), 9))
    for row, some in zip(codes, flips, strict=True):
        for f in some[: rng.integers(0, 9)].tolist():
            row[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
    new, old = codes[::2], codes[1::2]
    i, j, dense = embedding_dedup.window_edges(new, old, 12)
    both = np.concatenate([new, old])
    near = np.bitwise_count(both[:, None] ^ both[None]).astype(int).sum(2) <= 12
    nodes = list(range(len(both)))
    all_pairs = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b and a < len(new)]
    assert all(near[a, b] and a != b for a, b in zip(i, j, strict=True)) and dense > 50
    assert brute_components(nodes, zip(i.tolist(), j.tolist(), strict=True)) == brute_components(nodes, all_pairs)
    assert len(i) < 4 * len(both)


def test_large_components_are_counted_exactly(spark):
    """A core, a fringe, tiles of a few rows, copies, and a component without a core."""
    rng = np.random.default_rng(8)
    near = lambda c, s, n: c + rng.normal(size=(n, 24)) * s
    a, b = rng.normal(size=24), rng.normal(size=24)
    rows = np.concatenate([near(a, 0.1, 150), near(a, 0.42, 80), near(b, 0.3, 120)]).astype(np.float32)
    x = rows / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    copies = rng.integers(1, 4, len(rows))
    classes = spark.createDataFrame([(i, int(c), bytearray(r.tobytes())) for i, (c, r) in enumerate(zip(copies, rows, strict=True))], "rep long, copies long, raw binary")
    labels = spark.createDataFrame([(i, 0 if i < 230 else 230) for i in range(len(rows))], "node long, component long")
    within = np.array([[(i < 230) == (j < 230) for j in range(len(rows))] for i in range(len(rows))])
    expected = (close & within) @ copies
    for tile_mb, small in ((16.0, 2048), (0.004, 2048), (0.03, 60)):
        found = {r["node"]: r["others"] for r in embedding_dedup.link_counts(labels, classes, 0.9, "<f4", tile_mb, small).collect()}
        assert [found.get(i, 0) for i in range(len(rows))] == expected.tolist()


def test_ranges_windows_and_dense_runs(spark):
    """Many ranges a pass, and a dense run longer than a window and a range: recall against brute force."""
    rng = np.random.default_rng(1)
    loose = rng.normal(size=(2500, 32))
    pairs = np.concatenate([loose[:700] + rng.normal(size=(700, 32)) * 0.3, loose[:100] + rng.normal(size=(100, 32)) * 0.05])
    run = loose[900] + rng.normal(size=(1500, 32)) * 0.1
    rows = np.concatenate([loose, pairs, run]).astype(np.float32)
    x = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=64, rows_a_part=700, rows_a_job=20_000).collect()}
    n = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert (n <= close.sum(1)).all()
    assert n[: len(loose) + len(pairs)].sum() >= 0.99 * close.sum(1)[: len(loose) + len(pairs)].sum()
    assert n.sum() >= 0.999 * close.sum()
    expected = brute_components(range(len(rows)), [(a, b) for a, b in zip(*np.nonzero(close), strict=True) if a < b])
    assert np.mean([found[i]["component_id"] == expected[i] for i in range(len(rows))]) >= 0.99
