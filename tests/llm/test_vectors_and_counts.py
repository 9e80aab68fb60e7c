"""Hard negatives, token counts and centroid clustering against brute force, and what their methods leave out."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeseek.llm import clustering, hard_negatives, registry, token_counts

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def around(seed: int, n: int, dim: int = 8, groups: int = 5) -> list[tuple]:
    """Vectors near a few centres, with ties and repeats."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = [(i, [round(c + rnd.gauss(0, 0.3), 2) for c in centres[i % groups]], rnd.randrange(3)) for i in range(n)]
    return [(i, rows[i // 2][1] if i % 9 == 0 else x, label) for i, x, label in rows]


ODD = [(None, [1.0] * 8, 1), (700, None, 1), (701, [1.0] * 8, None), (702, [1.0, None] + [1.0] * 6, 1), (703, [NAN] + [1.0] * 7, 2), (704, [INF] + [1.0] * 7, 2), (705, [1.0] * 7, 0), (705, [1.0] * 7, 0), (706, [], 1), (707, [], 2), (708, [0.0] * 8, 1), (709, [-0.001] * 8, 2)]


def usable(rows):
    return [(i, [math.floor(256 * v) for v in x], y) for i, x, y in rows if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]


def negatives_by_hand(rows, anchors, positives=5, negatives=10):
    rows = list({(i, tuple(x), y): None for i, x, y in usable(rows)})
    out = []
    for a, x, own in {(i, tuple(x), y): None for i, x, y in usable(anchors)}:
        scored = sorted((-sum(p * q for p, q in zip(x, z, strict=True)), i, y) for i, z, y in rows if i != a and len(z) == len(x))
        for s, i in [(-s, i) for s, i, y in scored if y == own][:positives]:
            fit = [(-t, j) for t, j, y in scored if y != own and 30 * s <= -100 * t <= 90 * s][:negatives]
            out += [(a, i, n, j, s, t) for n, (t, j) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    rows = around(seed, 400) + ODD
    rows += rows[10:20] + [(20, rows[3][1], 1), (40, rows[4][1], 2)]
    monkeypatch.setattr(hard_negatives, "RUN", 64 * 16)
    df = spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"embedding": "a.b"}).selectExpr("*", "1 as key", "2 as x")
    got = hard_negatives.mine(df, df.where("vec_id % 20 = 0 or vec_id > 699"), vector="a.b")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == negatives_by_hand(rows, [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] > 699)])


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(around(3, 10), VECTORS)
    assert hard_negatives.mine(none, none).count() == hard_negatives.mine(some, none).count() == hard_negatives.mine(none, some).count() == 0


def test_hard_negatives_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e9, 1e9], i % 2) for i in range(4)], VECTORS)
    with pytest.raises(Exception, match="may go beyond a long integer"):
        hard_negatives.mine(df, df).collect()


def anchors_of(x, labels, ids, low=hard_negatives.NOTHING, high=-hard_negatives.NOTHING):
    n = len(ids)
    return hard_negatives.Anchors(ids, labels, x, np.full(n, low), np.full(n, high))


def test_ball_trees_prune_by_window_and_by_kth_best():
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 100, (16, 12))
    x = np.round(centre[np.arange(4000) % 16] + rng.normal(0, 5, (4000, 12)))
    labels, ids = np.array(["a"] * 4000), np.arange(4000)
    trees = hard_negatives.Trees.unpack(hard_negatives.plant(ids, labels, x.copy()).pack())
    asked = x[:10].copy()
    scores = asked @ x.T
    best = hard_negatives.Best(10, 5)
    taken = hard_negatives.descend(trees, anchors_of(asked, labels[:10], ids[:10]), best, True)
    for q in range(10):
        want = sorted((-s, i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert list(zip(-best.score[q], best.id[q], strict=True)) == want
    assert taken < 0.5 * scores.size
    low, high = int(np.quantile(scores, 0.97)), int(np.quantile(scores, 0.99))
    best = hard_negatives.Best(10, 5)
    taken = hard_negatives.descend(trees, anchors_of(asked, np.array(["b"] * 10), ids[:10], low, high), best, False)
    for q in range(10):
        want = sorted((-s, i) for i, s in enumerate(scores[q]) if i != q and low <= s <= high)[:5]
        assert [(-s, i) for s, i in zip(best.score[q], best.id[q], strict=True) if i >= 0] == want
    assert taken < 0.5 * scores.size
    assert hard_negatives.descend(trees, anchors_of(asked, labels[:10], ids[:10]), best, False) == 0


def test_ties_at_the_kth_best_stay_in():
    x = np.ones((500, 4))
    trees = hard_negatives.plant(np.arange(500)[::-1].copy(), np.array(["a"] * 500), x)
    best = hard_negatives.Best(1, 3)
    hard_negatives.descend(trees, anchors_of(x[:1], np.array(["a"]), np.array([0])), best, True)
    assert best.id[0].tolist() == [1, 2, 3]


def clusters_by_hand(rows, size=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * v) for v in x]) for i, x, _ in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in first[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        for j, xs in members.items():
            centroids[j] = [sum(v) // len(xs) for v in zip(*xs, strict=True)]
    out = [(i, nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, (d, j) in out:
        inertia[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for i, (d, j) in out)


@pytest.mark.parametrize("n", [0, 3, 300])
def test_clusters_equal_brute_force(spark, n):
    rows = around(8, n, 64, 9) + (ODD + [(None, [0.1] * 64, 1), (5, [0.5] * 64, None), (5, [0.5] * 64, 3), (6, [-0.5] * 64, 3)] if n else [])
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as cluster", "2 as distance", "3 as x")
    got = clustering.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == clusters_by_hand(rows)


def test_sort_means_stops_early_and_keeps_ties():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-1000, 1000, (16, 6))
    x = centroids[np.arange(2000) % 16] + rng.integers(-40, 40, (2000, 6))
    all_ = clustering.squared(x, centroids)
    cluster, distance, taken = clustering.assign(x, np.arange(2000) % 16, centroids, *clustering.order_of(centroids))
    assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert taken < 0.3 * all_.size
    from_zero = clustering.assign(x, np.zeros(2000, int), centroids, *clustering.order_of(centroids))
    assert (from_zero[0] == cluster).all()
    line = np.array([[0], [2], [4], [2]])
    tied = clustering.assign(np.array([[1], [3], [2], [1]]), np.array([1, 2, 3, 1]), line, *clustering.order_of(line))
    assert tied[0].tolist() == [0, 1, 1, 0] and tied[1].tolist() == [1, 1, 0, 1]


def test_distances_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e17 * i] * 64, 0) for i in range(3)], VECTORS)
    with pytest.raises(Exception, match="beyond a long integer"):
        clustering.cluster(df).collect()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(registry.vocabulary_path())


@pytest.fixture(scope="module")
def raw():
    return token_counts.vocabulary(registry.vocabulary_path())


def test_counts_equal_the_library(spark, tokenizer, raw):
    rnd = random.Random(4)
    letters = "abcdefgh  ' \n\t\r0123éßłあ漢字  ​　😀!?.-<|"
    texts = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext", "it's we'll 'tis", "ab" * 40_000, " " * 20_000, "\x00\x01"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) + rnd.choice(["", "<|endoftext|>"]) for _ in range(600)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text as `t.x`", "1 as text", "2 as tokens")
    got = token_counts.count_tokens(df, raw, text="t.x")
    assert got.columns == ["doc_id", "t.x", "text", "tokens"]
    counts = {r.doc_id: r.tokens for r in got.collect()}
    assert [counts[i] for i in range(len(texts))] == [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_an_empty_table_and_forgotten_words(spark, raw, monkeypatch):
    assert token_counts.count_tokens(spark.createDataFrame([], "text string"), raw).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    counter = token_counts.Counter(raw)
    first = [counter.count(t) for t in ("some words of one text", "other words", "w" * 1000)]
    assert len(counter.known) <= 8 and [counter.count(t) for t in ("some words of one text", "other words", "w" * 1000)] == first


def test_heap_merges_in_order_of_rank_and_place(raw):
    """Against merging by definition: the pair of least rank, the first of equals, until none is left."""
    counter = token_counts.Counter(raw)
    rnd = random.Random(9)
    for _ in range(300):
        word = "".join(rnd.choice("aelnorst") for _ in range(rnd.randrange(1, 24)))
        parts = [counter.start[b] for b in word.encode()]
        while True:
            least = min(((counter.pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a << 32 | b in counter.pairs), default=None)
            if least is None:
                break
            parts[least[1] : least[1] + 2] = [least[0][1]]
        assert counter.count_word(word) == len(parts)


def test_a_vocabulary_too_large_to_send_is_an_error(tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"x" * 100)
    monkeypatch.setattr(token_counts, "LARGEST_VOCABULARY", 99)
    with pytest.raises(ValueError, match="more than 99 bytes"):
        token_counts.vocabulary(tmp_path / "v")


def test_registered_queries_on_odd_tables(spark, tmp_path, tokenizer):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/empty/embeddings.parquet")
    spark.createDataFrame([(None, None), (1, None), (1, ""), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name, rows in (("op11_hard_negatives", 0), ("op12_token_counts", 4), ("op13_clustering", 0)):
        assert len(registry.QUERIES[name](spark, f"{tmp_path}/empty").collect()) == rows
    assert {tuple(r)[1:] for r in registry.op12_token_counts(spark, f"{tmp_path}/empty").collect()} == {(0, 0, False), (3, 2, False)}
