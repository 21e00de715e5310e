import numpy as np

from veritally.llm import embed


def brute(vectors, cosine):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    return linked


def near(draw, base, cosine):
    z = draw.normal(size=base.shape)
    z -= (z * base).sum(1, keepdims=True) * base
    return cosine * base + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]


def result(spark, rows):
    return embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")).collect()


def planted(seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(250, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    hub = np.repeat(base[:1], 120, axis=0)
    return np.vstack([base, near(draw, base, 0.905), near(draw, base, 0.893), near(draw, hub, 0.97), base[5:25] * 2.0, base[5:8]])


def test_recall_and_precision(spark, monkeypatch):
    vectors = planted(1)
    linked = brute(vectors, 0.9)
    for order in (1, 2):
        monkeypatch.setattr(embed, "list_order", lambda n, tail, order=order: order)
        monkeypatch.setattr(embed, "LIST_BLOCK", 1024 if order == 1 else 20)
        got = {r.vec_id: r for r in result(spark, [(i, v.tolist(), 1) for i, v in enumerate(vectors)])}
        counts = np.array([got[i].n_links for i in range(len(vectors))])
        assert (counts <= linked.sum(1)).all()
        assert counts.sum() >= 0.95 * linked.sum()
        for i, r in got.items():
            assert r.component_id <= i and r.kept == (r.component_id == i)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0] + [0.0] * 7
    nan, inf = float("nan"), float("inf")
    rows = [(1, one, 1), (2, one, 1), (3, None, 1), (4, [], 1), (5, [0.0] * 8, 1), (6, [nan] + one[1:], 1), (7, [None] + one[1:], 1), (8, [inf] + one[1:], 1), (9, [1.0, 0.0], 1), (None, one, 1), (2, one, 1), (10, [1e-200] + one[1:], 1)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in result(spark, rows)))
    assert got == [(0, 0, 0, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False)]
    assert result(spark, []) == []


def test_calibration_at_the_threshold():
    assert embed.calibrated_tail(0.95) < embed.calibrated_tail(0.9) <= 12
