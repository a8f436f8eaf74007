"""All fits of a cross-validation grow together: the published folds and rounds, and the trees of a plain fit."""

import numpy as np
import pytest

from ledgerline.operators import boosting as B
from ledgerline.operators import learned as L


def test_cross_validation_does_the_published_folds_and_rounds(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "en", " ".join(f"w{(i * k) % 97}" for i in range(k + 1))) for k in range(40)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    monkeypatch.setattr(L, "stored_predictions", lambda rows, s=None, store=None: asked.append(s or L.Settings()))
    _, fold, rows, _ = L.cross_validated(spark, str(tmp_path))
    assert asked == [L.Settings()] and fold.select("fold").distinct().count() == 10 and rows.count() == 40


def plain(x, y, s):
    """Boosting of one fit, every value a candidate, as a function of a row."""

    def grow(r, some, depth):
        at = np.flatnonzero(some)
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[at, f])[:-1]:
                left = at[x[at, f] <= v]
                right = at[x[at, f] > v]
                if min(len(left), len(right)) >= s.least:
                    gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[at].sum() ** 2 / len(at)
                    best = max(best, (gain, f, v), key=lambda b: round(b[0], 9))
        if depth == 0 or best[0] < 1e-9:
            value = s.rate * r[at].mean()
            return lambda row: value
        _, f, v = best
        low, high = grow(r, some & (x[:, f] <= v), depth - 1), grow(r, some & (x[:, f] > v), depth - 1)
        return lambda row: (low if row[f] <= v else high)(row)

    base, r, trees = y.mean(), y - y.mean(), []
    for _ in range(s.rounds):
        trees.append(grow(r, np.ones(len(y), bool), s.depth))
        r = r - np.array([trees[-1](row) for row in x])
    return lambda row: base + sum(t(row) for t in trees)


def test_fits_grown_together_are_the_plain_ones(spark, monkeypatch):
    """With null scores, a score that does not change, a fold that is null, several blocks and more rounds than lie between checkpoints."""
    monkeypatch.setattr(B, "EVERY", 2)
    g, s = np.random.default_rng(1), L.Settings(rounds=5, depth=3, rate=0.4, bins=255, least=3)
    x, fold = np.round(g.random((90, 2)), 2), [(0, 1, None)[k % 3] for k in range(90)]
    scores = [[float(v) for v in np.sin(9 * x[:, 0]) + x[:, 1] ** 2 + g.random(90) / 9], [1.0] * 90]
    scores[0][4] = scores[0][8] = None
    rows = spark.createDataFrame([(k, fold[k], scores[0][k], scores[1][k], *map(float, x[k])) for k in range(90)], "key long, fold int, s0 double, s3 double, a double, b double").repartition(3, "key")
    got = {(r.key, r.cfg_ord): (r.fold, r.prediction) for r in L.predictions(rows, s).collect()}
    assert len(got) == 180
    for c, y in zip((0, 3), scores, strict=True):
        for f in (0, 1, None):
            train = [k for k in range(90) if fold[k] != f and y[k] is not None]
            model = plain(x[train], np.array([y[k] for k in train]), s)
            for k in range(90):
                if fold[k] == f:
                    assert got[k, c][0] == f and got[k, c][1] == pytest.approx(model(x[k]), abs=1e-5)


def test_candidate_splits_are_exact_quantiles_of_the_other_folds(spark):
    """All values where they are few; else those that end a bin, however often one comes, and none that only the held-out fold has."""
    n, bins = 4_000, 16
    values = [(k % 3, float(k % 5), float(int(k**1.5) % 3_001 if k % 4 else -1), 9.0 if k % 3 == 1 else 1.0) for k in range(n)]
    rows = spark.createDataFrame(values, "_fold int, a double, b double, c double").repartition(5)
    found = B.candidate_splits(rows, ["a", "b", "c"], 3, bins)
    for k in range(3):
        train = np.array([v[1:] for v in values if v[0] != k])
        assert found[k][0].tolist() == [0, 1, 2, 3]
        b = np.sort(train[:, 1])
        assert found[k][1].tolist() == sorted({float(b[-(-j * len(b) // bins) - 1]) for j in range(1, bins)} - {b[-1]})
        assert found[k][2].tolist() == ([] if k == 1 else [1.0])


def test_a_fit_without_scores_predicts_null_and_settings_are_checked(spark):
    rows = spark.createDataFrame([(k, k % 2, None if k % 2 else 0.5, float(k)) for k in range(8)], "key long, fold int, s0 double, a double")
    got = {r.key: r.prediction for r in L.predictions(rows, L.Settings(rounds=2, least=1)).collect()}
    assert got == {k: 0.5 if k % 2 else None for k in range(8)}
    for wrong in (L.Settings(bins=256), L.Settings(depth=0)):
        with pytest.raises(ValueError, match="bins"):
            L.predictions(rows, wrong)
