"""Fits, filters and searches that SQL can't say, against plain numpy and Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import inference, models


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=600), rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.5 + a - 2 * b)))).astype(int)
    t = np.argmax(np.c_[a, b, rng.normal(size=600)], axis=1)
    w = rng.random(600) + 0.5
    rows = [(i, float(a[i]), float(b[i]), int(y[i]), int(t[i]), float(w[i])) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, t int, w double").repartition(5).cache(), np.c_[np.ones(600), a, b], y, t, w


def test_logistic_regression_zeroes_the_penalised_gradient(sample):
    df, x, y, _, w = sample
    beta = np.array(models.fit_logistic(df, ["a", "b"], "y", F.col("w")))
    gradient = x.T @ (w * (y - 1 / (1 + np.exp(-x @ beta)))) - np.array([0, *beta[1:]])
    assert np.abs(gradient).max() < 1e-6


def test_ridge_matches_the_normal_equations(sample):
    df, x, y, _, w = sample
    want = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([0, 1, 1]), x.T @ (w * y))
    assert np.allclose(models.fit_ridge(df, ["a", "b"], "y", F.col("w")), want)


def test_multinomial_zeroes_every_gradient(sample):
    df, x, _, t, w = sample
    beta = np.array(models.fit_multinomial(df, ["a", "b"], "t", 3, F.col("w")))
    e = np.exp(x @ beta.T)
    p = e / e.sum(axis=1, keepdims=True)
    for k in range(3):
        gradient = x.T @ (w * ((t == k) - p[:, k])) - np.array([0, *beta[k, 1:]])
        assert np.abs(gradient).max() < 1e-5


def test_shrinkage_covariance_matches_the_formula_by_rows(sample):
    df, x, *_ = sample
    got, share = models.shrinkage_covariance(df, ["a", "b"])
    d = x[:, 1:] - x[:, 1:].mean(axis=0)
    n, p = d.shape
    s = d.T @ d / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, sum(((np.outer(r, r) - s) ** 2).sum() for r in d) / n**2 / p)
    assert share == pytest.approx(beta / delta)
    assert np.allclose(got, (1 - share) * s + share * mu * np.eye(p))


def test_explained_variance_adds_up_and_leads_with_the_common_part(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=300)
    x = np.c_[c + 0.1 * rng.normal(size=300), c + 0.1 * rng.normal(size=300), rng.normal(size=300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = models.explained_variance(df, ["a", "b", "c"])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(got, values / values.sum())


def test_mixture_and_clusters_find_planted_groups_in_order(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.3, 200) for m in (8, 0, 4)])
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double").repartition(4)
    m = models.fit_mixture(df, ["a", "b"], 3)
    assert np.allclose([r[0] for r in m["means"]], [0, 4, 8], atol=0.15)
    assert np.allclose(m["weights"], 1 / 3, atol=0.02)
    centres = models.fit_clusters(df, ["a", "b"], 3)
    assert np.allclose([c[0] for c in centres], [0, 4, 8], atol=0.15)
    assert {r.k for r in df.select(models.nearest_state(["a", "b"], centres).alias("k"), "a").where("a > 6").collect()} == {2}


def test_var_recovers_planted_slopes_by_phase(spark):
    rng = np.random.default_rng(5)
    rows, v = [], np.zeros(2)
    for i in range(4000):
        phase = "am" if i % 40 < 20 else "pm"
        a = np.array([[0.5, 0.1], [0, -0.4]]) if phase == "am" else np.array([[-0.3, 0], [0.2, 0.3]])
        v = a @ v + rng.normal(size=2)
        rows.append(("s", i, phase, float(v[0]), float(v[1])))
    df = spark.createDataFrame(rows + [("s", 5000, "odd", 1.0, 3.0)], "s string, i int, phase string, a double, b double")
    got = models.var1(df, ["s"], "i", "phase", ["a", "b"])
    assert np.allclose([r[1:] for r in got["am"]], [[0.5, 0.1], [0, -0.4]], atol=0.08)
    assert np.allclose([r[1:] for r in got["pm"]], [[-0.3, 0], [0.2, 0.3]], atol=0.08)
    assert got["odd"] == [[1.0, 0.0, 0.0], [3.0, 0.0, 0.0]]


def test_state_filter_equals_the_sum_over_all_paths(spark):
    rng = np.random.default_rng(4)
    hazard, moves, initial = np.array([[0.2, 0.5], [0.4, 0.1]]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([0.3, 0.7])
    logs = rng.normal(size=(5, 2))
    df = spark.createDataFrame([("s", i, [float(v) for v in logs[i]]) for i in (3, 1, 0, 4, 2)] + [("z", 0, [0.0, 0.0])], "s string, i int, l array<double>")
    got = {(r.s, r.i): r for r in models.semimarkov_filter(df, ["s"], "i", "l", hazard, moves, initial).collect()}
    for last in range(5):
        total = np.zeros(2)
        for path in itertools.product([(s, a) for s in (0, 1) for a in (0, 1)], repeat=last + 1):
            s, a = path[0]
            p = initial[s] * (a == 0) * math.exp(logs[0][s])
            for k in range(1, last + 1):
                (s, a), (t, b) = path[k - 1], path[k]
                stay = (1 - hazard[s, a]) * (t == s and b == min(a + 1, 1))
                p *= (stay + hazard[s, a] * moves[s, t] * (b == 0)) * math.exp(logs[k][t])
            total[path[-1][0]] += p
        assert np.allclose(got["s", last].probabilities, total / total.sum())
    assert np.allclose(got["z", 0].probabilities, initial)


def test_change_points_rise_at_a_shift_and_pass_over_nulls(spark):
    values = [1.0, -2.0, 0.5, 1.5, -1.0, 0.2, None, 0.7, -0.4, 300.0, 301.0, 299.0, 300.5]
    df = spark.createDataFrame([("c", i, v, 5.0) for i, v in enumerate(values)], "c string, i int, v double, n double")
    got = {r.i: r for r in models.change_points(df, ["c"], "i", "v", "n").collect()}
    assert 6 not in got and len(got) == 12
    assert max(got, key=lambda i: got[i].change) == 9
    assert got[8].run_length > 6 and got[12].run_length < 5
    # a bound on the runs pools the oldest, and keeps the mass
    short = models.change_points(df, ["c"], "i", "v", "n", longest=3).collect()
    assert all(0 <= r.run_length <= 3 for r in short)


def test_tree_leaves_match_a_greedy_search(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), int((a > 4 and b <= 2) or rng.random() < 0.1)) for a, b in rng.integers(0, 8, (500, 2))]
    got = {r.leaf: (r.n, r.positives) for r in inference.tree_leaves(spark.createDataFrame(rows, "a int, b int, y int"), ["a", "b"], "y", depth=2, least=20).collect()}

    def gini(part):
        y = sum(r[2] for r in part)
        return y * (1 - y / len(part))

    def grow(part, name, depth):
        best = None
        for f, v in itertools.product((0, 1), range(8)):
            low, high = [r for r in part if r[f] <= v], [r for r in part if r[f] > v]
            if len(low) >= 20 and len(high) >= 20:
                gain = round(gini(part) - gini(low) - gini(high), 9)
                if gain > 0 and (best is None or (gain, -v, "ab"[f]) > best[0]):
                    best = ((gain, -v, "ab"[f]), f, v, low, high)
        if depth == 0 or best is None:
            return {name: (len(part), sum(r[2] for r in part))}
        _, f, v, low, high = best
        head = name + " and " if name else ""
        return grow(low, f"{head}{'ab'[f]} <= {v}", depth - 1) | grow(high, f"{head}{'ab'[f]} > {v}", depth - 1)

    assert got == grow(rows, "", 2)


def test_permuted_bundles_stay_whole_and_inside_their_slates(spark):
    df = spark.createDataFrame([(i, i % 3, i, -i) for i in range(60)], "id int, slate int, a int, b int")
    got = inference.permuted(df, ["slate"], "id", ["a", "b"], 1).collect()
    assert all(r.a == -r.b and r.a % 3 == r.slate for r in got)
    assert sorted(r.a for r in got) == list(range(60)) and any(r.a != r.id for r in got)


def test_simulated_counts_come_near_the_expected(spark):
    n = spark.createDataFrame([(i, 30) for i in range(200)], "s int, n int")
    first, moves = {0: 0.5, 1: 0.5}, {0: {0: 0.5, 1: 0.5}, 1: {0: 0.5, 1: 0.5}}
    counts = [r["count"] for r in inference.simulated_counts(n, ["s"], "n", first, moves, [0, 1, 0], 20).collect()]
    assert np.mean(counts) == pytest.approx(200 * 28 / 8, rel=0.05) and len(set(counts)) > 5


def test_filters_and_fits_take_an_empty_table(spark):
    empty = spark.createDataFrame([], "c string, i int, v double, n double")
    assert models.change_points(empty, ["c"], "i", "v", "n").collect() == []
    assert inference.block_draws(empty, ["c"], "i", "v", 5, 2).collect() == []
    assert models.calibration_table(empty, ["c"], "v", "i").collect() == []
