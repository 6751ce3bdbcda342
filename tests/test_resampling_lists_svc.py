"""Sliced bootstrap, binned density, merged lists by thresholds, squared-hinge classifier."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from starlens.operators import classify as C, distribution as D, intervals as V, keywords as K, svc as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# bootstrap ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", "Hot" if i % 3 else "Rare", float(rng.gamma(2.0, 3.0))) for i in range(20_000)]
    return spark.createDataFrame(rows, "id string, App string, v double")


def test_sliced_interval_is_near_the_normal_one(measured):
    boot = {r["App"]: r for r in V.mean_sliced_interval(measured, ["App"], "v", "id").collect()}
    again = {r["App"]: r for r in V.mean_sliced_interval(measured.repartition(13), ["App"], "v", "id").collect()}
    assert boot == again
    for r in V.mean_normal_interval(measured, ["App"], "v").collect():
        b, width = boot[r["App"]], r["ci_high"] - r["ci_low"]
        assert (b["n"], b["mean"]) == (r["n"], r["mean"])
        assert b["ci_high"] - b["ci_low"] == pytest.approx(width, rel=0.12)
        assert b["ci_low"] == pytest.approx(r["ci_low"], abs=width / 6) and b["ci_high"] == pytest.approx(r["ci_high"], abs=width / 6)


def test_sliced_interval_by_definition(spark):
    rows = [("a", f"x{i % 40}", float(i * i % 17)) for i in range(60)] + [("b", None, 1.0), ("b", "y", None), (None, "z", 9.0), ("c", "q", None)]
    df = spark.createDataFrame(rows, "k string, id string, v double")
    got = {r["k"]: tuple(r)[1:] for r in V.mean_sliced_interval(df, ["k"], "v", "id", replicas=50, slices=16, seed=7).collect()}

    from hashlib import md5
    from math import exp, factorial

    def number(text):
        return int(md5(text.encode()).hexdigest()[:8], 16)

    def poisson(u):
        k, below = 0, exp(-1)
        while u >= int(2 ** 32 * below):
            k, below = k + 1, below + exp(-1) / factorial(k + 1)
        return k

    draws = np.array([[poisson(number(f"{s}:{r}:7")) for r in range(50)] for s in range(16)])
    values = [(draws[number(i) % 16], v) for k, i, v in rows if k == "a"]
    weight, total = sum(w for w, _ in values), sum(w * v for w, v in values)
    means = total[weight > 0] / weight[weight > 0]
    assert got["a"] == pytest.approx((60, np.mean([v for _, v in values]), *np.percentile(means, [2.5, 97.5])), abs=1e-4)
    assert got["b"] == (1, 1.0, 1.0, 1.0) and set(got) == {"a", "b"}


def test_sliced_interval_needs_no_python(measured):
    assert "Python" not in plan(V.mean_sliced_interval(measured, ["App"], "v", "id")) and "InPandas" not in plan(V.mean_sliced_interval(measured, ["App"], "v", "id"))


def test_sliced_interval_of_nothing(measured):
    assert V.mean_sliced_interval(measured.limit(0), ["App"], "v", "id").count() == 0


# density ----------------------------------------------------------------------------------------

def test_binned_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=700), rng.normal(6, 0.3, size=300), [2.5] * 200, [40.0]])  # a far value: empty points
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    exact = {r["point"]: r for r in D.kde(df, "v", points=300).collect()}
    binned = {r["point"]: r for r in D.kde_binned(df, "v", points=300).collect()}
    top = max(r["density"] for r in exact.values())
    assert exact.keys() == binned.keys() == set(range(300))
    for p, r in exact.items():
        assert binned[p]["x"] == r["x"] and binned[p]["density"] == pytest.approx(r["density"], abs=0.002 * top)


@pytest.mark.parametrize("values", [[], [2.0], [2.0, 2.0, None]])
def test_binned_density_without_spread(spark, values):
    assert D.kde_binned(spark.createDataFrame([(v,) for v in values], "v double"), "v", points=5).count() == 0


# merged lists ------------------------------------------------------------------------------------

def merged(rows, n):
    sums = {}
    for _, side, word, count in rows:
        sums[side, word] = sums.get((side, word), 0) + count
    out = set()
    for side in {s for s, _ in sums}:
        best = sorted(((-c, w) for (s, w), c in sums.items() if s == side))[:n]
        out |= {(side, w, -c, i + 1) for i, (c, w) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed, n", [(1, 5), (2, 40), (3, 1)])
def test_merged_list_is_exact(spark, seed, n):
    rng = random.Random(seed)
    rows = [(app, side, f"w{i:03d}", min(60, 1 + int(rng.paretovariate(0.8))))  # many ties
            for app in ["A", "B", "C", None] for side in ("positive", "negative") for i in range(150) if rng.random() < 0.6]
    # in no product's list, yet among the first of all
    rows += [(app, "positive", "everywhere", 55) for app in "ABC"] + [("A", "other", "single", 3)]
    got = K.cloud_from_counts(spark.createDataFrame(rows, "App string, polarity string, word string, n bigint"), n)
    assert {(r["polarity"], r["word"], r["n"], r["rank"]) for r in got.collect()} == merged(rows, n)


def test_merged_list_of_nothing(spark):
    assert K.cloud_from_counts(spark.createDataFrame([], "App string, polarity string, word string, n bigint"), 3).count() == 0


# squared hinge ------------------------------------------------------------------------------------

def objective(w, x, y, c):
    return w @ w / 2 + c * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()


@pytest.mark.parametrize("c", [0.1, 1.0, 20.0])
def test_squared_hinge_reaches_the_least_value(spark, c):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.4)
    label = (x[:, 0] - 2 * x[:, 3] + rng.normal(size=300) > 0.3).astype(int)
    rows = [(int(l), Vectors.sparse(12, [(j, float(v)) for j, v in enumerate(r) if v]) if i % 2 else Vectors.dense(r)) for i, (l, r) in enumerate(zip(label, x))]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(5)
    model = L.fit(df, 12, c)
    # plain Newton steps on the whole matrix
    a, y, w = np.hstack([x, np.ones((300, 1))]), 2 * label - 1, np.zeros(13)
    for _ in range(200):
        short = np.maximum(0, 1 - y * (a @ w))
        on = a[short > 0]
        step = np.linalg.solve(np.eye(13) + 2 * c * on.T @ on, w - 2 * c * a.T @ (y * short))
        t = 1.0
        while objective(w - t * step, a, y, c) > objective(w, a, y, c) and t > 1e-12:
            t /= 2
        w = w - t * step
    best, own = objective(w, a, y, c), np.append(model.weights, model.intercept)
    assert objective(own, a, y, c) == pytest.approx(model.objective, rel=1e-9)
    assert best * (1 - 1e-9) <= model.objective <= best * (1 + 1e-6)
    # the sparse and the dense rows are scored natively
    got = model.transform(df.withColumn("key", F.monotonically_increasing_id()))
    assert "Python" not in plan(got)
    assert got.where("prediction = 1").count() == int((a @ own > 0).sum())


def test_squared_hinge_without_rows_or_with_one_class(spark):
    rows = [(1, Vectors.sparse(3, {0: 1.0})), (1, Vectors.sparse(3, {})), (None, Vectors.sparse(3, {1: 5.0}))]
    one = spark.createDataFrame(rows[:3], ["label", "features"])
    model = L.fit(one.limit(0), 3)
    assert model.objective == 0 and model.intercept == 0
    model = L.fit(one, 3)
    assert model.intercept > 0 and model.weights[1] == 0
    assert [r["prediction"] for r in model.transform(one).collect()] == [1, 1, 1]


def test_squared_hinge_learns_an_obvious_rule(spark):
    rows = [(i, f"{'great superb' if i % 2 else 'awful broken'} item number{i % 7}", i % 2) for i in range(200)]
    out = L.train_and_predict(spark.createDataFrame(rows, "id bigint, text string, label int")).collect()
    assert 20 <= len(out) <= 70 and all(r["label"] == r["prediction"] for r in out)


def test_logistic_regression_ends_where_its_gradient_does(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    label = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(float(l), Vectors.dense(r)) for l, r in zip(label, x)], ["label", "features"])
    model = C.fit_logreg(df, 200)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(np.append(x.T @ (p - label) / 200 + w / 200, (p - label).mean())).max() < 2e-3
