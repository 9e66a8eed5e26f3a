"""Models, search, splits, explanations and the auction against plain versions."""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from larkspur.functions import metrics as M
from larkspur.operators import auction, explain, grid, matching, models, search, split


@pytest.mark.parametrize("mean,spread", [(0, 1), (1e4, 1), (1e9, 1e6), (1.7e9, 8e5)])
def test_linear_fits_keep_the_slope_of_features_with_large_means(spark, mean, spread):
    rng = np.random.default_rng(1)
    x, noise = rng.normal(mean, spread, 500), rng.normal(0, 0.1, 500)
    z = rng.normal(5, 2, 500)
    y = 3 * (x - mean) / spread + z + noise
    rows = spark.createDataFrame([(i, int(i % 4), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "id long, fold int, x double, z double, y double")
    centred = np.column_stack((x - x.mean(), z - z.mean()))
    want = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    m = models.moments(rows, ["x", "z"], "y")[None]
    b = models.ridge(m)
    assert np.allclose(b[1:], want, rtol=1e-6) and np.isclose(b[0] + b[1] * x.mean() + b[2] * z.mean(), y.mean(), atol=1e-6)
    penal = np.linalg.solve(centred.T @ centred + 0.5 * 500 * np.eye(2), centred.T @ (y - y.mean()))
    assert np.allclose(models.ridge(m, 0.5)[1:], penal, rtol=1e-6)
    assert np.isclose(models.mean_squared_error(m, b), np.mean((y - y.mean() - centred @ want) ** 2), rtol=1e-4)
    assert np.allclose(models.elastic_net(m, 1e-9)[1:], want, rtol=1e-4)
    left = models.regressed_out(rows, ["y"], ["x"]).agg(F.stddev_pop("y")).first()[0]
    assert left == pytest.approx(np.std(y - y.mean() - centred[:, 0] * (centred[:, 0] @ (y - y.mean())) / (centred[:, 0] @ centred[:, 0])), rel=1e-6)
    per = models.moments(rows, ["x", "z"], "y", "fold")
    three = (x if False else np.arange(500) % 4) != 2
    part = np.linalg.lstsq(np.column_stack((np.ones(three.sum()), x[three] - mean, z[three])), y[three], rcond=None)[0]
    total = per[0] + per[1] + per[2] + per[3]
    assert np.allclose(models.ridge(total - per[2])[1:], part[1:], rtol=1e-6)


@pytest.mark.parametrize("kind", ["lda", "qda", "nb"])
@pytest.mark.parametrize("mean", [0.0, 1e8])
def test_gaussian_models_far_from_zero(spark, kind, mean):
    rng = np.random.default_rng(2)
    y = np.arange(400) % 3
    x = rng.normal(0, 1, (400, 20)) + mean
    x[:, 0] += 5 * y
    rows = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(y, x)], "y int, " + ", ".join(f"x{i} double" for i in range(20)))
    names = [f"x{i}" for i in range(20)]
    model = models.gaussian_model(rows, names, "y", kind)
    for c, (_, m, cov) in model.items():
        own = x[y == c]
        want = np.cov(own.T) if kind == "qda" else np.diag(own.var(0)) if kind == "nb" else sum(np.cov(x[y == d].T) * ((y == d).sum() - 1) for d in range(3)) / (400 - 3)
        assert np.allclose(m, own.mean(0), rtol=1e-12) and np.allclose(cov, want, atol=1e-5)
    pred = [r[0] for r in rows.select(models.likeliest(models.gaussian_posteriors(F.array(*names), model), list(model))).collect()]
    assert np.mean(np.array(pred) == y) > 0.97


def test_folds_are_exact_over_strata_too(spark):
    rows = spark.createDataFrame([(i, i // 6) for i in range(60)], "id long, s int")
    got = split.k_fold(rows, 5, "id", 7, ["s"]).collect()
    assert sorted(np.bincount([r.fold for r in got])) == [12] * 5
    for s in range(10):
        assert set(np.bincount([r.fold for r in got if r.s == s], minlength=5)) <= {1, 2}


def test_stratified_folds_of_groups_equal_a_plain_greedy_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(g, "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]) for g in range(70) for _ in range(int(rng.integers(1, 9 if g % 9 else 60)))]
    df = spark.createDataFrame(rows, "g long, c string")
    got = split.group_k_fold(df, 4, "g", 3, "c").collect()
    fold = {r.g: r.fold for r in got}
    assert len(got) == len(rows) and all(fold[r.g] == r.fold for r in got)
    total = {c: sum(x == c for _, x in rows) for c in "abc"}
    largest = {c: max(sum(1 for h, x in rows if h == g and x == c) for g in range(70)) for c in "abc"}
    counts = {(f, c): sum(1 for r in got if r.fold == f and r.c == c) for f in range(4) for c in "abc"}
    for c in "abc":
        assert max(counts[f, c] for f in range(4)) - min(counts[f, c] for f in range(4)) <= largest[c], (c, counts, total)
    # the odd ones, by a loop over the vectors of counts
    vector = {g: tuple(sum(1 for h, x in rows if h == g and x == c) for c in "abc") for g in range(70)}
    kinds = {v: sum(1 for w in vector.values() if w == v) for v in vector.values()}
    held = np.zeros((4, 3))
    order = sorted((v for v, n in kinds.items() for _ in range(n % 4)), key=lambda v: (sum(v), v), reverse=True)
    weights = [1 / total[c] ** 2 for c in "abc"]
    for v in order:
        best = min(range(4), key=lambda f: (sum(n * x * w for n, x, w in zip(held[f], v, weights)), held[f].sum(), f))
        held[best] += v
    even = sum(np.array(v) * (n // 4) for v, n in kinds.items())
    assert [[counts[f, c] for c in "abc"] for f in range(4)] == (held + even).tolist()


def test_optimise_finds_the_best_in_fewer_points_than_a_grid():
    space = {"a": search.Axis(1e-4, 1e2, log=True), "b": search.Axis(0, 20, whole=True), "c": search.Axis(options=("x", "y", "z"))}
    surface = lambda p: (np.log10(p["a"]) + 1) ** 2 + ((p["b"] - 13) / 5) ** 2 + {"x": 1.0, "y": 0.0, "z": 2.0}[p["c"]]
    asked = []

    def values(points):
        asked.append(len(points))
        return [surface(p) for p in points]

    found = search.optimise(values, space, first=12, rounds=8, batch=4)
    assert len(found) == sum(asked) <= 44 and asked[1:] == [4] * 8 and len({tuple(sorted(p.items())) for p, _ in found}) == len(found)
    best, value = found[0]
    grid_ = [surface({"a": a, "b": b, "c": c}) for a in 10.0 ** np.arange(-4, 3) for b in range(0, 21, 4) for c in "xyz"]  # 126 points
    assert best["c"] == "y" and value < min(grid_) and value < 0.15
    again = search.optimise(lambda ps: [float("nan")] * len(ps), {"c": search.Axis(options=(1, 2))}, first=5, rounds=3)
    assert sorted(p["c"] for p, _ in again) == [1, 2]  # all there is, and undefined values don't stop it


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 240)
    x = rng.normal(0, 1, (240, 3))
    x[:, 0] += 2.5 * y
    rows = [(i, i % 3, (i // 3) % 3, int(c), *(None if rng.random() < 0.1 and j == 1 else float(v) for j, v in enumerate(r))) for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, fold int, again int, y int, a double, b double, c double").persist()


@pytest.mark.parametrize("name,parameters", [("lda", {}), ("qda", {}), ("nb", {}), ("knn", {"k": 7}), ("lr", {"penalty": 0.01})])
def test_estimators_of_the_grid_on_three_classes(classes, name, parameters):
    got = grid.out_of_fold(classes, name, parameters, ["a", "b", "c"], "y", "fold", [0, 1, 2]).collect()
    assert len(got) == 240 and all(r.score is None and len(r.posterior) == 3 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert np.mean([r.pred == r.y for r in got]) > 0.75
    if name == "knn":
        rows = {r.id: r for r in classes.collect()}
        for k in range(3):
            train = [r for r in rows.values() if r.fold != k]
            cell = lambda r: np.array([r.a, r.b if r.b is not None else np.nan, r.c])
            mean, sd = np.nanmean([cell(r) for r in train], 0), np.nanstd([cell(r) for r in train], 0)
            z = lambda r: np.nan_to_num((cell(r) - mean) / sd)
            for r in [r for r in got if r.fold == k][:10]:
                near = sorted(train, key=lambda t: np.linalg.norm(z(rows[r.id]) - z(t)))[:7]
                assert np.allclose(r.posterior, [sum(t.y == c for t in near) / 7 for c in range(3)])


def test_scores_by_every_name_and_over_repetitions(classes):
    predicted = grid.out_of_fold(classes, "lda", {}, ["a", "c"], "y", "fold", [0, 1, 2])
    rows = predicted.collect()
    p = np.clip([r.posterior for r in rows], 0.01, 0.99)
    y = np.array([int(r.y) for r in rows])
    entropy = -np.mean(np.log(p[np.arange(len(y)), y]))
    shares = np.bincount(y) / len(y)
    assert grid.scored_by(predicted, "cross_entropy") == pytest.approx(-entropy)
    assert grid.scored_by(predicted, "norm_cross_entropy") == pytest.approx(entropy / (shares @ np.log(shares)))
    assert grid.scored_by(predicted, "norm_expected_cost") == pytest.approx(-np.mean(p.argmax(1) != y) / (1 - shares.max()))
    assert grid.scored_by(predicted, "accuracy") == pytest.approx(np.mean([r.pred == r.y for r in rows]))
    with pytest.raises(ValueError):
        grid.scored_by(predicted, "roc_auc")
    with pytest.raises(KeyError):
        M.evaluate(predicted, "no such metric")
    assert M.metric("norm_cross_entropy") is M.norm_cross_entropy and M.metric("norm_expected_cost") is M.norm_expected_cost
    both = grid.grid(classes, "nb", [{}], [["a", "c"]], "y", ["fold", "again"], [0, 1, 2], "accuracy")[0].score
    each = [grid.grid(classes, "nb", [{}], [["a", "c"]], "y", f, [0, 1, 2], "accuracy")[0].score for f in ("fold", "again")]
    assert both == pytest.approx(np.mean(each))


def test_search_over_an_estimator_and_retraining(classes):
    trials = grid.searched(classes, "knn", {"k": search.Axis(1, 30, whole=True)}, ["a", "c"], "y", "fold", [0, 1, 2], "norm_cross_entropy", first=3, rounds=1, batch=2)
    assert len(trials) == 5 and trials == sorted(trials, key=lambda t: -t.score) and len({t.parameters for t in trials}) == 5
    again = grid.retrained(classes, [("knn", trials[0])], "y", "fold", [0, 1, 2], "norm_cross_entropy")
    assert again == [("knn", trials[0])]


def test_imputation_inside_the_fit_equals_a_plain_loop(classes):
    rows = classes.collect()
    got = {r.id: r.features.toArray() for r in grid.stepped(classes, ["a", "b", "c"], "y", F.col("fold") != 0, impute=5, id_col="id").collect()}
    train = [r for r in rows if r.fold != 0]
    z = {c: (np.nanmean([getattr(r, c) if getattr(r, c) is not None else np.nan for r in train]), np.nanstd([getattr(r, c) if getattr(r, c) is not None else np.nan for r in train])) for c in "abc"}
    scaled = {r.id: {c: None if getattr(r, c) is None else (getattr(r, c) - z[c][0]) / z[c][1] for c in "abc"} for r in rows}
    known = [r.id for r in train if r.b is not None]
    assert sum(r.b is None for r in rows) > 10
    for r in rows:
        s = scaled[r.id]
        b = s["b"]
        if b is None:
            near = sorted(known, key=lambda i: ((scaled[i]["a"] - s["a"]) ** 2 + (scaled[i]["c"] - s["c"]) ** 2, i))[:5]
            b = np.mean([scaled[i]["b"] for i in near])
        assert np.allclose(got[r.id], [s["a"], b, s["c"]])


def plain_tree_values(leaves, x):
    """Shapley values by enumeration of all coalitions."""
    d = len(x)

    def value(present):
        total = 0.0
        for leaf in leaves:
            w = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                w *= float(low < x[f] <= high) if f in present else share
            total += w
        return total

    out = []
    for i in range(d):
        others = [j for j in range(d) if j != i]
        out.append(sum(factorial(k) * factorial(d - k - 1) / factorial(d) * (value({*s, i}) - value(set(s))) for k in range(d) for s in itertools.combinations(others, k)))
    return out, value(set()), value(set(range(d)))


@pytest.mark.parametrize("name,label", [("rf", "y"), ("gbt", "y"), ("rf_regression", "c"), ("gbt_regression", "c")])
def test_tree_values_equal_enumeration(spark, name, label):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (150, 4))
    rows = [(*map(float, r), float(r[0] * r[1] > 0), float(r[0] + r[1] * r[2])) for r in x]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, y double, c double").withColumn("label", F.col(label))
    df = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(df)
    model = models.estimator(name, trees=4, depth=3).fit(df)
    got = explain.tree_attributions(model.transform(df), model).limit(12).collect()
    leaves = explain.leaves_of(model)
    for r in got:
        phi, base, whole = plain_tree_values(leaves, r.features.toArray())
        output = r.probability[1] if name == "rf" else r.rawPrediction[1] / 2 if name == "gbt" and False else r.prediction
        assert np.allclose(r.phi, phi, atol=1e-9) and r.base == pytest.approx(base) and sum(r.phi) + r.base == pytest.approx(whole)
        if name != "gbt":
            assert whole == pytest.approx(output)
        else:
            assert (whole > 0) == (r.prediction == 1)


@pytest.mark.parametrize("d", [1, 2, 4, 13])
def test_kernel_values_are_exact_on_a_linear_model(spark, d):
    rng = np.random.default_rng(6)
    b = rng.normal(0, 1, d)
    x = rng.normal(0, 1, (5, d))
    back = rng.normal(1, 1, (7, d))
    vectors = lambda m: VectorAssembler(inputCols=[f"x{i}" for i in range(d)], outputCol="features").transform(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, " + ", ".join(f"x{i} double" for i in range(d))))
    output = lambda rows: sum((vector_to_array("features")[i] * float(b[i]) for i in range(d)), F.lit(2.0))
    got = {r.id: r for r in explain.kernel_attributions(vectors(x), output, lambda rows: rows, vectors(back), "id", most=64).collect()}
    for i in range(5):
        assert np.allclose(got[i].phi, b * (x[i] - back.mean(0)), atol=1e-8) and got[i].base == pytest.approx(2 + back.mean(0) @ b)


def test_kernel_values_equal_enumeration_on_a_product(spark):
    back = np.array([[0.0, 1.0, 2.0], [1.0, 0.0, 1.0]])
    x = np.array([2.0, 3.0, -1.0])
    f = lambda v: v[0] * v[1] + v[2] * v[0]
    value = lambda s: np.mean([f([x[j] if j in s else r[j] for j in range(3)]) for r in back])
    want = [sum(factorial(k) * factorial(2 - k) / 6 * (value({*s, i}) - value(set(s))) for k in range(3) for s in itertools.combinations([j for j in range(3) if j != i], k)) for i in range(3)]
    vectors = lambda m: VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, a double, b double, c double"))
    v = lambda i: vector_to_array("features")[i]
    got = explain.kernel_attributions(vectors([x]), lambda rows: v(0) * v(1) + v(2) * v(0), lambda rows: rows, vectors(back), "id").first()
    assert np.allclose(got.phi, want) and got.base == pytest.approx(value(set()))


@pytest.mark.parametrize("ties", [False, True])
def test_auction_is_within_epsilon_of_the_least_total(spark, ties):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0.6, 1, (120, 2)), rng.normal(0, 1, (300, 2))
    if ties:
        x, y = np.round(x * 2) / 2, np.round(y * 2) / 2
    table = lambda m, first: spark.createDataFrame([(i % 2, first + i, *map(float, v)) for i, v in enumerate(m)], "block long, id long, a double, b double")
    bidders, items = table(x, 0), table(y, 1000)
    pairs, step = auction.auction(bidders, items, ["a", "b"], strip=40)
    got = pairs.collect()
    assert len(got) == len({r.bidder for r in got}) == len({r.item for r in got}) == 120 and all(r.bidder % 2 == r.item % 2 for r in got)
    least = 0.0
    for k in (0, 1):
        cost = np.sqrt(((x[k::2, None] - y[None, k::2]) ** 2).sum(2))
        at = matching.assign(cost)
        least += cost[np.arange(len(at)), at].sum()
    total = sum(r.cost for r in got)
    assert all(r.cost == pytest.approx(np.linalg.norm(x[r.bidder] - y[r.item - 1000])) for r in got)
    assert least - 1e-9 <= total <= least + 120 * step
    bound = auction.lower_bound(bidders, items, ["a", "b"], pairs.select("item", "price"), chunks=3, parts=2)
    assert total - 120 * step - 1e-9 <= bound <= least + 1e-9


def plain_boosting(x, y, cuts, k, trees, depth, step, l2, gamma, least, regression):
    """Margins by a loop over rows: the same bins, the best split of every node by all splits' gains."""
    bins = np.array([[sum(c < v for c in cuts[j]) for j, v in enumerate(r)] for r in x])
    f = np.full((len(x), k), y.mean() if regression else 0.0)
    for _ in range(trees):
        if regression:
            g, h = f - y[:, None], np.ones_like(f)
        elif k == 1:
            p = 1 / (1 + np.exp(-f))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
            g, h = p - np.eye(k)[y.astype(int)], 2 * p * (1 - p)
        new = f.copy()
        for c in range(k):

            def grow(rows, level):
                gs, hs = g[rows, c].sum(), h[rows, c].sum()
                best = None
                for j in range(x.shape[1]) if level < depth else ():
                    for b in range(len(cuts[j]) + 1):
                        left = rows[bins[rows, j] <= b]
                        gl, hl = g[left, c].sum(), h[left, c].sum()
                        if hl < least or hs - hl < least:
                            continue
                        gain = 0.5 * (gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)) - gamma
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = gain, j, b
                if best is None:
                    new[rows, c] += -step * gs / (hs + l2)
                    return
                _, j, b = best
                grow(rows[bins[rows, j] <= b], level + 1)
                grow(rows[bins[rows, j] > b], level + 1)

            grow(np.arange(len(x)), 0)
        f = new
    return f


@pytest.mark.parametrize("kind", ["two", "three", "values"])
def test_boosting_equals_a_plain_loop(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 3))
    y = {"two": x[:, 0] * x[:, 1] > 0, "three": np.digitize(x[:, 0] + x[:, 1], [-0.7, 0.7]), "values": x[:, 0] ** 2 + x[:, 1]}[kind].astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    p = {"trees": 4, "depth": 3, "step": 0.3, "l2": 1.0, "gamma": 0.05, "least_hessian": 0.5}
    name = "xgb_regression" if kind == "values" else "xgb"
    model = models.estimator(name, bins=8, **p).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    want = plain_boosting(x, y, model.cuts, 3 if kind == "three" else 1, p["trees"], p["depth"], p["step"], p["l2"], p["gamma"], p["least_hessian"], kind == "values")
    assert np.allclose([got[i].margins for i in range(200)], want, atol=1e-9)
    right = np.mean([got[i].prediction == y[i] for i in range(200)]) if kind != "values" else 1 - np.var([got[i].prediction - y[i] for i in range(200)]) / np.var(y)
    assert right > 0.6  # after four rounds


def test_nearest_pairs_by_widening_ranges_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 4 == 0), float(rng.normal() + (i % 97 == 0) * 9), float(rng.normal()), "ab"[i % 2]) for i in range(400)] + [(900, 1, 0.0, 0.0, "c")]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, s string")
    for columns in (["x"], ["x", "y"]):
        whole = sorted(map(tuple, matching.nearest_pairs(df, "id", "g", columns, ["s"]).collect()))
        monkeypatch.setattr(matching, "DIRECT", 0)
        assert sorted(map(tuple, matching.nearest_pairs(df, "id", "g", columns, ["s"]).collect())) == whole and len(whole) == 100
        monkeypatch.setattr(matching, "DIRECT", 10**8)


def test_redrawn_resamples_have_all_classes(spark):
    rows = spark.createDataFrame([(i, int(i == 0), float(i)) for i in range(5)], "place long, y int, v double")
    from larkspur.operators import resample

    got = resample.redrawn_bootstrap(rows, "place", "y", 5, 200, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.b, []).append(r)
    assert len(by) == 200 and all(len(x) == 5 and {r.y for r in x} == {0, 1} and len({r.attempt for r in x}) == 1 for x in by.values())
    assert {r.attempt for r in got} >= {0, 1, 2}
    assert resample.redrawn_bootstrap(rows.where("y = 5"), "place", "y", 0, 10, 3).collect() == []


def test_bca_of_a_correlation_covers_it_and_corrects_a_mean_as_the_closed_form(spark):
    from larkspur.operators import resample

    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, 300)
    y = 0.6 * x + rng.normal(0, 0.8, 300)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")

    def correlation(w):
        n, sx, sy = F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("y"))
        cov = F.sum(w * F.col("x") * F.col("y")) / n - sx / n * sy / n
        return cov / F.sqrt((F.sum(w * F.col("x") * F.col("x")) / n - sx * sx / n / n) * (F.sum(w * F.col("y") * F.col("y")) / n - sy * sy / n / n))

    r = resample.bca(df, "id", correlation, 400, 1).first()
    assert r.est == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.lo < r.est < r.hi and 0.08 < r.hi - r.lo < 0.25
    mean = resample.bca(df, "id", lambda w: F.sum(w * F.col("x")) / F.sum(w), 400, 1).first()
    closed = resample.bca_mean(df, "id", "x", 400, 1).first()
    assert mean.est == pytest.approx(closed.est) and mean.lo == pytest.approx(closed.lo, abs=0.01) and mean.hi == pytest.approx(closed.hi, abs=0.01)


@pytest.mark.parametrize("regression", [False, True])
def test_kernel_machines_equal_a_plain_solver(spark, regression):
    """On the same landmarks, by steepest descent with halving; and they bend where a line can't."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (300, 2))
    y = (x**2).sum(1) if regression else ((x**2).sum(1) > 1.4).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).repartition(3)
    machine = models.estimator("svr" if regression else "svc_rbf", cost=0.5, landmarks=20).fit(df)
    got = {r.id: r for r in machine.transform(df).collect()}
    z, target = machine.features(x), y if regression else 2 * y - 1

    def value(w):
        loss = machine.losses(z @ w, target)
        return 0.5 * w[1:] @ w[1:] + 0.5 * loss @ loss, np.concatenate(([0.0], w[1:])) + z.T @ loss

    w, rate = np.zeros(z.shape[1]), 1.0
    for _ in range(20_000):
        at, slope = value(w)
        while rate > 1e-12 and value(w - rate * slope)[0] > at - 0.5 * rate * slope @ slope:
            rate /= 2
        w, rate = w - rate * slope, rate * 1.5
    assert value(machine.weights)[0] <= value(w)[0] + 1e-6 and np.allclose([got[i].margin for i in range(300)], z @ w, atol=1e-2)
    if regression:
        assert np.var([got[i].prediction - y[i] for i in range(300)]) < 0.1 * np.var(y)
    else:
        assert np.mean([got[i].prediction == y[i] for i in range(300)]) > 0.93


def test_propensity_pairs_equal_all_pairs_with_many_equal_scores(spark):
    rng = np.random.default_rng(4)
    from time import time

    rows = [(i, int(rng.integers(2)), float(rng.integers(40)) / 10) for i in range(400)]
    got = sorted(map(tuple, matching.propensity_pairs(spark.createDataFrame(rows, "id long, g int, x double"), "id", "g", ["x"], 0.02).collect()))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=["x"], outputCol="v").transform(spark.createDataFrame(rows, "id long, g int, x double"))
    scores = LogisticRegression(featuresCol="v", labelCol="g").fit(made).transform(made).select("id", "g", vector_to_array("probability")[1].alias("p")).collect()
    a, b = [r for r in scores if r.g == 1], [r for r in scores if r.g == 0]
    best = lambda r, others: min(((abs(r.p - o.p), o.id) for o in others if abs(r.p - o.p) <= 0.02), default=(None, None))
    of_b = {r.id: best(r, a)[1] for r in b}
    assert got == sorted((r.id, best(r, b)[1], best(r, b)[0]) for r in a if of_b.get(best(r, b)[1]) == r.id) and got
    many = spark.range(80_000).selectExpr("id", "cast(id % 2 as int) as g", "cast(id % 999 as double) as x")
    began = time()
    assert 0 < matching.propensity_pairs(many, "id", "g", ["x"]).count() <= 999
    assert time() - began < 60  # all pairs within the caliper are 1.6 billion


def test_items_used_on_a_line_are_those_of_the_least_total():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n, m = (k := int(rng.integers(1, 9))), k + int(rng.integers(0, 6))
        a, b = ((np.sort(rng.integers(0, 12, k)).astype(float) if trial % 2 else np.sort(rng.normal(size=k))) for k in (n, m))
        values = np.unique(np.concatenate((a, b)))
        of = lambda x: (x[None, :] == values[:, None]).sum(1)
        used = matching.used_on_line(values, of(a), of(b))
        cost = np.abs(a[:, None] - b[None, :])
        assert used.sum() == n and (used >= 0).all() and (used <= of(b)).all()
        assert np.isclose(np.abs(a - np.repeat(values, used)).sum(), cost[np.arange(n), matching.assign(cost)].sum())


def test_blocks_of_any_size_have_the_least_total_in_one_covariate(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < p), float(np.round(rng.normal(), 1 if s == "b" else 6)), s) for s, p, n in (("a", 0.5, 300), ("b", 0.7, 400), ("c", 0.2, 200)) for i in range(ord(s) * 1000, ord(s) * 1000 + n)]
    df = spark.createDataFrame(rows, "id long, g int, x double, s string").repartition(3)
    x = np.array([r[2] for r in rows])
    z = {r[0]: (r[2] - x.mean()) / x.std() for r in rows}
    monkeypatch.setattr(matching, "MOST_SMALL", 16)  # blocks of more rows were left to an auction
    got = matching.optimal_pairs(df, "id", "g", ["x"], ["s"]).collect()
    side = {r[0]: (r[1], r[3]) for r in rows}
    assert all((side[r.small_id][0], side[r.large_id][0]) == (1, 0) and side[r.small_id][1] == side[r.large_id][1] for r in got)
    assert len({r.small_id for r in got}) == len({r.large_id for r in got}) == len(got)
    for s in "abc":
        a, b = (np.array([z[r[0]] for r in rows if r[3] == s and r[1] == g]) for g in (1, 0))
        cost = np.abs(a[:, None] - b[None, :]) if len(a) <= len(b) else np.abs(b[:, None] - a[None, :])
        mine = [r for r in got if side[r.small_id][1] == s]
        assert len(mine) == len(cost) and np.isclose(sum(r.distance for r in mine), cost[np.arange(len(cost)), matching.assign(cost)].sum(), rtol=1e-9)
        assert all(np.isclose(r.distance, abs(z[r.small_id] - z[r.large_id])) for r in mine)
    monkeypatch.setattr(matching, "MOST_VALUES", 100)  # blocks a and c, of more values, are left to the auction
    again = matching.optimal_pairs(df, "id", "g", ["x"], ["s"]).collect()
    assert len({r.small_id for r in again}) == len({r.large_id for r in again}) == len(again) == len(got)


def test_redrawn_resamples_do_not_hold_all_places_in_the_plan(spark):
    from larkspur.operators import resample

    rows = spark.createDataFrame([(i * 50_000, i % 2, float(i)) for i in range(4)], "place long, y int, v double")
    got = resample.redrawn_bootstrap(rows, "place", "y", 200_000, 20, 3)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert {r.k for r in got.collect()} <= set(range(200_000))


def test_importances_of_no_coefficient_are_undefined(spark):
    assert all(np.isnan(r.importance) for r in models.importances(["a", "b"], [5.0, 0.0, 0.0], spark).collect())
    assert [r.importance for r in models.importances(["a", "b"], [5.0, -3.0, 1.0], spark).collect()] == [0.75, 0.25]


def test_many_queries_meet_near_ranges_only_and_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [None if i % 7 == 0 else float(rng.integers(25)), i / 128 + (900.0 if i % 211 == 0 else 0.0)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 20 = 0")
    want = sorted(map(tuple, models.nearest(queries, df, "id", "v", 5).collect()))
    met = []
    monkeypatch.setattr(models, "_nearest_in_blocks", lambda *a: met.append(a))
    got = sorted(map(tuple, models.nearest(queries, df, "id", "v", 5, most_queries=60).collect()))
    assert got == want and len(got) == 750 and not met


@pytest.mark.parametrize("most_rows", [50_000, 100])
def test_neighbours_by_rounded_distances_are_tied_by_id(spark, most_rows):
    rows = [(i, [float(i // 10), (i % 10 and 0.25) + (9 - i % 10) * 1e-8]) for i in range(600)]  # nine rows as near as each other, but for the order of what rounding takes away
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 10 = 0")
    few = models.nearest(queries, df, "id", "v", 3, digits=6).collect()
    many = models.nearest(queries, df, "id", "v", 3, most_queries=20, most_rows=most_rows, digits=6).collect()
    want = [(q, q + p, 0.25, p) for q in range(0, 600, 10) for p in (1, 2, 3)]
    assert sorted(map(tuple, few)) == want and sorted(map(tuple, many)) == want
    assert min(r.id % 10 for r in models.nearest(queries, df, "id", "v", 3).collect()) == 7  # unrounded


def test_equal_vectors_ask_once_and_find_the_smallest_ids(spark, monkeypatch):
    rows = [(i, [0.0, None] if i % 5 < 2 else [float(i % 97), float(i % 2)]) for i in range(4000)]  # 1600 equal rows and 194 different ones
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 3 <> 0")
    met = []
    monkeypatch.setattr(models, "_nearest_in_blocks", lambda *a: met.append(a))
    got = sorted(map(tuple, models.nearest(queries, df, "id", "v", 4, most_queries=300, most_rows=700).collect()))
    want = sorted(map(tuple, models.nearest(queries, df, "id", "v", 4).collect()))
    assert got == want and len(got) == 4 * 2666 and not met


def test_scores_depend_on_the_rows_and_not_on_how_they_are_dealt(spark):
    rng = np.random.default_rng(11)
    values = [(float(x), float(y), 0.0) for x, y in zip(rng.integers(-99999, 1000000, 20000) / 100, 1e9 + rng.normal(0, 1e-3, 20000))]
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame([values[i] for i in rng.permutation(20000)], "x double, y double, c double").repartition(parts)
        found.append(sorted(matching.z_scored(df, ["x", "y", "c"]).select("x", "y", "z_x", "z_y", "z_c").collect()))
    assert found[0] == found[1]
    for n, z in ((0, 2), (1, 3)):
        x = np.array([r[n] for r in found[0]])
        assert np.allclose([r[z] for r in found[0]], (x - x.mean()) / x.std(), rtol=1e-3, atol=1e-3)
    assert {r.z_c for r in found[0]} == {0.0}


def test_estimators_of_a_grid_share_their_steps(spark, classes, monkeypatch):
    kinds = {"lda": [{}], "nb": [{}, {"smoothing": 0.1}]}
    alone = {name: grid.grid(classes, name, sets, [["a", "c"]], "y", "fold", [0, 1, 2], "accuracy") for name, sets in kinds.items()}
    steps, whole = [], grid.stepped
    monkeypatch.setattr(grid, "stepped", lambda *a, **b: steps.append(1) or whole(*a, **b))
    assert grid.grids(classes, kinds, [["a", "c"]], "y", "fold", [0, 1, 2], "accuracy") == alone and len(steps) == 3


def test_boosting_goes_through_the_different_bins(spark, monkeypatch):
    from larkspur.operators import boosting

    df = spark.range(3000).selectExpr("cast(id % 7 as double) as a", "cast(id % 3 as double) as b", "cast(id % 7 = 3 or id % 11 = 0 as double) as label")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    seen, whole = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda rows: seen.append(whole(rows)) or seen[-1])
    models.estimator("xgb", trees=2, depth=2).fit(df)
    assert [(r.count(), r.agg(F.sum("n")).first()[0]) for r in seen] == [(21, 3000)] * 3


def test_kernels_of_equal_rows_are_taken_once(monkeypatch):
    from larkspur.operators.kernels import KernelMachine

    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 3, (40, 2)).astype(float), 25, axis=0)
    y, w = rng.normal(0, 1, 1000), rng.normal(0, 1, 6)
    machine = KernelMachine(regression=True, gamma=0.5, points=rng.normal(0, 1, (5, 2)), root=np.eye(5))
    z = machine.features(x)
    loss = machine.losses(z @ w, y)
    asked, whole = [], KernelMachine.features
    monkeypatch.setattr(KernelMachine, "features", lambda self, rows: asked.append(len(rows)) or whole(self, rows))
    squares, gradient, hessian = machine.sums(x, y, w)
    assert np.isclose(squares, loss @ loss) and np.allclose(gradient, loss @ z) and np.allclose(hessian, z[loss != 0].T @ z[loss != 0])
    assert sum(asked) <= 40


def test_passes_of_a_kernel_machine_go_through_the_different_rows(spark, monkeypatch):
    from larkspur.operators import kernels

    df = spark.range(3000).selectExpr("id % 7 / 7D as a", "id % 3 / 3D as b", "double(id % 7 + id % 11) as label")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).coalesce(1)
    seen, whole = [], kernels.written
    monkeypatch.setattr(kernels, "written", lambda rows: seen.append(whole(rows)) or seen[-1])
    weights = []
    for most in (100, 2, 1):
        monkeypatch.setattr(kernels, "LABELS", most)
        weights.append(models.estimator("svr", landmarks=9).fit(df).weights)
    labels = lambda rows: sorted((r.x0, r.x1, y) for r in rows.collect() for y in r.y)
    assert [r.count() for r in seen] == [21 * 2, 18 * 72 + 3 * 71, 3000]  # 18 different rows with 143 labels, 3 with 142
    assert labels(seen[0]) == labels(seen[1]) == labels(seen[2]) == sorted((i % 7 / 7, i % 3 / 3, float(i % 7 + i % 11)) for i in range(3000))
    assert np.allclose(weights[0], weights[2], rtol=1e-6) and np.allclose(weights[1], weights[2], rtol=1e-6)


@pytest.mark.parametrize("name,parameters", [("svr", {"landmarks": 20, "epsilon": 0.05}), ("xgb_regression", {"trees": 4, "depth": 2}), ("svc_rbf", {"landmarks": 20}), ("xgb", {"trees": 4, "depth": 2})])
def test_rows_brought_together_give_the_same_predictions(spark, name, parameters):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), float(a), None if b == 2 else float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 5, 900), rng.integers(0, 3, 900)))]
    y = [(r[2] > rng.normal(2, 1)) * 1.0 if name in ("svc_rbf", "xgb") else r[2] + rng.normal() for r in rows]
    df = spark.createDataFrame([(*r, float(v)) for r, v in zip(rows, y)], "id int, fold int, a double, b double, y double").repartition(3)
    of = lambda together: sorted((r.fold, r.y, r.score) for r in grid.Steps(df, "y", "fold", [0, 1, 2], together=together).out_of_fold(name, parameters, ["a", "b"]).collect())
    got, want = of(True), of(False)
    assert len(got) == 900 and np.allclose(got, want, atol=1e-6)


def test_kernel_regression_predicts_every_line(spark, small_dir, monkeypatch):
    from larkspur import plans

    found, whole = [], grid.Steps.out_of_fold
    monkeypatch.setattr(grid.Steps, "out_of_fold", lambda self, *a: found.append(whole(self, *a)) or found[-1])
    plans.QUERIES["kernel_regression"](spark, small_dir)
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet").count()
    assert [f.count() for f in found] == [lines, lines]
