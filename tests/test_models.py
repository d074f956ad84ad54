"""Boosted trees and attributions against brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airloom.plans import boosting as B
from airloom.plans import explain as E
from airloom.plans import training as M

NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 6)), 1)
    x[:, 5] = rng.integers(0, 3, 200)
    y = 3 * x[:, 0] - 2 * x[:, 1] * (x[:, 2] > 0) + x[:, 5] ** 2 + np.round(rng.normal(size=200), 1)
    data = [(*map(float, r), float(v), float(-v * 2)) for r, v in zip(x, y)]
    frame = spark.createDataFrame(data, [*NAMES, "y", "z"]).repartition(3, "x0")
    return frame.sortWithinPartitions(*NAMES, "y"), x, y


def assembled(frame):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame)


def plain_tree(x, g, depth, penalty=1.0, least=1.0):
    """[(feature, cut, left, right)] or the leaf value, by trying every cut."""
    def score(part):
        return g[part].sum() ** 2 / (part.sum() + penalty)

    def grow(part, level):
        if level:
            options = []
            for f in range(x.shape[1]):
                for cut in np.unique(x[part, f])[:-1]:
                    left = part & (x[:, f] <= cut)
                    options.append((score(left) + score(part & ~left) - score(part), -f, -cut))
            best = max(options, default=(0,))
            if best[0] > 1e-9:
                f, cut = -best[1], -best[2]
                left = part & (x[:, f] <= cut)
                return f, float(cut), grow(left, level - 1), grow(part & ~left, level - 1)
        return -0.1 * g[part].sum() / (part.sum() + penalty)

    return grow(np.ones(len(x), bool), depth)


def as_nested(tree, node=0, level=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return tree.feature[node], tree.cut[node], as_nested(tree, tree.left[node]), as_nested(tree, tree.right[node])


def same_tree(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b, abs=1e-9)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same_tree(a[2], b[2]) and same_tree(a[3], b[3])


@pytest.mark.parametrize("direct", [B.DIRECT_BYTES, 0])
def test_trees_equal_a_search_of_all_cuts(rows, monkeypatch, direct):
    monkeypatch.setattr(B, "DIRECT_BYTES", direct)
    frame, x, y = rows
    model = B.HistBoost(labelCol="y", maxIter=3, maxDepth=4).fit(assembled(frame))
    base, trees = model.parsed()
    margin = np.full(len(y), y.mean())
    assert base == pytest.approx(y.mean())
    for tree in trees:
        assert same_tree(as_nested(tree), plain_tree(x, margin - y, 4))
        margin += np.array(tree.value)[tree.walk(x)]
    got = {tuple(r[n] for n in NAMES): r.prediction for r in model.transform(assembled(frame)).collect()}
    assert all(got[tuple(map(float, r))] == pytest.approx(m) for r, m in zip(x, margin))


def test_models_that_grow_together_equal_those_that_grow_apart(rows, monkeypatch):
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    frame = assembled(rows[0])
    makers = [B.HistBoost(labelCol=y, maxIter=5, maxDepth=3) for y in ("y", "z")]
    both = B.fit_together([(frame.where("z < 5"), makers[1]), (frame, makers[0])])
    assert both[1].getOrDefault("trees") == makers[0].fit(frame).getOrDefault("trees")
    assert both[0].parsed()[0] != both[1].parsed()[0]
    with pytest.raises(ValueError):
        B.fit_together([(frame, makers[0]), (frame, B.HistBoost(labelCol="z", maxIter=6))])


def test_a_pass_starts_no_task_for_a_few_rows(spark, monkeypatch):
    """Rows in 40 files-worth of partitions become one partition a model while they are few, as many as they need beyond."""
    frame = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(0, 400, 1, 40).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 9 AS DOUBLE) AS y"))
    seen, one_pass = set(), B._pass
    monkeypatch.setattr(B, "_pass", lambda state, asked, n_bins, width, partitions, *rest: (seen.add(state.getNumPartitions()), one_pass(state, asked, n_bins, width, partitions, *rest))[1])
    maker = B.HistBoost(labelCol="y", maxIter=2, maxDepth=2)
    one = maker.fit(frame)
    assert seen == {1}
    monkeypatch.setattr(B, "PARTITION_ROWS", 100)
    assert maker.fit(frame).getOrDefault("trees") == one.getOrDefault("trees") and seen == {1, 4}


def test_rows_of_a_round_are_drawn_alike_each_time(rows):
    frame = assembled(rows[0])
    maker = B.HistBoost(labelCol="y", maxIter=4, maxDepth=3, subsamplingRate=0.5)
    first, again, other = maker.fit(frame), maker.fit(frame), maker.copy({maker.seed: 1}).fit(frame)
    assert first.getOrDefault("trees") == again.getOrDefault("trees") != other.getOrDefault("trees")
    assert 60 < first.parsed()[1][0].cover[0] < 140


def test_null_labels_constant_labels_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1.0, 2.0)] * 5 + [(2.0, 2.0), (3.0, None)], "x double, y double")
    model = M.fit(frame.where("y IS NOT NULL"), ["x"], "y", lambda d, y: M.boost(d, y, maxIter=2))
    assert [r.prediction for r in model.transform(frame.where("x > 2")).collect()] == [2.0]
    with pytest.raises(ValueError):
        B.HistBoost(labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(frame.where("y IS NULL")))


def test_stored_models_come_back(rows, tmp_path):
    frame = rows[0]
    made = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), B.HistBoost(labelCol="y", maxIter=3)]).fit(frame)
    made.write().overwrite().save(str(tmp_path / "m"))
    read = PipelineModel.load(str(tmp_path / "m"))
    a, b = (sorted(r.prediction for r in m.transform(frame).collect()) for m in (made, read))
    assert a == b and sum(read.stages[-1].featureImportances) == pytest.approx(1)


@pytest.mark.parametrize("make", [lambda d, y: M.boost(d, y, maxIter=4, maxDepth=4), lambda d, y: M.forest(d, y, numTrees=3, maxDepth=5)])
def test_attributions_equal_all_coalitions(spark, rows, make):
    frame, x, _ = rows
    model = M.fit(frame, NAMES, "y", make)
    base, table = E.tree_table(model, spark)
    nodes = {(r.tree, r.node): r for r in table.collect()}
    roots = sorted({t: min(n for u, n in nodes if u == t) for t, _ in nodes}.items())

    def value(row, known):
        def at(tree, node):
            n = nodes[tree, node]
            if n.feature < 0:
                return n.value
            if n.feature in known:
                return at(tree, n.left if row[n.feature] <= n.cut else n.right)
            return sum(at(tree, c) * nodes[tree, c].cover / n.cover for c in (n.left, n.right))

        return base + sum(at(t, r) for t, r in roots)

    sample = model.transform(frame.limit(6))
    for r in E.attributions(model, sample, NAMES).collect():
        row = [r[n] for n in NAMES]
        assert r.expected == pytest.approx(value(row, ()))
        assert sum(r.attributions) + r.expected == pytest.approx(r.prediction) == pytest.approx(value(row, range(6)))
        for i in range(6):
            others = [j for j in range(6) if j != i]
            want = sum(
                factorial(k) * factorial(5 - k) / factorial(6) * (value(row, (*s, i)) - value(row, s))
                for k in range(6) for s in combinations(others, k)
            )
            assert r.attributions[i] == pytest.approx(want, abs=1e-9)


def test_importance_of_trees_is_the_mean_attribution(rows):
    frame = rows[0]
    model = M.fit(frame, NAMES, "y", lambda d, y: M.boost(d, y, maxIter=5))
    got = {r.feature: r.importance for r in E.tree_importance(model, frame, NAMES).collect()}
    each = np.array([r.attributions for r in E.attributions(model, frame, NAMES).collect()])
    assert [got[n] for n in NAMES] == pytest.approx(np.abs(each).mean(0)) and max(got, key=got.get) == "x0"
