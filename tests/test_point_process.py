"""Point-process models: gradients against differences, falling loss, scores that don't depend on the deal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import point_process as pp
from tidelake.operators.autodiff import Node


def batch(seed=0, n=5, longest=6, features=2):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, longest + 1, n)
    mask = (np.arange(longest) < lengths[:, None]).astype(float)
    waits = rng.integers(0, 3000, (n, longest)) * mask
    extra = np.concatenate([np.log1p(waits)[..., None], rng.normal(size=(n, longest, features))], 2) * mask[..., None]
    return pp.Batch((rng.integers(1, 4, (n, longest)) * mask).astype(int), waits, extra, rng.integers(0, 2, (n, longest)) * mask, mask, rng.integers(0, 1 << 62, n).astype(np.uint64))


@pytest.mark.parametrize("model", [pp.Gated(3, 2, size=4, embed=3), pp.Continuous(3, 2, size=4, embed=3, samples=3)])
def test_gradients_equal_differences(model):
    own, params = batch(), model.start()
    _, grads = pp.loss_and_gradient(model, params, own)
    rng, step = np.random.default_rng(1), 1e-5
    for name, x in params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in x.shape)
            sides = []
            for d in (step, -step):
                moved = {k: v.copy() for k, v in params.items()}
                moved[name][at] += d
                sides.append(pp.loss_and_gradient(model, moved, own)[0])
            assert abs((sides[0] - sides[1]) / (2 * step) - grads[name][at]) < 1e-5 * max(1, abs(grads[name][at]))


@pytest.mark.parametrize("model", [pp.Gated(3, 2), pp.Continuous(3, 2)])
def test_padding_changes_nothing(model):
    own, params = batch(), model.start()
    wide = pp.Batch(*(np.concatenate([x, np.zeros_like(x)], 1) if x.ndim > 1 else x for x in (own.marks, own.waits, own.extra, own.labels, own.mask, own.draws)))
    (a, ga), (b, gb) = (pp.loss_and_gradient(model, params, x) for x in (own, wide))
    assert abs(a - b) < 1e-9
    assert all(np.allclose(ga[k], gb[k]) for k in ga)


def test_the_integral_is_near_quadrature():
    own = batch(3, n=8, longest=10)
    params = pp.Continuous(3, 2).start()
    params["b"] = params["b"] + 0.3
    run = lambda model: model.parts({k: Node(x) for k, x in params.items()}, own)[2]
    fine = pp.Continuous(3, 2, samples=2000)
    fine.points = lambda b, t: np.tile((np.arange(2000) + 0.5) / 2000, (len(b.marks), 1))
    exact, drawn, few = run(fine), run(pp.Continuous(3, 2, samples=64)), run(pp.Continuous(3, 2, samples=4))
    assert np.abs(drawn - exact).max() < 0.01 * exact.max()
    assert abs(few.sum() - exact.sum()) < 0.01 * exact.sum()


@pytest.fixture(scope="module")
def seqs(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = turns.withColumns({"ts": F.col("turn").cast("long") * 1000, "size": F.length("text") / 1000})
    mark = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return pp.sequences(rows, "conv_id", ["turn"], "ts", mark, ["size"], F.col("role") == "assistant", width=8)


@pytest.mark.parametrize("model", [pp.Gated(3, 1, size=6, embed=4), pp.Continuous(3, 1, size=6, embed=4)])
def test_loss_falls_and_scores_dont_depend_on_the_deal(spark, seqs, model):
    params, losses = pp.fit(seqs.repartition(40, "conv_id"), model, steps=8, rate=0.05)
    assert losses[-1] < losses[0] - 0.1
    few, many = (pp.total_gradient(seqs.repartition(n, "conv_id"), model, params) for n in (2, 40))
    assert abs(few[0] - many[0]) < 1e-9
    assert np.allclose(few[1], many[1])
    got = [{(r["conv_id"], r["id"]): r["p"] for r in pp.scores(seqs.repartition(n), "conv_id", model, params).collect()} for n in (1, 5)]
    assert got[0].keys() == got[1].keys()
    assert len(got[0]) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    assert max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-9


def test_nothing_to_train_on(spark, seqs):
    with pytest.raises(ValueError, match="no events"):
        pp.fit(seqs.filter("false"), pp.Gated(3, 1), steps=1)
