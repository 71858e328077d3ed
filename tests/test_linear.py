import numpy as np
import pytest
from pyspark.sql import functions as F

from latora.operators import factor, rank
from latora.operators.model import LatentModel, fit_latent_model
from latora.operators.scaling import fit_scaler


def frame(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "song_id long, features array<double>").repartition(3)


@pytest.mark.parametrize("backend", factor.BACKENDS)
@pytest.mark.parametrize("shape", [(60, 5), (6, 6), (4, 7), (5, 1)])
def test_svd_matches_dense(spark, backend, shape):
    x = np.random.default_rng(3).standard_normal(shape)
    found = factor.svd(frame(spark, x), shape[1], shape[0], backend=backend, seed=1)
    sigma = np.linalg.svd(x, compute_uv=False)
    r = len(sigma)
    assert np.allclose(found.sigma[:r], sigma, rtol=1e-6)
    assert np.allclose(found.vt[:r] @ found.vt[:r].T, np.eye(r), atol=1e-7)
    lead = found.vt[np.arange(len(found.vt)), np.abs(found.vt).argmax(axis=1)]
    assert (lead > 0).all()


def test_tsqr_keeps_small_values(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 6)) + 1e-9 * rng.standard_normal((400, 6))
    sigma = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(factor.svd(frame(spark, x), 6, 400).sigma, sigma, rtol=1e-4)


def test_svd_rejects(spark):
    with pytest.raises(ValueError):
        factor.svd(frame(spark, np.eye(2)), 2, 2, backend="other")
    with pytest.raises(ValueError):
        factor.svd(frame(spark, np.eye(2)), 2, 2, k=-1)
    with pytest.raises(Exception, match="finite"):
        factor.svd(frame(spark, np.array([[1.0, float("inf")]])), 2, 1)
    with pytest.raises(ValueError):
        factor.symmetric_eigen(np.array([[1.0, 2.0], [0.0, 1.0]]))


@pytest.mark.parametrize("method", ["householder", "mgs"])
def test_qr(method):
    a = np.random.default_rng(1).standard_normal((8, 4))
    q, r = factor.qr(a, method)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(4)) and np.allclose(np.tril(r, -1), 0)


def test_scalers(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    df = frame(spark, x)
    z = fit_scaler(df, ("a", "b"))
    assert z.center == pytest.approx((7 / 3, 5)) and z.scale == pytest.approx((x[:, 0].std(), 1))
    assert fit_scaler(df, ("a", "b"), "robust").scale == pytest.approx((1.5, 1))
    back = df.select(z.inverse_transform(z.transform(F.col("features"))).alias("v")).collect()
    assert np.allclose(sorted(r.v for r in back), sorted(x.tolist()))
    with pytest.raises(ValueError):
        fit_scaler(frame(spark, np.array([[float("nan"), 1.0]])), ("a", "b"))
    with pytest.raises(ValueError):
        fit_scaler(df, ("a", "b"), "other")


def test_ranks():
    assert rank.by_variance([10, 5, 2, 1, 0.5]) == 2 and rank.by_variance([5, 4, 3, 2, 1], 1.0) == 5
    assert rank.by_elbow([100, 90, 80, 4, 3.5, 3, 2.5, 2]) == 3
    assert "clamped" in str(rank.select_rank([5, 4], 99)) and rank.select_rank([4, 3], 1).cumulative_variance == pytest.approx(16 / 25)
    with pytest.raises(ValueError, match="descending"):
        rank.select_rank([1, 5])
    with pytest.raises(ValueError):
        rank.select_rank([5, 1], True)
    assert rank.marchenko_pastur_median(1.0) == pytest.approx(0.6529, abs=1e-3)
    rng = np.random.default_rng(5)
    x = 8 * rng.standard_normal((200, 4)) @ rng.standard_normal((4, 60)) + rng.standard_normal((200, 60))
    assert rank.by_gavish_donoho(np.linalg.svd(x, compute_uv=False), 200, 60) == 4


def test_model(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((80, 4)) * [1, 2, 3, 4]
    df = frame(spark, x)
    names = ("a", "b", "c", "d")
    model = fit_latent_model(df, names, 4)
    back = np.array([r.v for r in df.select("song_id", model.inverse_transform(model.transform(F.col("features"))).alias("v")).orderBy("song_id").collect()])
    assert np.allclose(back, x) and model.explained_variance().sum() == pytest.approx(1)
    white = model.with_whiten(True)
    latent = np.array([r.v for r in df.select(white.transform(F.col("features")).alias("v")).collect()])
    assert np.allclose(latent.T @ latent, np.eye(4))
    model.save(spark, str(tmp_path / "m"))
    loaded = LatentModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(loaded.components, model.components) and loaded.selection == model.selection
    assert len(model.loadings(1)) == 4 and model.describe_component(1, 1)[0] in "+-"
    with pytest.raises(IndexError):
        model.loadings(5)
    with pytest.raises(ValueError):
        fit_latent_model(df, names, 0)


@pytest.mark.parametrize("method", ["qr", "jacobi"])
def test_symmetric_eigen(method):
    a = np.random.default_rng(8).standard_normal((7, 7))
    a = a + a.T
    values, vectors = factor.symmetric_eigen(a, method)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a)
    assert np.allclose(factor.symmetric_eigen(np.zeros((3, 3)), method)[0], 0)
