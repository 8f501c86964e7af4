"""Gradients against differences, and training on small series."""

import numpy as np
import pytest

from tickforge.operators import fitting, generative, networks, training
from tickforge.plans import registry
from tickforge.sources import files


def series(spark, n=60, length=8, features=2, parts=3):
    rng = np.random.default_rng(5)
    x = np.sin(rng.uniform(0, 6, (n, 1, 1)) + 0.5 * np.arange(length)[None, :, None]) * 0.4 + 0.5 + 0.02 * rng.normal(size=(n, length, features))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, values array<array<double>>").repartition(parts)


def models():
    bars = np.linspace(0.99, 0.1, 10)
    small = lambda kind: networks.AdversarialModel(2, hidden=4, noise=3, kind=kind)
    yield from [(small("gru"), o) for o in (*fitting.autoencoding(), *fitting.supervising(), *fitting.adversarial())]
    yield from [(small("lstm"), o) for o in fitting.autoencoding()]
    yield from [(networks.VariationalModel(2, 5, 3, "lstm"), o) for o in fitting.variational(warmup=0)]
    yield from [(networks.VariationalModel(2, 5, 3, layers=layers, dropout=0.3), o) for layers in (1, 3) for o in fitting.variational(warmup=0)]
    yield from [(networks.Denoiser(2, (4, 8, 4), 6, blocks, 2), o) for blocks in (1, 2) for o in fitting.denoising(bars)]


@pytest.mark.parametrize("model,aim", list(models()), ids=str)
def test_gradients_are_differences(model, aim):
    weights = model.parameters()
    x = np.random.default_rng(1).uniform(size=(5, 6, 2))
    at = lambda w: fitting.loss_and_gradients(model, w, aim, x, np.random.default_rng(2), 3)
    _, found = at(weights)
    assert {k.split(".")[0] for k in found} == set(aim.moves)
    rng = np.random.default_rng(3)
    for k in sorted(found):
        i = tuple(int(rng.integers(n)) for n in weights[k].shape)
        values = []
        for off in (1e-5, -1e-5):
            moved = {**weights, k: weights[k].copy()}
            moved[k][i] += off
            values.append(at(moved)[0])
        assert np.isclose((values[0] - values[1]) / 2e-5, found[k][i], rtol=1e-3, atol=1e-6), k


def test_default_denoiser_keeps_one_skip_a_level():
    net = networks.Denoiser()
    assert [a for _, a, _, joins in net.plan if joins] == [384, 192]
    assert networks.Denoiser(2, (16, 32, 16), 8, 1)(np.ones((3, 5, 2)), 4).shape == (3, 5, 2)
    with pytest.raises(ValueError):
        networks.Denoiser(2, (6, 6, 6), 8, 1, 4)(np.ones((1, 5, 2)), 0)


def test_dropout_works_in_training_alone():
    x = np.random.default_rng(1).uniform(size=(40, 6, 2))
    for model, run in [(networks.VariationalModel(2, 8, 3, layers=2, dropout=0.5), lambda m: m.encode(x)[0]), (networks.Denoiser(2, (4, 8, 4), 6, 1, 2, dropout=0.5), lambda m: m(x, 3))]:
        assert np.array_equal(run(model), run(model))
        one, same, other = (run(model.training(np.random.default_rng(k))) for k in (1, 1, 2))
        assert np.array_equal(one, same) and not np.allclose(one, other) and not np.allclose(one, run(model))
    kept = networks.dropped(np.ones((400, 400)), 0.25, np.random.default_rng(3))
    assert set(np.unique(kept)) == {0.0, 1 / 0.75} and abs(kept.mean() - 1) < 0.01
    deep = networks.VariationalModel(2, 8, 3, "lstm").parameters()
    assert deep["encoder.in1"].shape == (32, 8) and deep["decoder.in1"].shape == (32, 8)


def test_variational_training(spark):
    model, history = fitting.fit(series(spark), fitting.build("variational", 2, hidden=8, latent=2), fitting.variational(0.01, 5), 12, 0.02, 4)
    assert history["loss"][-1] < 0.5 * history["loss"][0]
    again, same = fitting.fit(series(spark), fitting.build("variational", 2, hidden=8, latent=2), fitting.variational(0.01, 5), 1, 0.02, 4)
    assert np.isclose(same["loss"][0], history["loss"][0])
    assert model.generate(spark, 4, 8).count() == 4


def test_adversarial_training(spark):
    model, history = fitting.fit_adversarial(series(spark), fitting.build("adversarial", 2, hidden=6, noise=2, layers=1), (8, 4, 3), rate=0.02, batch=10)
    assert history["autoencoder.e_loss"][-1] < 0.8 * history["autoencoder.e_loss"][0]
    assert history["supervisor.s_loss"][-1] < history["supervisor.s_loss"][0]
    assert len(history["joint.d_loss"]) == 3 and np.isfinite([v for x in history.values() for v in x]).all()
    assert model.generate(spark, 3, 8).count() == 3


def test_diffusion_training(spark):
    schedule = generative.linear_schedule(spark, 10)
    bars = [r[0] for r in generative.schedule_constants(schedule).orderBy("t").select("alpha_bar").collect()]
    rate = training.PlateauSchedule(0.01, "loss", patience=1)
    model, history = fitting.fit(series(spark), fitting.build("diffusion", 2, widths=(4, 8, 4), embedding=8, blocks=1, groups=2), fitting.denoising(bars), 10, 0.01, 10, callbacks=(rate,))
    assert history["loss"][-1] < history["loss"][0]
    assert generative.diffusion_sample(spark, schedule, model, 3, 8, 2, "ddpm").count() == 3


def test_validation_best_checkpoint_and_resume(spark, tmp_path):
    rows, held = series(spark).filter("id < 40"), series(spark).filter("id >= 40")
    start = lambda: fitting.build("variational", 2, hidden=4, latent=2)
    options = {"rate": 0.02, "batch": 8, "held_out": held}
    whole, history = fitting.fit(rows, start(), fitting.variational(), 4, checkpoint=str(tmp_path / "a"), **options)
    assert len(history["val_loss"]) == 4 and np.isfinite(history["val_loss"]).all()
    _, meta = files.load_checkpoint(str(tmp_path / "a" / "best.npz"))
    assert meta["epoch"] == int(np.argmin(history["val_loss"])) + 1 and meta["metrics"]["val_loss"] == min(history["val_loss"])
    last = fitting.restored(str(tmp_path / "a" / "last.npz"), start())
    assert all(np.array_equal(v, whole.parameters()[k]) for k, v in last.parameters().items())
    # two epochs and two more are the four
    fitting.fit(rows, start(), fitting.variational(), 2, checkpoint=str(tmp_path / "b"), **options)
    again, more = fitting.fit(rows, start(), fitting.variational(), 4, checkpoint=str(tmp_path / "b"), resume=True, **options)
    assert more["val_loss"] == pytest.approx(history["val_loss"][2:])
    assert all(v == pytest.approx(whole.parameters()[k]) for k, v in again.parameters().items())


def test_no_rows_and_unknown_kind(spark):
    start = fitting.build("variational", 2, hidden=3, latent=2)
    model, history = fitting.fit(series(spark).limit(0), start, fitting.variational(), 1)
    assert np.isnan(history["loss"]).all() and all(np.array_equal(v, start.parameters()[k]) for k, v in model.parameters().items())
    with pytest.raises(ValueError):
        fitting.build("other", 2)
    stop = training.EarlyStopping(1)
    _, history = fitting.fit(series(spark), start, fitting.variational(), 5, rate=0.0, stop=lambda x: stop(1.0))
    assert len(history["loss"]) == 2


def test_training_queries_see_all_windows(spark, sf_dir, monkeypatch):
    bars, seen = registry._bars(spark, sf_dir), []
    # a return needs a bar before; a window of 30 begins at each but the last 29 of the others
    want = sum(r["count"] - 1 - 29 for r in bars.groupBy("ticker").count().collect() if r["count"] > 30)
    monkeypatch.setattr(fitting, "fit", lambda rows, model, *_: (seen.append(rows.count()), (model, {}))[1])
    registry.queries()["n11_variational_training"](spark, sf_dir)
    assert seen == [want]
