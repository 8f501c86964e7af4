"""Training, generating and evaluating from the command line, on small models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge import commands
from tickforge.operators import windows
from tickforge.plans import registry
from tickforge.sources import files

CONFIG = """
data: {window_size: 10}
model: {hidden_dim: 4, num_layers: 2, encoder_hidden_dim: 6, latent_dim: 2, num_timesteps: 8, noise_schedule: linear,
        unet: {hidden_dims: [4, 8, 4], time_embed_dim: 6, num_res_blocks: 1, group_norm_groups: 2}}
training: {epochs: 2, autoencoder_epochs: 1, supervisor_epochs: 1, joint_epochs: 1, lr: 0.01, lr_scheduler: reduce_on_plateau}
"""


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """(folder, ticker): a store of bars and a configuration."""
    folder = tmp_path_factory.mktemp("commands")
    bars = registry._bars(spark, sf_dir).filter("ticker = 'AF' AND Date < '1996-06-01'")
    bars.write.parquet(f"{folder}/bars.parquet")
    (folder / "config.yaml").write_text(CONFIG)
    commands.main(["fetch", f"{folder}/bars.parquet", "--tickers", "AF", "--output-dir", f"{folder}/raw"])
    return str(folder), "AF"


def train(stored, kind, *more):
    folder, ticker = stored
    out = f"{folder}/{kind}"
    commands.main(["train", "--model", kind, "--config", f"{folder}/config.yaml", "--ticker", ticker, "--data-dir", f"{folder}/none", "--raw-dir", f"{folder}/raw", "--checkpoint-dir", out, *more])
    return out


@pytest.mark.parametrize("kind", commands.KINDS)
def test_trains_and_generates(spark, stored, kind):
    out = train(stored, kind)
    about = json.loads(files.read_bytes(f"{out}/model.json"))
    assert about["columns"] == windows.DEFAULT_FEATURES and about["length"] == 10
    commands.main(["generate", "--checkpoint", out, "--num-samples", "5", "--steps", "4", "--format", "npy", "--output-dir", out])
    made = np.load(f"{out}/{kind}_synthetic.npy")
    assert made.shape == (5, 10, 8) and np.isfinite(made).all()
    loaded = commands.load_windows(spark, f"{out}/{kind}_synthetic.npy")
    assert loaded.columns == ["ticker", "window_id", "step", *windows.DEFAULT_FEATURES]
    assert np.array_equal(windows.item(loaded, -1, windows.DEFAULT_FEATURES), made[4])
    with pytest.raises(IndexError):
        windows.item(loaded, 5, ["Open"])


def test_resumed_training_stops_where_it_was(stored):
    out = train(stored, "variational")
    lines = files.read_bytes(f"{out}/training.log").decode().splitlines()
    before = files.load_checkpoint(f"{out}/model.npz")[0]
    train(stored, "variational", "--resume")
    after = files.load_checkpoint(f"{out}/model.npz")[0]
    assert all(np.array_equal(before[k], after[k]) for k in before)
    assert files.read_bytes(f"{out}/training.log").decode().splitlines() == lines
    assert lines[-1].startswith("epoch 2: loss ") and "val_loss" in lines[-1]


def test_adversarial_phases_resume_by_themselves(stored):
    out = train(stored, "adversarial", "--resume")
    epochs = [files.load_checkpoint(f"{out}/{phase}/last.npz")[1]["epoch"] for phase in ("autoencoder", "supervisor", "joint")]
    assert epochs == [1, 1, 1]


def test_evaluates_windows_against_bars(spark, stored, capsys):
    folder, _ = stored
    out = train(stored, "variational")
    commands.main(["generate", "--checkpoint", out, "--num-samples", "60", "--unscale", "--output-dir", folder, "--output-name", "made"])
    made = spark.read.parquet(f"{folder}/made.parquet")
    assert made.count() == 600
    # undone scaling: prices of the order of the bars'
    low, high = spark.read.parquet(f"{folder}/bars.parquet").agg(F.min("Close"), F.max("Close")).first()
    middle = made.agg(F.avg("Close")).first()[0]
    assert low - (high - low) < middle < high + (high - low)
    commands.main(["evaluate", "--real-data", f"{folder}/bars.parquet", "--synthetic-data", f"{folder}/made.parquet", "--output", f"{folder}/reports", "--window-size", "10", "--stride", "5", "--no-tstr"])
    assert "realism score" in capsys.readouterr().out
    found = json.loads(files.read_bytes(f"{folder}/reports/evaluation_report.json"))
    assert set(found["ks_tests"]) == set(windows.DEFAULT_FEATURES) and 0 <= found["realism_score"] <= 1


def test_refuses_what_it_cannot_read(spark, stored, tmp_path):
    folder, _ = stored
    with pytest.raises(FileNotFoundError):
        train((folder, "none"), "diffusion")
    spark.range(3).write.parquet(f"{tmp_path}/ids.parquet")
    with pytest.raises(ValueError, match="neither windows"):
        commands.load_windows(spark, f"{tmp_path}/ids.parquet")
    with pytest.raises(ValueError, match="unknown noise schedule"):
        commands.schedule_of(spark, {"noise_schedule": "other"})
    assert commands.options_of("diffusion", {}) == {}
