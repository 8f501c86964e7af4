"""Commands: ``python -m tickforge.commands fetch|train|generate|evaluate``, each with ``--help``.

``train`` cuts windows from a processed table or the store of bars, fits a generator and leaves
``model.npz`` and ``model.json`` beside the checkpoints; ``generate`` rebuilds the model from
them and writes windows; ``evaluate`` compares two tables or arrays of windows. Paths may be
local ones or URIs. Tables stay distributed; only models and reports pass the driver.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import features as feats
from tickforge.operators import fitting, generative, networks, report, training, windows
from tickforge.sources import files

KINDS = ("adversarial", "diffusion", "variational")


def options_of(kind: str, model: dict) -> dict:
    """A model's options from the section ``model`` of a configuration."""
    if kind == "diffusion":
        net = model.get("unet", {})
        names = {"widths": "hidden_dims", "embedding": "time_embed_dim", "blocks": "num_res_blocks", "groups": "group_norm_groups", "dropout": "dropout"}
        return {k: net[c] for k, c in names.items() if c in net}
    if kind == "variational":
        found = {"hidden": ("encoder_hidden_dim", 128), "latent": ("latent_dim", 32), "kind": ("rnn_type", "lstm"), "layers": ("encoder_num_layers", 2), "dropout": ("dropout", 0.1)}
    else:
        hidden = model.get("hidden_dim", 24)
        found = {"hidden": ("hidden_dim", 24), "noise": ("noise_dim", hidden), "layers": ("num_layers", 3), "kind": ("rnn_type", "gru"), "dropout": ("dropout", 0.0)}
    return {k: model.get(*c) for k, c in found.items()}


def schedule_of(spark: SparkSession, model: dict) -> DataFrame:
    """The noise schedule that the section ``model`` describes."""
    steps, kind = model.get("num_timesteps", 1000), model.get("noise_schedule", "cosine")
    if kind not in ("cosine", "linear"):
        raise ValueError(f"unknown noise schedule {kind!r}")
    if kind == "cosine":
        return generative.cosine_schedule(spark, steps)
    return generative.linear_schedule(spark, steps, model.get("beta_start", 1e-4), model.get("beta_end", 0.02))


def training_windows(spark: SparkSession, ticker: str, data: dict, processed: str, raw: str) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """(windows with split, scaler, columns) of the processed table, else of raw bars; None without either."""
    bars = files.load_processed(spark, processed, ticker, raw, data.get("interval", "1d"))
    if bars is None:
        return None
    bars = bars if "ticker" in bars.columns else bars.withColumn("ticker", F.lit(ticker))
    return windows.preprocess(bars, data.get("features"), data.get("window_size", 30), data.get("normalization", "minmax"), data.get("train_ratio", 0.7), data.get("val_ratio", 0.15))


def _fitted(spark: SparkSession, kind: str, model: networks.Parametrised, parts: dict[str, DataFrame], cfg: dict, folder: str, resume: bool) -> networks.Parametrised:
    """The model of least loss on held-out windows where there are any, else the last; the last of an adversarial one."""
    how = cfg.get("training", {})
    common = {"batch": how.get("batch_size", 64), "clip": how.get("gradient_clip", 1.0), "seed": how.get("seed", 42), "checkpoint": folder, "resume": resume}
    calls: tuple = (training.MetricLogger(how.get("log_interval", 1), f"{folder}/training.log"),)
    if kind == "adversarial":
        epochs = tuple(how.get(f"{p}_epochs", n) for p, n in (("autoencoder", 200), ("supervisor", 200), ("joint", 300)))
        rates = tuple(how.get(f"{p}_lr", r) for p, r in (("autoencoder", 1e-3), ("supervisor", 1e-3), ("generator", 1e-4)))
        return fitting.fit_adversarial(parts["train"], model, epochs, rates, callbacks=calls, **common)[0]
    if kind == "variational":
        warmup = how.get("kl_annealing_epochs", 50) if how.get("kl_annealing", True) else 0
        aims, epochs, rate = fitting.variational(how.get("kl_weight", 1.0), warmup), 300, 1e-3
    else:
        constants = generative.schedule_constants(schedule_of(spark, cfg.get("model", {})))
        bars = [r[0] for r in constants.orderBy("t").select("alpha_bar").collect()]  # the schedule alone
        aims, epochs, rate = fitting.denoising(bars), 500, 2e-4
    rate = how.get("lr", rate)
    if how.get("lr_scheduler") == "reduce_on_plateau":
        calls += (training.PlateauSchedule(rate, factor=how.get("lr_scheduler_factor", 0.5), patience=how.get("lr_scheduler_patience", 10)),)
    last, _ = fitting.fit(parts["train"], model, aims, how.get("epochs", epochs), rate, callbacks=calls, held_out=parts["val"], **common)
    best = f"{folder}/best.npz"
    return fitting.restored(best, model) if files.is_file(best) else last


def train(spark: SparkSession, args: argparse.Namespace) -> str:
    """Fits a generator; the folder's name is returned."""
    cfg = files.load_and_merge(*args.config)
    training.seed_everything(cfg.get("training", {}).get("seed", 42))
    found = training_windows(spark, args.ticker, cfg.get("data", {}), args.data_dir, args.raw_dir)
    if found is None:
        raise FileNotFoundError(f"no bars of {args.ticker} in {args.data_dir} or {args.raw_dir}")
    made, scaler, columns = found
    arrays = {k: windows.as_arrays(made.filter(F.col("split") == k), columns) for k in ("train", "val")}
    options = options_of(args.model, cfg.get("model", {}))
    model = _fitted(spark, args.model, fitting.build(args.model, len(columns), **options), arrays, cfg, args.checkpoint_dir, args.resume)
    files.save_checkpoint(f"{args.checkpoint_dir}/model.npz", model.parameters(), 0)
    about = {"kind": args.model, "options": options, "columns": columns, "length": cfg.get("data", {}).get("window_size", 30), "model": cfg.get("model", {}), "scaler": scaler.first().asDict()}
    files.write_bytes(f"{args.checkpoint_dir}/model.json", json.dumps(about, indent=2).encode())
    return args.checkpoint_dir


def generate(spark: SparkSession, args: argparse.Namespace) -> str:
    """Windows (ticker, window_id, step, columns) of a trained model, as parquet or one array; its path is returned."""
    about = json.loads(files.read_bytes(f"{args.checkpoint}/model.json"))
    columns, kind = about["columns"], about["kind"]
    weights, _ = files.load_checkpoint(f"{args.checkpoint}/model.npz")
    model = fitting.build(kind, len(columns), **about["options"]).with_parameters(weights)
    length = args.seq_length or about["length"]
    if kind == "diffusion":
        schedule = schedule_of(spark, about["model"])
        rows = generative.diffusion_sample(spark, schedule, model, args.num_samples, length, len(columns), args.sampler, args.steps, seed=args.seed)
    else:
        rows = model.generate(spark, args.num_samples, length, seed=args.seed)
    steps = rows.select(F.lit("synthetic").alias("ticker"), F.col("id").alias("window_id"), F.posexplode("values").alias("step", "x"))
    out = steps.select("ticker", "window_id", "step", *[F.col("x")[k].alias(c) for k, c in enumerate(columns)])
    if args.unscale:
        out = windows.scale(out, spark.createDataFrame([Row(**about["scaler"])]), columns, inverse=True)
    path = f"{args.output_dir}/{args.output_name or kind + '_synthetic'}.{args.format}"
    if args.format == "npy":
        files.save_array(out, path, columns)
    else:
        out.write.mode("overwrite").parquet(path)
    return path


def load_windows(spark: SparkSession, path: str, length: int = 30, stride: int = 1) -> DataFrame:
    """Windows of a table or array: as they are, or cut from rows by Date, whose missing returns and volumes are derived.

    An array of as many features as the default ones has their names, else f0, f1 and so on.
    """
    rows = files.load_table(spark, path)
    if {"window_id", "step"} <= set(rows.columns):
        if rows.columns[2:] == [f"f{k}" for k in range(len(windows.DEFAULT_FEATURES))]:
            rows = rows.toDF("window_id", "step", *windows.DEFAULT_FEATURES)
        names = [c for c in feats.numeric_columns(rows) if c not in ("window_id", "step")]
        ticker = F.col("ticker") if "ticker" in rows.columns else F.lit("all")
        return rows.select(ticker.alias("ticker"), "window_id", "step", *names)
    if "Date" not in rows.columns:
        raise ValueError(f"{path}: neither windows (window_id, step) nor rows with a Date")
    rows = rows if "ticker" in rows.columns else rows.withColumn("ticker", F.lit("all"))
    if "LogReturn" not in rows.columns:
        rows = windows.derive(rows)
    names = feats.numeric_columns(rows)
    return windows.create_windows(rows.dropna(subset=names), length, names, stride)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The report on real against synthetic windows, by the columns that both have."""
    real, made = (load_windows(spark, p, args.window_size, args.stride) for p in (args.real_data, args.synthetic_data))
    columns = [c for c in real.columns if c in made.columns and c not in ("ticker", "window_id", "step")]
    if missing := {args.returns, args.volume} - set(columns):
        raise ValueError(f"not in both: {', '.join(sorted(missing))}")
    real, made = (w.select("ticker", "window_id", "step", *columns) for w in (real, made))
    return report.compute_all_metrics(real, made, columns, args.returns, args.volume, args.output, not args.no_tstr)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tickforge", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    out.add_argument("--log-level", default="INFO")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda f: commands.add_parser(f.__name__, help=f.__doc__.split("\n")[0], formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    one = add(train)
    one.add_argument("--model", required=True, choices=KINDS)
    one.add_argument("--config", nargs="*", default=[], help="YAML files, later ones winning")
    one.add_argument("--ticker", required=True)
    one.add_argument("--data-dir", default="data/processed")
    one.add_argument("--raw-dir", default="data/raw")
    one.add_argument("--checkpoint-dir", default="checkpoints")
    one.add_argument("--resume", action="store_true")
    one = add(generate)
    one.add_argument("--checkpoint", required=True, help="the folder that train left")
    one.add_argument("--num-samples", type=int, default=1000)
    one.add_argument("--seq-length", type=int, default=None, help="the training windows' if none is given")
    one.add_argument("--sampler", default="ddim", choices=("ddim", "ddpm"))
    one.add_argument("--steps", type=int, default=50)
    one.add_argument("--unscale", action="store_true", help="undo the scaling of the training windows")
    one.add_argument("--format", default="parquet", choices=("parquet", "npy"))
    one.add_argument("--output-dir", default="data/synthetic")
    one.add_argument("--output-name", default=None)
    one.add_argument("--seed", type=int, default=42)
    one = add(evaluate)
    one.add_argument("--real-data", required=True)
    one.add_argument("--synthetic-data", required=True)
    one.add_argument("--output", default="reports")
    one.add_argument("--window-size", type=int, default=30)
    one.add_argument("--stride", type=int, default=1)
    one.add_argument("--returns", default="LogReturn")
    one.add_argument("--volume", default="Volume")
    one.add_argument("--no-tstr", action="store_true")
    return out


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["fetch"]:
        return files.main(argv[1:])
    args = parser().parse_args(argv)
    log = files.setup_logging(args.log_level)
    found = {"train": train, "generate": generate, "evaluate": evaluate}[args.command](SparkSession.builder.getOrCreate(), args)
    if args.command != "evaluate":
        log.info("written: %s", found)
        return None
    print(f"realism score {found['realism_score']:.3f}\nMMD {found['mmd']:.4f}")
    if "tstr" in found:
        print(f"accuracy gap {found['tstr']['gap']['accuracy']:.3f}")
    return None


if __name__ == "__main__":
    main()
