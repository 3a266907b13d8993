"""Readers, writers and the command line, on small files."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.__main__ import main
from alarmlens.operators import folds, models, profile, resampling
from alarmlens.sources import files


def test_csv_with_labels_of_its_own(spark, tmp_path):
    (tmp_path / "samples.csv").write_text("channel,segment,timestamp,value,sampling,anomaly,train\na,1,2024-01-01 00:00:01,2.5,1,,\na,1,2024-01-01 00:00:00,bad,1,,\nb,2,2024-01-02 00:00:00,3,1,,\n")
    (tmp_path / "segments.csv").write_text("segment,anomaly,train,sampling\n1,1,0,0.5\n2,0,1,1.0\n")
    rows = {(r.channel, r.t): r for r in files.read_samples(spark, str(tmp_path / "samples.csv"), str(tmp_path / "segments.csv")).collect()}
    assert rows["a", 0].value is None and rows["a", 1].value == 2.5 and rows["a", 1].anomaly == 1 and rows["b", 0].train == 1
    assert rows["a", 0].timestamp == datetime.datetime(2024, 1, 1)
    assert files.read_csv(spark, str(tmp_path / "samples.csv"), columns=["value"]).columns == ["value"]
    with pytest.raises(files.MissingInput):
        files.read_samples(spark, str(tmp_path / "nothing.csv"))
    (tmp_path / "twice.csv").write_text("segment,anomaly,train,sampling\n1,1,0,0.5\n1,0,1,1.0\n")
    with pytest.raises(ValueError):
        files.read_samples(spark, str(tmp_path / "samples.csv"), str(tmp_path / "twice.csv"))


def test_matrices_and_intervals(spark, tmp_path):
    np.save(tmp_path / "P-1.npy", np.arange(12.0).reshape(4, 3))
    np.save(tmp_path / "P-2.npy", np.arange(3.0))
    got = sorted((r.channel, r.t, r.value) for r in files.read_npy(spark, str(tmp_path)).collect())
    assert got == [("P-1", 0, 0.0), ("P-1", 1, 3.0), ("P-1", 2, 6.0), ("P-1", 3, 9.0), ("P-2", 0, 0.0), ("P-2", 1, 1.0), ("P-2", 2, 2.0)]
    (tmp_path / "machine-1.txt").write_text("1,2,3\n4,5,6\n")
    got = sorted((r.machine, r.row, r.dimension, r.value) for r in files.read_matrix(spark, str(tmp_path / "machine-1.txt"), 3).collect())
    assert got == [("machine-1", r, d, 1.0 + 3 * r + d) for r in range(2) for d in range(3)]
    rows = files.interval_rows(spark.createDataFrame([("c", "[[1, 5], [9, 12]]"), ("d", "[]"), ("e", None)], "chan string, anomalies string"), "anomalies")
    assert sorted((r.chan, r.first, r["last"]) for r in rows.collect()) == [("c", 1, 5), ("c", 9, 12)]


def test_markdown_tables_and_numbers(spark, tmp_path):
    text = "# A\n| x | y |\n|---|---|\n| 1 | 2 |\n## Results\ntext\n| n | v |\n|---|---|\n| a | **1,234** |\n| b | −0.5 |\n\nmore\n| z |\n|---|\n| 9 |\n"
    (tmp_path / "doc.md").write_text(text)
    rows = files.markdown_table(spark, str(tmp_path / "doc.md"), "Results").orderBy("row")
    assert [r.cells for r in rows.collect()] == [["a", "**1,234**"], ["b", "−0.5"]]
    assert [r.n for r in rows.select(files.number(F.col("cells")[1]).alias("n")).collect()] == [1234.0, -0.5]
    assert files.markdown_table(spark, str(tmp_path / "doc.md"), "Results", 1).first().cells == ["9"]
    one = spark.createDataFrame([("0.51 [0.44, −0.5]", "2.5×10⁻⁵", "12 %", "none")], "a string, b string, c string, d string")
    r = one.select(files.interval(F.col("a")).alias("a"), files.scientific(F.col("b")).alias("b"), files.number(F.col("c")).alias("c"), files.number(F.col("d")).alias("d")).first()
    assert (r.a.point, r.a.low, r.a.high) == (0.51, 0.44, -0.5) and r.b == pytest.approx(2.5e-5) and r.c == 12 and r.d is None


def test_command_line(spark, tmp_path):
    assert main(["layer1", "--synthetic", "--out", str(tmp_path), "--format", "csv"], spark) == 0
    kinds = {r.channel: r.channel_type for r in spark.read.option("header", True).csv(f"{tmp_path}/channel_classification").collect()}
    assert kinds == {"SYN_QUANT": "quantized", "SYN_FLOAT": "float_noise"}
    assert main(["layer2", "--synthetic", "--out", str(tmp_path)], spark) == 0
    summary = json.loads(spark.read.parquet(f"{tmp_path}/scope_summary").first().json)
    assert summary["n_included"] == len(summary["included_channels"])
    assert main(["layer1", "--samples", f"{tmp_path}/none.csv", "--out", str(tmp_path)], spark) == 1
    assert main(["layer3", "--out", str(tmp_path)], spark) == 1
    draws = spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "channel string, segment long, onset long")
    assert spark.read.parquet(files.save_onsets(draws, str(tmp_path))).where("channel = 'b'").first().onset == 3


def test_unknown_estimator(spark):
    with pytest.raises(ValueError):
        profile.estimated(files.synthetic(spark, 2, 5), "other")
    empty = files.synthetic(spark, 1, 5)  # its only segment is anomalous
    assert {(r.r, r.q, r.n_diff) for r in profile.estimated(empty, "mixture").collect()} == {(1e-14, 1e-14, 0)}


def test_fused_rule_equals_search(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), float(x), float(y)) for a, x, y in zip(rng.integers(0, 2, 80), rng.integers(0, 30, 80), rng.integers(0, 30, 80))]
    got = resampling.fused(spark.createDataFrame(rows, "anomaly int, x double, y double"), ["x", "y"], [0.1, 0.2]).collect()
    normal = [r for r in rows if r[0] == 0]
    rank = [min(sum(o[k] >= r[k] for o in normal) for k in (1, 2)) for r in normal]
    for r in got:
        best = max(q for q in set(rank) if sum(x <= q for x in rank) <= r.level * len(normal))
        assert r.q == pytest.approx(best / len(normal)) and r.joint_far <= r.level


def test_fitted_models_rank_separated_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"g{i // 3}", int(i % 2), float(rng.normal(3 * (i % 2), 1)), float(rng.normal()), float(rng.normal())) for i in range(120)]
    table = folds.balanced(spark.createDataFrame(rows, "id long, g string, label long, level double, diff double, diff2 double"), ["g"])
    scored = models.out_of_fold(table, ["level", "diff", "diff2"], "mlp_shallow", 5).collect()
    mean = [np.mean([r.probability for r in scored if r.label == y]) for y in (0, 1)]
    assert len(scored) == 120 and mean[1] > mean[0] + 0.3
    shares = {r.feature: r.share for r in models.attributions(table.withColumn("k", F.lit(1)), ["level", "diff", "diff2"], ["k"]).where("method = 'shap'").collect()}
    assert shares["level"] > 0.6 and sum(shares.values()) == pytest.approx(1)
