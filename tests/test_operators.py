"""Properties of single operators, on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.functions import distributions
from alarmlens.operators import alarms, bocpd, inference, meta, profile
from alarmlens.sources.telemetry import differences


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [("a", s, t, float(v), 0) for s in range(3) for t, v in enumerate(rng.normal(0, 1, 30))]
    return spark.createDataFrame(rows, "channel string, segment long, t long, value double, anomaly int")


def test_kalman_equals_matrix_form(spark, series):
    noise = spark.createDataFrame([("a", 0.5, 0.1)], "channel string, r double, q double")
    got = {(r.segment, r.t): (r.nu, r.s) for r in profile.kalman(series, noise).collect()}
    a, h, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0]), np.diag([0.0, 0.1])
    for segment in range(3):
        x, p = np.zeros(2), np.eye(2) * 10
        for r in series.where(F.col("segment") == segment).orderBy("t").collect():
            x, p = a @ x, a @ p @ a.T + q
            s, nu = h @ p @ h + 0.5, r.value - h @ x
            assert got[segment, r.t] == pytest.approx((nu, s))
            k = p @ h / s
            x, p = x + k * nu, p - np.outer(k, h @ p)


def test_second_differences_cross_segments(series):
    rows = differences(series)
    got = sorted(r.dd for r in profile.second_differences(rows).collect())
    d = np.concatenate([np.diff([r.value for r in series.where(F.col("segment") == s).orderBy("t").collect()]) for s in range(3)])
    assert got == pytest.approx(sorted(np.diff(d)))


def run_lengths(values, forgetting=True):
    lengths = bocpd.RunLengths(bocpd.Tables(forgetting))
    return [lengths.step(v).copy() for v in values]


def test_run_lengths_sum_to_one_and_find_a_shift():
    rng = np.random.default_rng(1)
    found = run_lengths(np.concatenate([rng.normal(0, 1, 80), rng.normal(20, 1, 20)]))
    assert all(abs(p.sum() - 1) < 1e-9 for p in found)
    assert found[82].argmax() <= 4 and found[79].argmax() > 5


def test_long_run_lengths_are_one_group():
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1, 2500), np.repeat(rng.normal(0, 1, 20), 60), rng.normal(5, 2, 1300)])
    apart = bocpd.Tables(True).up_to(8192)
    assert apart.settled < 1500 and bocpd.Tables(False).up_to(8192).settled == np.inf
    apart.settled = np.inf  # so nothing joins
    grouped, plain, resets = bocpd.RunLengths(bocpd.Tables(True)), bocpd.RunLengths(apart), 0
    for i, v in enumerate(values):
        grouped.step(v), plain.step(v)
        assert grouped.likeliest() == plain.p.argmax()
        assert len(grouped.p) < 2600
    assert len(plain.p) == len(values) + 1 == len(grouped.posterior()) and grouped.posterior() == pytest.approx(plain.p, rel=1e-9, abs=1e-15)


def test_group_without_probability_takes_the_next_run_length():
    lengths = bocpd.RunLengths(bocpd.Tables(True))
    for v in np.random.default_rng(8).normal(0, 1, 2500):
        lengths.step(v)
    lengths.p[-1] = 0
    lengths._join()
    assert lengths.posterior().sum() == pytest.approx(lengths.p.sum()) and (lengths.posterior()[len(lengths.p) :] == 0).all()


def test_detector_hands_on_long_posteriors_in_several_batches(spark, monkeypatch):
    rows = spark.createDataFrame([("a", s, t, float((t * 7919 + s) % 101)) for s in range(5) for t in range(40 + s)], "channel string, segment long, t long, value double")
    params = spark.createDataFrame([("a", 1.0, 0.01)], "channel string, r double, q double")
    want = sorted(bocpd.detect(rows, params, whole=True).collect())
    monkeypatch.setattr(bocpd, "BATCH_CANDIDATES", 1)
    assert [len(r.candidates) for r in want] == [26 + s for s in range(5)] and sorted(bocpd.detect(rows, params, whole=True).collect()) == want
    assert all(r.candidates is None for r in bocpd.detect(rows, params).collect())


def test_draws_meet_candidates_from_one_pass(spark):
    from alarmlens.operators import onsets

    p = np.random.default_rng(9).dirichlet(np.ones(3000))
    found = spark.createDataFrame([("a", 1, [(10 + i, float(x)) for i, x in enumerate(p)])], "channel string, segment long, candidates array<struct<onset:long,p:double>>")
    draws = onsets.drawn(found)
    rows = draws.withColumn("u", onsets.uniform("mc", "channel", "segment", "draw")).collect()
    assert len(rows) == 200 and all(r.onset == 10 + min(np.searchsorted(np.cumsum(p), r.u), 2999) for r in rows)
    assert "currentrow$(), unboundedfollowing$()" not in draws._jdf.queryExecution().toString().lower()  # a frame that costs a pass for each row


def test_many_pivots_are_tested_from_pieces(spark):
    from alarmlens.operators import effects

    rng = np.random.default_rng(11)
    values = {s: [None if rng.random() < 0.05 else float(v) for v in 1e4 + rng.normal(0, 1, 60)] for s in range(3)}
    rows = spark.createDataFrame([("a", s, t, v) for s, x in values.items() for t, v in enumerate(x)], "channel string, segment long, t long, value double")
    points = spark.createDataFrame([("a", s, t) for s in (0, 1) for t in (3, 5, 6, 9, 17, 30, 31, 54, 58, 59, 80)], "channel string, segment long, pivot_t long")
    want = {(r.segment, r.pivot_t): r for r in effects.welch(rows, points.withColumn("skip_reason", F.lit(""))).collect()}
    got = {(r.segment, r.pivot_t): r for r in effects.welch_many(rows, points).collect()}
    assert set(got) == set(want) and len(got) == 22
    for key, r in want.items():
        assert [x is None for x in got[key]] == [x is None for x in r] and [x for x in got[key][3:] if x is not None] == pytest.approx([x for x in r[3:] if x is not None], rel=1e-7)


def test_many_pivots_read_the_samples_once(spark):
    from alarmlens.operators import effects

    rows = spark.createDataFrame([("a", 1, t, float(t % 7)) for t in range(40)], "channel string, segment long, t long, value double")
    points = spark.createDataFrame([("a", 1, 15), ("a", 1, 20)], "channel string, segment long, pivot_t long")
    plan = effects.welch_many(rows, points)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD" in line and "value#" in line for line in plan.splitlines()) == 1


def test_summaries_of_segments_are_kept_for_pooling(spark):
    from alarmlens.plans import onsets as plans

    draws = spark.createDataFrame([], "channel string, segment long, draw long, onset long")
    summary = plans._summary(spark, "/root/testdata/sf0.001", draws)
    assert summary.storageLevel.useDisk
    summary.unpersist()


def test_strata_without_variance_have_no_p(spark):
    from alarmlens.operators import inference

    tables = spark.createDataFrame([(6, 0, 24, 0), (7, 0, 28, 0)], "a long, b long, c long, d long")
    assert tuple(inference.mantel_haenszel(tables).first()) == (None, None, None)


def test_detector_finds_a_shift_after_a_quiet_run(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 250), rng.normal(60, 1, 30)])
    rows = spark.createDataFrame([("a", 1, t, float(v)) for t, v in enumerate(values)] + [("a", 2, t, 0.0) for t in range(4)] + [("b", 1, 0, None)], "channel string, segment long, t long, value double")
    params = spark.createDataFrame([("a", 1.0, 0.01), ("b", 1.0, 0.01)], "channel string, r double, q double")
    got = {(r.channel, r.segment): r for r in bocpd.detect(rows, params, whole=True).collect()}
    r = got["a", 1]
    assert abs(r.onset - 250) <= 3 and r.confirm >= r.onset and 0 < r.confidence <= 1 and r.runs[0].run == 0
    assert abs(sum(c.p for c in r.candidates) - 1) < 1e-9 and all(10 <= c.onset <= 275 for c in r.candidates)
    assert got["a", 2].onset is None and got["a", 2].candidates == [] and len(got) == 2
    assert bocpd.detect(rows.where("false"), params).count() == 0
    with pytest.raises(ValueError):
        bocpd.Filter(-1.0, 0.0)


def test_forgetting_caps_the_weight_of_the_past():
    capped, free = bocpd.Tables(True).up_to(100), bocpd.Tables(False).up_to(100)
    assert capped.kappa.max() == 40 and free.kappa[99] == 100 and (capped.alpha >= 1e-3).all() and free.alpha[99] == 50.5


def test_tail_probabilities():
    d = distributions
    assert d.normal_tail([1.96, 0, -1]) == pytest.approx([0.0249979, 0.5, 0.8413447], abs=1e-6)
    assert d.t_two_sided([2.0, 0.5, 0.0], [10, 3.3, 5]) == pytest.approx([0.0733880, 0.6485351, 1.0], abs=1e-6)
    assert d.chi2_tail([3.841459, 10, 0], [1, 4, 2]) == pytest.approx([0.05, 0.0404277, 1.0], abs=1e-6)
    for n1, n0 in ((5, 6), (6, 5), (3, 9)):
        sums = [sum(x) - n1 * (n1 + 1) / 2 for x in itertools.combinations(range(1, n1 + n0 + 1), n1)]
        for u in (0, 7, 14, n1 * n0):
            assert d.rank_sum_tail(u, n1, n0) == pytest.approx(np.mean(np.array(sums) >= u))
    signs = [sum(r for r, b in zip(range(1, 9), bits) if b) for bits in itertools.product((0, 1), repeat=8)]
    assert d.signed_rank_two_sided(3, 8) == pytest.approx(2 * np.mean(np.array(signs) <= 3))


def test_mann_whitney_counts_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("x", float(v), bool(g)) for v, g in zip(rng.integers(0, 12, 60), rng.integers(0, 2, 60))]
    df = spark.createDataFrame(rows, "g string, v double, pos boolean")
    a, b = ([v for _, v, g in rows if g == side] for side in (True, False))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert inference.mann_whitney(df, ["g"], "v", "pos").first().u == u
    assert inference.auroc(df, ["g"], "v", "pos").first().auroc == pytest.approx(u / len(a) / len(b))
    assert inference.mann_whitney(df.where("false"), ["g"], "v", "pos").count() == 0


def test_weighted_auroc_equals_repeated_rows(spark):
    rows = [(1.0, True, 2.0), (2.0, False, 3.0), (2.0, True, 1.0), (0.5, False, 2.0)]
    df = spark.createDataFrame(rows, "v double, pos boolean, w double")
    repeated = spark.createDataFrame([(v, p) for v, p, w in rows for _ in range(int(w))], "v double, pos boolean")
    assert inference.auroc(df, [], "v", "pos", "w").first()[0] == pytest.approx(inference.auroc(repeated, [], "v", "pos").first()[0])


def test_false_discovery_is_monotone(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5, None)], "p double")
    got = [r.q_value for r in inference.benjamini_hochberg(df, "p").orderBy("p").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert [r.p_bonferroni for r in inference.bonferroni(df, "p").where("p IS NOT NULL").orderBy("p").collect()] == pytest.approx([0.04, 0.12, 0.16, 1.0])


def test_single_study_has_no_pooled_effect(spark):
    one = spark.createDataFrame([("f", 1.0, 0.5)], "f string, yi double, vi double")
    assert meta.pooled(one, ["f"]).first().mu is None
    same = spark.createDataFrame([("f", 1.0, 0.5)] * 4, "f string, yi double, vi double")
    row = meta.pooled(same, ["f"]).first()
    assert (row.mu, row.tau2, row.i2) == (1.0, 0.0, 0.0)


def test_joint_false_alarm_is_largest_within_level(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (80, 2)).astype(float)
    df = spark.createDataFrame([(0, *map(float, r)) for r in x], "anomaly int, a double, b double")
    got = alarms.joint_false_alarm(df, ["a", "b"], 0.2).first()
    fires = np.min([[(x[:, f] >= v).sum() for v in x[:, f]] for f in range(2)], axis=0)
    allowed = [r for r in fires if (fires <= r).mean() <= 0.2]
    assert got.q == pytest.approx(max(allowed) / 80) and got.joint_far <= 0.2


def test_repartitioning_changes_nothing(spark, series):
    one, many = (sorted(profile.noise_mixture(series.repartition(n)).collect()) for n in (1, 16))
    assert one == many


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    for name in ("alarmlens.llm", "alarmlens.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it fails
    assert not any(n.startswith("op") for n in __spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fisher_exact_of_known_tables(spark):
    from alarmlens.operators import evidence

    rows = spark.createDataFrame([("x", 8, 2, 1, 5), ("y", 0, 5, 0, 5), ("z", 0, 0, 0, 0)], "channel string, a long, b long, c long, d long")
    got = {r["channel"]: r for r in evidence.fisher_exact(rows, ["channel"]).collect()}
    assert abs(got["x"]["p_value"] - 400 / 11440) < 1e-9 and got["x"]["odds_ratio"] == 20
    assert got["y"]["p_value"] == got["z"]["p_value"] == 1 and got["y"]["odds_ratio"] is None


def test_best_lag_finds_a_shift(spark):
    from alarmlens.operators import evidence

    wave = [((7 * i * i) % 97) / 3.0 for i in range(45)]
    rows = spark.createDataFrame([("x", k, wave[k], wave[k - 4] if k >= 4 else None) for k in range(40)], "channel string, k long, level_z double, diff_z double")
    got = evidence.best_lag(rows, ["channel"]).collect()
    assert [(r["lag"], round(r["correlation"], 9), r["n_pairs"]) for r in got] == [(4, 1.0, 36)]


def test_auc_pairs_add_up(spark):
    from alarmlens.operators import evidence

    rows = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", 0.5, False), ("b", 0.7, True), ("b", 2.0, False), ("b", None, True)], "source string, s double, pos boolean")
    got = {r["part"]: (r["won"], r["pairs"]) for r in evidence.auc_pairs(rows, "source", "s", "pos").collect()}
    assert got == {"pooled": (2.5, 6.0), "within": (1.5, 3.0), "across": (1.0, 3.0)}


@pytest.mark.parametrize("k", [1, 6, 22])
def test_sign_flips_count_all_flips(spark, k):
    x = np.random.default_rng(k).normal(0.3, 1, k)
    sums = np.zeros(1)
    for v in x:
        sums = np.concatenate([sums + v, sums - v])
    got = alarms.sign_flips(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    assert got.n_flips == 2**k and got.p_value == pytest.approx(np.mean(np.abs(sums) >= abs(x.sum()) - 1e-9))


def test_precedence_increments_count_ties_three_ways(spark):
    from alarmlens.operators import studies

    pairs = [("a", 1, 5, 3), ("a", 1, 4, 4), ("a", 0, 3, 5), ("b", 1, 6, 2), ("b", 0, 2, 2), ("b", 0, 7, 1), ("b", 0, None, 1), ("c", 1, None, None)]
    rows = spark.createDataFrame(pairs, "channel string, anomaly int, level_cross long, diff_cross long")
    got = {(r.ties, r.quantity): r for r in studies.precedence_increments(rows, "channel", 40, "t").collect()}
    assert {k: r.share for k, r in got.items() if k[1] != "increment"} == {
        ("excluded", "anomalous"): 1, ("half", "anomalous"): pytest.approx(2.5 / 3), ("diff_first", "anomalous"): 1,
        ("excluded", "normal"): 0.5, ("half", "normal"): 0.5, ("diff_first", "normal"): pytest.approx(2 / 3),
    }
    for ties in studies.CONVENTIONS:
        r = got[ties, "increment"]
        assert r.share == pytest.approx(got[ties, "anomalous"].share - got[ties, "normal"].share) and r.low <= r.share <= r.high and 0 <= r.p_boot <= 1
    one = {(r.ties, r.quantity): r for r in studies.precedence_increments(rows.where("anomaly = 1"), "channel", 40, "t").collect()}
    assert one["half", "increment"].share is None and one["half", "increment"].n_replicates == 0 and one["half", "anomalous"].n_replicates > 0
    assert studies.precedence_increments(rows.where("false"), "channel", 40, "t").count() == 0
