"""The detector: a local-linear-trend Kalman filter, whose standardised innovations go through Bayesian online change-point detection.

Both are recursions over a segment's samples. Segments stream through a task in order, and only the state at the current sample
is held: five numbers for the filter, and three vectors over run lengths for the detector. With forgetting, long run lengths have
forgotten where they began and are one entry of these vectors, so a sample's cost doesn't grow with the segment.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from alarmlens.operators import profile

# Fixed values of the method.
HAZARD, KAPPA_MAX, MU0, KAPPA0, ALPHA0, BETA0 = 1 / 250.0, 40.0, 0.0, 1.0, 1.0, 1.0
LONG_RUN, SHORT_RUN, TOP_RUNS, LEAST_POSTERIOR = 5, 2, 30, 1e-6
VARIANCE_CLIP, LEAST_SAMPLES = 1e-8, 5
FIRST_CANDIDATE, LAST_CANDIDATE = 10, 5
BATCH_CANDIDATES = 500_000  # of a batch that is handed on
FOUND = "n_points long, onset long, confirm long, confidence double, runs array<struct<run:long,p:double>>, candidates array<struct<onset:long,p:double>>, resets long"


class Tables:
    """What depends on the run length alone: kappa, alpha, the share that forgetting leaves of beta, and the density's constant.

    From the run length settled on, all of them stay the same; without forgetting they never do.
    """

    def __init__(self, forgetting: bool):
        self.forgetting, self.n, self.settled = forgetting, 0, math.inf
        self.kappa, self.alpha, self.share, self.constant = (np.empty(0) for _ in range(4))

    def up_to(self, n: int) -> Tables:
        if n > self.n:
            self.n = max(2 * self.n, n, 256)
            kappa, alpha = [KAPPA0], [ALPHA0]
            share = [1.0]
            for _ in range(self.n - 1):
                k, a = kappa[-1] + 1, alpha[-1] + 0.5
                s = min(1.0, KAPPA_MAX / k) if self.forgetting else 1.0
                share.append(s)
                kappa.append(k * s)
                alpha.append(max(a * s, 1e-3))
            self.kappa, self.alpha, self.share = np.array(kappa), np.array(alpha), np.array(share)
            self.constant = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alpha])
            self.above, self.twice, self.power = self.kappa + 1, 2 * (self.kappa + 1), self.alpha + 0.5
            same = (np.diff(self.kappa) == 0) & (np.diff(self.alpha) == 0) & (np.diff(self.share) == 0)
            if same[-1]:
                self.settled = self.n - 1 - int(np.argmin(np.append(same[::-1], False)))
        return self


class Filter:
    """Innovations of one segment, and their variances. r has the measurement noise, theta and the quantisation floor together."""

    def __init__(self, r: float, q: float):
        if r < 0 or q < 0:
            raise ValueError("noise variances must not be negative")
        self.r, self.q, self.state = r, q, (0.0, 0.0, 10.0, 0.0, 10.0)

    def step(self, y: float) -> tuple[float, float]:
        x0, x1, a, b, c = self.state
        level, p00, p01, p11 = x0 + x1, a + 2 * b + c, b + c, c + self.q
        s, nu = p00 + self.r, y - level
        k0, k1 = p00 / s, p01 / s
        self.state = level + k0 * nu, x1 + k1 * nu, p00 - k0 * p00, p01 - k0 * p01, p11 - k1 * p01
        return nu, s


class RunLengths:
    """The posterior p of the run length, after each value: one entry for each run length, but for the last, which is a group.

    The group begins with the longest run length. The next one joins when its kappa, alpha, mu and beta equal the group's bit for bit:
    from then on both have the same densities, and their shares of the group's probability stay as they are. Under forgetting mu and
    beta keep 40/41 of what differs with each value, so that some two thousand run lengths are apart, however long the segment.
    """

    def __init__(self, tables: Tables):
        self.tables, self.p, self.mu, self.beta = tables, np.ones(1), np.array([MU0]), np.array([BETA0])
        # Of the group's members, the longest run first: logarithms of their weights, and that of the sum. Members before alive have none.
        self.weights, self.log_sum, self.alive, self.largest = array("d", [0.0]), 0.0, 0, 0

    def step(self, x: float) -> np.ndarray:
        n = len(self.p)
        t = self.tables.up_to(n + 1)
        kappa, above = t.kappa[:n], t.above[:n]
        off = x - self.mu
        off *= off
        width = 2 * self.beta
        width *= above
        width /= kappa
        density = off / width
        np.log1p(density, out=density)
        density *= t.power[:n]
        np.subtract(t.constant[:n], density, out=density)
        np.exp(density, out=density)
        width *= math.pi
        density /= np.sqrt(width, out=width)
        p = np.empty(n + 1)
        weight = np.multiply(self.p, density, out=p[1:])
        total = weight.sum()
        if math.isnan(total):
            weight[:] = self.p * np.where(np.isnan(density), 1e-12, density)
            total = weight.sum()
        p[0] = total * HAZARD
        weight *= 1 - HAZARD
        total = p.sum()
        if total > 0 and math.isfinite(total):
            p /= total
        else:
            p[:] = 0
            p[0] = 1
        beta, mu = np.empty(n + 1), np.empty(n + 1)
        beta[0], mu[0] = BETA0, MU0
        off *= kappa
        off /= t.twice[:n]
        off += self.beta
        np.multiply(off, t.share[1 : n + 1], out=beta[1:])
        later = np.multiply(kappa, self.mu, out=mu[1:])
        later += x
        later /= above
        self.p, self.mu, self.beta = p, mu, beta
        while len(self.p) - 2 >= t.settled and self.mu[-2] == self.mu[-1] and self.beta[-2] == self.beta[-1]:
            self._join()
        return self.p

    def _join(self) -> None:
        """The longest run length that is apart becomes the group's last member."""
        q, group = float(self.p[-2]), float(self.p[-1])
        if group > 0:
            weight = self.log_sum + math.log(q) - math.log(group) if q > 0 else -math.inf
            self.log_sum = float(np.logaddexp(self.log_sum, weight))
        else:
            weight, self.log_sum, self.alive = 0.0, 0.0, len(self.weights)
            self.largest = self.alive
        if self.largest == len(self.weights) or weight >= self.weights[self.largest]:
            self.largest = len(self.weights)
        self.weights.append(weight)
        self.p, self.mu, self.beta = self.p[:-1], self.mu[:-1], self.beta[:-1]
        self.p[-1] = q + group

    def likeliest(self) -> int:
        """The likeliest run length, the least of equals."""
        members = len(self.weights)
        if members == 1:
            return int(self.p.argmax())
        apart = int(self.p[:-1].argmax())
        top = self.p[-1] * math.exp(self.weights[self.largest] - self.log_sum)
        return len(self.p) - 2 + members - self.largest if top > self.p[apart] else apart

    def posterior(self) -> np.ndarray:
        """The probabilities of all run lengths, the group's members too."""
        shares = np.zeros(len(self.weights))
        shares[self.alive :] = np.exp(np.array(self.weights[self.alive :]) - self.log_sum)
        return np.concatenate([self.p[:-1], (self.p[-1] * shares)[::-1]])


class Segment:
    """What is known of a segment so far. whole: go on after the first onset, to the last posterior."""

    def __init__(self, r: float, q: float, tables: Tables, whole: bool):
        self.filter, self.lengths, self.whole = Filter(r, q), RunLengths(tables), whole
        self.n, self.before, self.found, self.resets = 0, 0, None, 0

    def step(self, y: float) -> None:
        self.n += 1
        if self.found and not self.whole:
            return
        nu, s = self.filter.step(y)
        p = self.lengths.step(nu / math.sqrt(max(s, VARIANCE_CLIP)))
        likeliest, t = self.lengths.likeliest(), self.n - 1
        falls = t > 0 and likeliest <= SHORT_RUN and self.before > LONG_RUN
        self.resets += falls
        if falls and not self.found:
            runs = [{"run": r, "p": float(x)} for r, x in enumerate(p[:TOP_RUNS]) if x > LEAST_POSTERIOR]
            self.found = t - likeliest, t, float(p[: SHORT_RUN + 1].sum()), runs
        self.before = likeliest

    def row(self) -> tuple:
        candidates = None
        if self.whole:
            p = self.lengths.posterior()
            at = self.n - 1 - np.arange(len(p))
            keep = (at >= FIRST_CANDIDATE) & (at <= self.n - LAST_CANDIDATE)
            p, at = p[keep], at[keep]
            candidates = (at[::-1], (p / p.sum())[::-1]) if p.sum() > 0 else (at[:0], p[:0])
        found = self.found if self.n >= LEAST_SAMPLES else None
        return self.n, *(found or (None, None, None, None)), candidates, self.resets if self.whole else None


def detect(samples: DataFrame, params: DataFrame, by: tuple = ("channel", "segment"), forgetting: bool = True, whole: bool = False) -> DataFrame:
    """One row for each segment: its onset (nulls if none), the run lengths at its confirmation, and with whole the candidate onsets by the last posterior and how often the run length was reset.

    params has r and q (and forgetting, where it varies) for each channel, or each of by's other columns and channel; it is a
    few rows. A segment of fewer than five samples has no onset. A null value counts for a missing sample.
    """
    on = [c for c in params.columns if c not in ("r", "q", "forgetting")]
    flag = F.col("forgetting") if "forgetting" in params.columns else F.lit(forgetting)
    rows = samples.where("value IS NOT NULL").join(params, [c for c in on if c in samples.columns]).select(*by, "t", "value", "r", "q", flag.alias("forgetting"))
    schema = T.StructType([*rows.select(*by).schema.fields, *T.StructType.fromDDL(FOUND).fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {flag: Tables(flag) for flag in (True, False)}
        key, segment, made = None, None, []

        def emit():
            columns = list(zip(*made))
            parts = [c if c is not None else (np.empty(0, int), np.empty(0)) for c in columns[-2]]
            ends = np.cumsum([0, *(len(at) for at, _ in parts)])
            fields = out.field("candidates").type.value_type
            inner = pa.StructArray.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*parts), fields)], fields=list(fields))
            offsets = pa.array([None if c is None else n for c, n in zip(columns[-2], ends)] + [ends[-1]], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, inner, type=f.type) if f.name == "candidates" else pa.array(x, f.type) for x, f in zip(columns, out)]
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(by)))))
            values, r, q, flags = (batch.column(len(by) + 1 + i).to_pylist() for i in range(4))
            for name, value, r_, q_, flag in zip(names, values, r, q, flags):
                if name != key:
                    if segment:
                        made.append((*key, *segment.row()))
                    key, segment = name, Segment(r_, q_, tables[flag], whole)
                    if len(made) >= 256 or sum(len(row[-2][0]) for row in made if row[-2]) >= BATCH_CANDIDATES:
                        yield emit()
                        made.clear()
                segment.step(value)
        if segment:
            made.append((*key, *segment.row()))
        if made:
            yield emit()

    # segments are few and long: several tasks a core, so that none is left with many of them
    spark = samples.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *by).sortWithinPartitions(*by, "t").mapInArrow(run, schema)


def fitted(samples: DataFrame, mixture: bool, theta: float = 0.0) -> DataFrame:
    """(channel, r, q): variances of the nominal samples, shrunken over channels; r with theta and the quantisation floor step ** 2 / 12."""
    noise = profile.noise_mixture(samples) if mixture else profile.noise_simple(samples)
    r = profile.shrink(noise.select("channel", "r", "n_diff"), "r", "n_diff").select("channel", F.col("shrunk").alias("r"))
    q = profile.shrink(noise.select("channel", "q", "n_diff"), "q", "n_diff").select("channel", F.col("shrunk").alias("q"))
    step = profile.channel_profile(samples).select("channel", F.coalesce(F.col("quantization_step") * F.col("quantization_step") / 12, F.lit(0.0)).alias("floor"))
    return r.join(q, "channel").join(step, "channel").select("channel", (F.col("r") + theta + F.col("floor")).alias("r"), "q")


def posteriors(found: DataFrame, by: tuple = ("channel", "segment")) -> DataFrame:
    """A row for each run length that is likely where a change is confirmed, with the onset that it means."""
    rows = found.where("onset IS NOT NULL").select(*by, "confirm", F.explode("runs").alias("x"))
    return rows.select(*by, "confirm", F.col("x.run").alias("run_length"), (F.col("confirm") - F.col("x.run")).alias("candidate_onset"), F.col("x.p").alias("p"))


def calibration(found: DataFrame, labels: DataFrame, by: tuple = ("channel",)) -> DataFrame:
    """Segments, detections, recall and false-alarm rate (null without segments of the class) and MCC."""
    rows = found.join(labels, ["channel", "segment"]).withColumn("hit", F.col("onset").isNotNull())
    cells = {"tp": (1, True), "fn": (1, False), "fp": (0, True), "tn": (0, False)}
    counts = rows.groupBy(*by).agg(*[F.count_if((F.col("anomaly") == x) & (F.col("hit") == y)).cast("double").alias(n) for n, (x, y) in cells.items()])
    tp, fn, fp, tn = (F.col(c) for c in cells)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(F.when(product > 0, product))).otherwise(0.0)
    return counts.select(*by, *cells, F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(fp, fp + tn).alias("false_alarm_rate"), mcc.alias("mcc"))
