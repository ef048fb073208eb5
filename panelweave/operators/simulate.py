"""Simulated count panels with known effects, in tasks of some subjects of a replicate.

Latent log-ratio states are a baseline per series, a linear drift, AR(1) noise
whose innovation grows with the time step, and an effect on chosen features of
treated units from the onset on; softmax with structural zeros gives the true
composition, negative-binomial counts the observations.  Every replicate has
its own seed, and its own truth is returned with it.  Each quantity is drawn from a
stream of its own, keyed by (seed, quantity, subject), so that any subject can be
made by itself, in any order and in any task.
"""

from __future__ import annotations

import dataclasses
import enum
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import PanelError, time_identifier


@dataclasses.dataclass(frozen=True)
class Scenario:
    n: int = 40
    n_treated: int = 10
    features: int = 50
    times: tuple[float, ...] = (0, 7, 14, 42, 70)
    t0: int = 4
    depth: float = 12000
    depth_cv: float = 0.3
    baseline_sd: float = 1.5
    trend_sd: float = 0.25
    innov_sd: float = 0.4
    ref_dt: float = 7
    rho: float = 0.4
    phi_range: tuple[float, float] = (0.3, 3.5)
    effect_size: float = 0.8
    n_effect: int = 6
    zero_prob: float = 0.15
    trend_diff: float = 0.0
    hetero: float = 0.0
    twin: bool = False

    def __post_init__(self):
        if not (2 <= self.t0 <= len(self.times) and 1 <= self.n_treated < self.n and self.phi_range[0] > 0):
            raise PanelError("the scenario's sizes do not fit together")


# The twelve benchmark scenarios.
_NINE_A = (0, 2, 9, 17, 26, 38, 51, 66, 83)
_NINE_B = (0, 5, 13, 22, 32, 47, 63, 80, 98)
_NINE_C = (0, 3, 12, 20, 27, 40, 55, 71, 89)
_SEVEN = (0, 3, 7, 14, 21, 42, 70)
_S = Scenario
SCENARIOS = {
    "A1": _S(effect_size=0.4),
    "A2": _S(effect_size=1.2),
    "A3": _S(times=_SEVEN, t0=5, effect_size=0.4),
    "A4": _S(times=_SEVEN, t0=5, effect_size=1.2),
    "A5": _S(times=(0, 3, 7, 14, 21, 28, 42, 56, 70), t0=4, effect_size=0.4),
    "A6": _S(times=_NINE_A, t0=4, effect_size=1.2),
    "A7": _S(times=_NINE_B, t0=7, effect_size=0.4),
    "A8": _S(times=_NINE_C, t0=7, effect_size=1.2, innov_sd=0.8),
    "A9": _S(times=_NINE_A, t0=4, effect_size=0.4, innov_sd=0.8, depth=4000, zero_prob=0.4),
    "A10": _S(times=_NINE_B, t0=4, effect_size=1.2, innov_sd=0.8, depth=4000, zero_prob=0.4, trend_sd=0.6),
    "A11": _S(times=_NINE_C, t0=7, effect_size=0.0, innov_sd=0.8, depth=4000, zero_prob=0.4, trend_sd=0.6),
    "A12": _S(times=_NINE_B, t0=7, effect_size=1.2, depth=4000, zero_prob=0.4, trend_diff=0.5, hetero=0.6),
}


class Stream(enum.IntEnum):
    """What is drawn; those of the replicate as a whole come first."""

    DISPERSION = 0
    EFFECT = 1
    TWIN = 2
    BASELINE = 3
    DRIFT = 4
    ABSENCE = 5
    NOISE = 6
    RESPONSE = 7
    DEPTH = 8
    COUNT = 9


def _draw(seed: int, stream: Stream, subject: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, stream, subject])


def effects_of(s: Scenario, seed: int) -> np.ndarray:
    """The replicate's log-ratio effect on each feature."""
    effect, rng = np.zeros(s.features), _draw(seed, Stream.EFFECT)
    if s.effect_size:
        chosen = rng.permutation(s.features)[: s.n_effect]
        effect[chosen] = np.where(rng.random(len(chosen)) < 0.5, -s.effect_size, s.effect_size)
    return effect


def dispersions_of(s: Scenario, seed: int) -> np.ndarray:
    return _draw(seed, Stream.DISPERSION).uniform(*s.phi_range, s.features)


def latent(s: Scenario, seed: int, subject: int) -> np.ndarray:
    """A subject's states (features x layers); subjects below ``n_treated`` are treated.

    With ``twin`` a treated subject has the baseline and drift of a control.
    """
    times = np.asarray(s.times, float)
    layer = np.arange(len(times))
    treated = subject < s.n_treated
    like = int(_draw(seed, Stream.TWIN, subject).integers(s.n_treated, s.n)) if s.twin and treated else subject
    baseline = _draw(seed, Stream.BASELINE, like).normal(0, s.baseline_sd, s.features)
    slope = _draw(seed, Stream.DRIFT, like).normal(0, s.trend_sd, s.features) + (s.trend_diff if treated else 0.0)
    elapsed = (times - times[0]) / max(np.ptp(times), 1e-12)
    # AR(1) from rest: what is left at layer k of the innovation at layer j
    lag = layer[:, None] - layer
    carried = np.where(lag >= 0, s.rho ** np.maximum(lag, 0), 0.0)
    innovation_sd = s.innov_sd * np.sqrt(np.diff(times, prepend=times[0] - 1) / s.ref_dt)
    innovations = _draw(seed, Stream.NOISE, subject).normal(size=(s.features, len(times))) * innovation_sd
    states = baseline[:, None] + np.outer(slope, elapsed) + innovations @ carried.T
    if treated:
        response = 1 + s.hetero * _draw(seed, Stream.RESPONSE, subject).normal()
        states += np.outer(response * effects_of(s, seed), layer >= s.t0 - 1)
    return states


def observe(s: Scenario, seed: int, subject: int) -> dict[str, np.ndarray]:
    """A subject's states, true composition, depths and counts."""
    states = latent(s, seed, subject)
    present = _draw(seed, Stream.ABSENCE, subject).random(s.features) >= s.zero_prob
    weight = np.exp(states - states.max(axis=0)) * present[:, None]
    relab = weight / np.where(present.any(), weight.sum(axis=0), 1.0)
    depth = _draw(seed, Stream.DEPTH, subject).lognormal(np.log(s.depth), s.depth_cv, states.shape[1])
    size = dispersions_of(s, seed)[:, None]
    # a negative binomial is a Poisson whose rate is gamma distributed
    rng = _draw(seed, Stream.COUNT, subject)
    counts = rng.poisson(rng.gamma(size, relab * depth / size))
    return {"state": states, "relab": relab, "depth": depth, "counts": counts}


def simulate(s: Scenario, seed: int, subjects: range | None = None) -> dict[str, np.ndarray]:
    """Stacked over all subjects, or some: states, true composition, depths, counts; and the replicate's effects."""
    who = range(s.n) if subjects is None else subjects
    each = [observe(s, seed, i) for i in who]
    out = {k: np.stack([e[k] for e in each]) for k in each[0]}
    return out | {"treated": np.array([i < s.n_treated for i in who]), "effect": effects_of(s, seed), "phi": dispersions_of(s, seed)}


#: Subjects of a replicate that one row of the grid stands for.
SUBJECTS = 64

LONG = "dataset string, rep int, observation string, time_index int, elapsed_time double, feature string, raw double, relab double, is_treated boolean, t0 int"
TRUTH = "dataset string, rep int, feature string, effect double, effect_size double, t0 int, seed bigint, md5 string"


def _grid(spark: SparkSession, names: list[str] | None, replicates: int, seed: int, scenarios: dict[str, Scenario] | None, subjects: int | None = None) -> DataFrame:
    """A row for each replicate, or for each ``subjects`` subjects of one."""
    known = SCENARIOS if scenarios is None else scenarios
    rows = []
    for k, name in enumerate(known, 1):
        if names is None or name in names:
            spec, n = json.dumps(dataclasses.asdict(known[name])), known[name].n
            for r in range(1, replicates + 1):
                rows += [(name, r, seed + k * 100_000 + r, spec, lo, min(n, lo + (subjects or n))) for lo in range(0, n, subjects or n)]
    grid = spark.createDataFrame(rows, "dataset string, rep int, seed bigint, spec string, first int, beyond int")
    return grid.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "dataset", "rep", "first")


def _scenario(spec: str) -> Scenario:
    d = json.loads(spec)
    return Scenario(**d | {"times": tuple(d["times"]), "phi_range": tuple(d["phi_range"])})


def generate(spark: SparkSession, names: list[str] | None = None, replicates: int = 30, seed: int = 20260918, scenarios: dict[str, Scenario] | None = None) -> DataFrame:
    """Long counts and true composition of scenarios x replicates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                s = _scenario(r.spec)
                out = simulate(s, r.seed, range(r.first, r.beyond))
                n, d, t = out["counts"].shape
                i, f, k = (x.ravel() for x in np.meshgrid(range(n), range(d), range(t), indexing="ij"))
                yield pd.DataFrame(
                    {
                        "dataset": r.dataset,
                        "rep": r.rep,
                        "observation": np.array([f"subject_{x + 1:03d}" for x in range(r.first, r.beyond)])[i],
                        "time_index": k + 1,
                        "elapsed_time": np.asarray(s.times, float)[k],
                        "feature": np.array([f"taxa_{x + 1:03d}" for x in range(d)])[f],
                        "raw": out["counts"].ravel().astype(float),
                        "relab": out["relab"].ravel(),
                        "is_treated": out["treated"][i],
                        "t0": s.t0,
                    }
                )

    return _grid(spark, names, replicates, seed, scenarios, SUBJECTS).mapInPandas(run, LONG)


def truth(spark: SparkSession, names: list[str] | None = None, replicates: int = 30, seed: int = 20260918, scenarios: dict[str, Scenario] | None = None) -> DataFrame:
    """Per (dataset, replicate, feature): its effect, and the counts' md5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                s = _scenario(r.spec)
                out = simulate(s, r.seed)
                digest = hashlib.md5(np.ascontiguousarray(out["counts"]).tobytes()).hexdigest()
                yield pd.DataFrame(
                    {"dataset": r.dataset, "rep": r.rep, "feature": [f"taxa_{x + 1:03d}" for x in range(s.features)], "effect": out["effect"], "effect_size": s.effect_size, "t0": s.t0, "seed": r.seed, "md5": digest}
                )

    return _grid(spark, names, replicates, seed, scenarios).mapInPandas(run, TRUTH)


def truth_table(spark: SparkSession, names: list[str] | None = None, replicates: int = 30, seed: int = 20260918, scenarios: dict[str, Scenario] | None = None) -> DataFrame:
    """One row a (dataset, replicate): parameters, effect features and signs, md5."""
    cells = truth(spark, names, replicates, seed, scenarios).where("effect <> 0 or feature = 'taxa_001'")
    real = F.array_sort(F.collect_list(F.when(F.col("effect") != 0, F.struct("feature", F.signum("effect").cast("int").alias("sign")))))
    effects = cells.groupBy("dataset", "rep").agg(F.first("seed").alias("seed"), F.first("md5").alias("counts_md5"), real.alias("_e"))
    known = SCENARIOS if scenarios is None else scenarios
    fields = [f.name for f in dataclasses.fields(Scenario)]
    plain = {"times": "string", "phi_range": "string", "n": "int", "n_treated": "int", "features": "int", "t0": "int", "n_effect": "int", "twin": "boolean"}
    rows = []
    for k, s in known.items():
        v = dataclasses.asdict(s) | {"times": " ".join(map(str, s.times)), "phi_range": ":".join(map(str, s.phi_range))}
        rows.append((k, *(v[f] if f in plain else float(v[f]) for f in fields), s.n - s.n_treated, len(s.times), s.t0 - 1, len(s.times) - s.t0 + 1))
    schema = ", ".join(["dataset string", *(f"{f} {plain.get(f, 'double')}" for f in fields), "n_donor int", "n_layers int", "n_pre int", "n_post int"])
    params = spark.createDataFrame(rows, schema)
    names_of = [F.transform("_e", lambda e: e["feature"]).alias("effect_features"), F.transform("_e", lambda e: e["sign"]).alias("effect_signs")]
    return effects.join(F.broadcast(params), "dataset").select("dataset", "rep", "seed", *params.columns[1:], *names_of, "counts_md5")


def panel_table(long: DataFrame, dataset: str, rep: int, value: str = "relab") -> DataFrame:
    """One replicate's seven-column table, ready for the archive writer."""
    one = long.where((F.col("dataset") == dataset) & (F.col("rep") == rep))
    return one.select(
        "observation",
        time_identifier(F.col("time_index")).alias("time_identifier"),
        "elapsed_time",
        "feature",
        F.col(value).alias("abundance_value"),
        F.when(F.col("is_treated"), "treat").otherwise("ctrl").alias("label"),
        (F.col("time_index") >= F.col("t0")).alias("is_intervention"),
    )


def probe(long: DataFrame) -> DataFrame:
    """One row a (dataset, replicate): axis sizes, onset, zero share, depth."""
    sample = long.groupBy("dataset", "rep", "observation", "time_index").agg(F.sum("raw").alias("depth"))
    depth = sample.groupBy("dataset", "rep").agg(F.avg("depth").alias("mean_depth"))
    head = long.groupBy("dataset", "rep").agg(
        F.count_distinct("observation").alias("n_observations"),
        F.count_distinct("feature").alias("n_features"),
        F.count_distinct("time_index").alias("n_layers"),
        F.count_distinct(F.when(F.col("is_treated"), F.col("observation"))).alias("n_treated"),
        F.min("t0").alias("t0"),
        F.array_join(F.transform(F.sort_array(F.collect_set("elapsed_time")), lambda x: x.cast("int").cast("string")), " ").alias("times"),
        F.avg((F.col("raw") == 0).cast("double")).alias("zero_share"),
    )
    return head.join(depth, ["dataset", "rep"])
