"""Models: regional clusters, a boosted-tree classifier, parametric bootstrap."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL
from cellweave.operators.extremes import return_levels
from cellweave.operators.simulation import normal, uniform


def region_features(annual: DataFrame, n_years: int, lat: Column, lon: Column, least_years: int = 5) -> DataFrame:
    """(cell, f): mean of the nonzero annual maxima, share of years that have one, latitude and longitude, each less its mean
    over its deviation (0 where it is constant), of the cells with ``least_years`` nonzero years, or all years if fewer."""
    cells = annual.where("mm > 0").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("mm").alias("mean")).where(F.col("n") >= min(least_years, n_years))
    raw = cells.select(*CELL, F.array("mean", F.col("n") / n_years, lat, lon).alias("x"))
    ends = raw.agg(*(F.struct(F.avg(F.col("x")[k]).alias("m"), F.stddev_pop(F.col("x")[k]).alias("s")).alias(f"s{k}") for k in range(4))).first()
    scaled = [((F.col("x")[k] - F.lit(ends[k].m)) / F.lit(ends[k].s) if ends[k].s else F.lit(0.0)) for k in range(4)]
    return raw.select(*CELL, F.array(*scaled).alias("f"))


def lloyd(rows: DataFrame, k: int, starts: int = 10, rounds: int = 100, seed: int = 42, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(centres by start, cost by start) of K-means on arrays ``f``, all starts in the same passes over the rows.

    A start begins with rows drawn far from the centres before them: the row of largest distance to them, times the power
    of a number that hangs on the row and the start, is the next. A round sums every start's clusters partition by partition;
    what comes back are starts * k sums. It ends when no centre moves.
    """
    def passed(step):
        def run(batches):
            total = None
            for batch in batches:
                part = step(np.stack(list(batch["f"])) if len(batch) else np.zeros((0, 4)), batch)
                total = part if total is None else [a.merge(b) for a, b in zip(total, part, strict=True)]
            yield from (pd.DataFrame(x.rows) for x in total or [])

        return run

    centres: list[list[np.ndarray]] = [[] for _ in range(starts)]
    names = F.col("cell_row").cast("long") * 1_000_003 + F.col("cell_col")
    keyed = rows.select("f", names.alias("name"))
    for j in range(k):
        held = [np.array(c) for c in centres]

        def draw(f: np.ndarray, batch: pd.DataFrame, held=held, j=j):
            out = []
            for s in range(starts):
                u = _uniform(batch["name"].to_numpy(), s * 64 + j + seed * 4096)
                far = ((f[:, None] - held[s]) ** 2).sum(2).min(1) if j else np.ones(len(f))
                score = np.where(far > 0, np.log(np.maximum(u, 1e-300)) / np.maximum(far, 1e-300), -np.inf)
                best = int(score.argmax()) if len(f) else -1
                out.append(_First([{"s": s, "score": score[best], "f": f[best].tolist()}] if best >= 0 else []))
            return out

        found = keyed.mapInPandas(passed(draw), "s int, score double, f array<double>").groupBy("s").agg(F.max_by("f", "score").alias("f")).collect()
        for r in found:
            centres[r.s].append(np.array(r.f))
    at = np.array(centres)
    cost = np.zeros(starts)
    for _ in range(rounds):
        now = at.copy()

        def gather(f: np.ndarray, batch: pd.DataFrame, now=now):
            out = []
            for s in range(starts):
                d = ((f[:, None] - now[s]) ** 2).sum(2)
                near = d.argmin(1)
                sums = np.zeros((k, f.shape[1]))
                np.add.at(sums, near, f)
                out.append(_Sums([{"s": s, "j": j, "n": int((near == j).sum()), "x": sums[j].tolist(), "cost": float(d[near == j, j].sum())} for j in range(k)]))
            return out

        sums = keyed.mapInPandas(passed(gather), "s int, j int, n long, x array<double>, cost double").groupBy("s", "j").agg(F.sum("n").alias("n"), *(F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(4)), F.sum("cost").alias("cost")).collect()
        cost = np.zeros(starts)
        for r in sums:
            cost[r.s] += r["cost"]
            if r.n:
                at[r.s, r.j] = np.array([r[f"x{i}"] for i in range(4)]) / r.n
        if np.abs(at - now).max() <= tolerance:
            break
    return at, cost


class _First:
    """The row of largest score."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def merge(self, other: _First) -> _First:
        return _First(sorted(self.rows + other.rows, key=lambda r: -r["score"])[:1])


class _Sums:
    """Cluster sums, to be added."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def merge(self, other: _Sums) -> _Sums:
        return _Sums([a | {"n": a["n"] + b["n"], "cost": a["cost"] + b["cost"], "x": [p + q for p, q in zip(a["x"], b["x"], strict=True)]} for a, b in zip(self.rows, other.rows, strict=True)])


def _uniform(name: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that hang on a row's name and a stream."""
    x = name.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream * 0xBF58476D1CE4E5B9 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def region_clusters(annual: DataFrame, n_years: int, lat: Column, lon: Column, k: int = 6, least_years: int = 5, starts: int = 10) -> DataFrame:
    """(cell, region) of all cells of ``annual``: -1 for those of too few years, else the cluster by K-means on the cells'
    ``region_features``, of ``starts`` beginnings the one of least cost. Regions are numbered by their centres' latitude, from
    the north. Under 10 * k cells there are max(1, n // 10) regions."""
    features = region_features(annual, n_years, lat, lon, least_years)
    n = features.count()
    every = annual.select(*CELL).distinct()
    if not n:
        return every.select(*CELL, F.lit(-1).alias("region"))
    at, cost = lloyd(features, k if n >= 10 * k else max(1, n // 10), starts)
    best = at[int(cost.argmin())]
    best = best[np.lexsort((*best.T[[3, 1, 0]], -best[:, 2]))]
    apart = [F.aggregate(F.zip_with("f", F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in best]
    nearest = F.array_position(F.array(*apart), F.array_min(F.array(*apart))) - 1
    return every.join(features.select(*CELL, nearest.cast("int").alias("region")), CELL, "left").withColumn("region", F.coalesce("region", F.lit(-1)))


def classifier_report(rows: DataFrame, features: list[str], rounds: int = 200) -> DataFrame:
    """(split, n, auc) of gradient-boosted trees on ``features`` of (label, day, ...); every fourth year is the test, so
    no year is on both sides."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows.select("label", "day", *features))
    test = F.year("day") % 4 == 3
    fitted = GBTClassifier(maxDepth=4, maxIter=rounds, stepSize=0.05, subsamplingRate=0.8, seed=42).fit(rows.where(~test))
    auc = BinaryClassificationEvaluator()
    out = []
    for name, part in (("train", rows.where(~test)), ("test", rows.where(test))):
        out.append((name, part.count(), float(auc.evaluate(fitted.transform(part)))))
    return rows.sparkSession.createDataFrame(out, "split string, n long, auc double")


#: What orders cells for a bounded sample, as SQL text.
SAMPLE_ORDER = "(cell_row * 7919 + cell_col * 104729) % 10007"


def draw(replicate: str, i: str, n: str) -> str:
    """SQL text of which of n cells, from 1, the i-th draw of a replicate takes."""
    return f"CAST(least(floor({uniform(replicate, i, 21)} * {n}), {n} - 1) AS INT) + 1"


def jittered(replicate: str, i: str, jitter: tuple[float, float, float] = (0.05, 0.12, 0.12)) -> tuple[str, str, str]:
    """SQL texts of jittered p_occ, xi and scale."""
    noise = lambda d: normal(replicate, i, d)
    p, xi, scale = (f"({c} * (1 + {j!r}e0 * {noise(d)}))" for c, j, d in (("p_occ", jitter[0], 11), ("xi", jitter[1], 13), ("scale", jitter[2], 15)))
    return f"least(greatest({p}, 1e-6), 1e0)", xi, scale


def bootstrap(parameters: DataFrame, rp: int = 100, replicates: int = 250, cells: int = 150) -> DataFrame:
    """One row: the median level at ``rp`` of a bounded sample of cells, and the 2.5 and 97.5 percentiles, over
    replicates that draw as many cells again and jitter their parameters, of the replicate's median; the interval's
    width relative to the median; warn over 0.5. Levels of 0 don't count."""
    from pyspark.sql import Window

    order = Window.orderBy(F.expr(SAMPLE_ORDER), *CELL)
    sample = parameters.orderBy(F.expr(SAMPLE_ORDER), *CELL).limit(cells).withColumn("i", F.row_number().over(order).cast("int"))
    n = sample.count()
    point = return_levels(sample, (rp,)).where("mm > 0").agg(F.median("mm").alias("mid"))
    grid = parameters.sparkSession.range(1, replicates + 1).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("d"))
    drawn = grid.withColumn("i", F.expr(draw("rep", "d", str(max(n, 1))))).join(sample, "i")
    p, xi, scale = jittered("rep", "d")
    moved = drawn.withColumn("_p", F.expr(p)).withColumn("_xi", F.expr(xi)).withColumn("_scale", F.expr(scale)).select("rep", "d", "mu", "sigma", "u", F.col("_p").alias("p_occ"), F.col("_xi").alias("xi"), F.col("_scale").alias("scale"))
    levels = return_levels(moved.withColumnRenamed("rep", "cell_row").withColumnRenamed("d", "cell_col"), (rp,))
    medians = levels.where("mm > 0").groupBy("cell_row").agg(F.median("mm").alias("m"))
    ends = medians.agg(*(F.percentile("m", F.lit(q)).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
    out = ends.crossJoin(point).withColumn("width", (F.col("high") - F.col("low")) / F.greatest("mid", F.lit(1.0)))
    return out.select("low", "mid", "high", "width", F.when(F.col("width") > 0.5, "warn").otherwise("pass").alias("status"))


def model_probabilities(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``p``, the probability of label 1 by the pipeline model stored at ``path`` (its own stages make the
    features); null for all rows where there is no model, or one that doesn't fit the rows, so that the closed-form
    filter is used, and a warning says why. Only this library's own model format is read, never a pickle."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    try:
        scored = PipelineModel.load(path).transform(rows)
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p"))
    except (Py4JJavaError, PySparkException) as e:
        logging.getLogger(__name__).warning("no model is used: %s can't be applied: %s", path, str(e).splitlines()[0])
        return rows.withColumn("p", F.lit(None).cast("double"))
