"""Statistical models: sufficient statistics by aggregation, small solves on the driver, pyspark.ml where it fits."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import encode


def lr2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Simple regression of y on x over pairs without missing values: one row of estimates."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    pair = a.isNotNull() & b.isNotNull()
    s = df.where(pair).agg(F.count("*").alias("n"), F.regr_slope(b, a).alias("beta1"), F.regr_intercept(b, a).alias("beta0"), F.regr_r2(b, a).alias("r2"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("ssto"), F.avg(a).alias("mx"))
    ssr = F.col("beta1") * F.col("beta1") * F.col("sxx")
    var = (F.col("ssto") - ssr) / (F.col("n") - 2)
    return s.select("n", "beta0", "beta1", "r2", "ssto", ssr.alias("ssr"), (F.col("ssto") - ssr).alias("sse"), F.sqrt(var / F.col("sxx")).alias("se1"), F.sqrt(var * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))).alias("se0"))


# -- naive Bayes --------------------------------------------------------------------------------------------------


@dataclass
class NaiveBayes:
    """Mixed factors (Laplace counts) and numbers (normal densities)."""

    response: str
    priors: dict[str, float]
    tables: dict[str, dict[str, dict[str, float]]]
    normal: dict[str, dict[str, tuple[float, float]]]
    classes: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """``predict`` and one probability column per class; a missing cell, or a level not seen, is left out."""
        logs = []
        for c in self.classes:
            total = F.lit(math.log(self.priors[c]))
            for name, by in self.tables.items():
                p = F.lit(0.0)
                for level, share in by[c].items():
                    p = F.when(F.col(name).cast("string") == level, F.lit(math.log(share) if share > 0 else -1e3)).otherwise(p)
                total = total + p
            for name, by in self.normal.items():
                m, s = by[c]
                x = F.col(name).cast("double")
                total = total + F.coalesce(-F.pow((x - m) / s, F.lit(2.0)) / 2 - math.log(s * math.sqrt(2 * math.pi)), F.lit(0.0))
            logs.append(total)
        out = df.select("*", *(x.alias(f"_l{i}") for i, x in enumerate(logs)))
        top = F.greatest(*(F.col(f"_l{i}") for i in range(len(logs)))) if len(logs) > 1 else F.col("_l0")
        ex = [F.exp(F.col(f"_l{i}") - top) for i in range(len(logs))]
        total = ex[0]
        for e in ex[1:]:
            total = total + e
        label = F.lit(self.classes[0])
        for i in range(len(self.classes) - 1, -1, -1):
            label = F.when(F.col(f"_l{i}") == top, F.lit(self.classes[i])).otherwise(label)
        return out.select(*df.columns, label.alias("predict"), *((e / total).alias(f"p.{c}") for c, e in zip(self.classes, ex, strict=True)))


def naive_bayes_stats(df: DataFrame, response: str, numeric: Sequence[str]) -> DataFrame:
    """(class, n, mean and sd of each number) over rows without missing cells."""
    whole = df.select(response, *numeric).dropna()
    return whole.groupBy(F.col(response).alias("class")).agg(F.count("*").alias("n"), *(a for c in numeric for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))))


def naive_bayes(df: DataFrame, response: str, numeric: Sequence[str] = (), factors: Sequence[str] = (), laplace: float = 0.0, min_sd: float = 1e-10) -> NaiveBayes:
    whole = df.select(response, *numeric, *factors).dropna()
    stats = naive_bayes_stats(whole, response, numeric).collect()
    n, k = sum(r["n"] for r in stats), len(stats)
    classes = sorted(str(r["class"]) for r in stats)
    priors = {str(r["class"]): (r["n"] + laplace) / (n + k * laplace) for r in stats}
    normal = {c: {str(r["class"]): (r[f"mean_{c}"], max(r[f"sd_{c}"] or 0.0, min_sd)) for r in stats} for c in numeric}
    tables = {}
    for c in factors:
        counts = {(str(r[0]), str(r[1])): r["count"] for r in whole.groupBy(response, c).count().collect()}
        levels = sorted({x for _, x in counts})
        size = {str(r["class"]): r["n"] for r in stats}
        tables[c] = {y: {v: (counts.get((y, v), 0) + laplace) / (size[y] + laplace * len(levels)) for v in levels} for y in classes}
    return NaiveBayes(response, priors, tables, normal, classes)


# -- generalised linear models --------------------------------------------------------------------------------------

#: family -> default link
LINKS = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "tweedie": "tweedie"}


def _link(family: str, link: str, eta: Column, power: float) -> tuple[Column, Column, Column]:
    """(mean, its slope in eta, variance)."""
    if link == "identity":
        mu, slope = eta, F.lit(1.0)
    elif link == "logit":
        mu = 1 / (1 + F.exp(-eta))
        slope = mu * (1 - mu)
    elif link == "log":
        mu = F.exp(eta)
        slope = mu
    elif link == "inverse":
        safe = F.when(F.abs(eta) < 1e-8, F.lit(1e-8)).otherwise(eta)
        mu, slope = 1 / safe, -1 / (safe * safe)
    elif link == "tweedie":  # power link, 1 - variance power; log where that is 0
        p = 1 - power
        mu = F.exp(eta) if p == 0 else F.pow(F.greatest(eta, F.lit(1e-8)), F.lit(1 / p))
        slope = mu if p == 0 else mu / (p * F.greatest(eta, F.lit(1e-8)))
    else:
        raise ValueError(link)
    variance = {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu, "gamma": mu * mu, "tweedie": F.pow(F.greatest(mu, F.lit(1e-8)), F.lit(power))}[family]
    return mu, slope, variance


@dataclass
class GLM:
    names: list[str]
    beta: np.ndarray
    family: str
    link: str
    power: float = 1.5
    iterations: int = 0
    offset: str | None = None

    def eta(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for n, b in zip(self.names, self.beta[1:], strict=True):
            if b:
                out = out + F.col(f"`{n}`").cast("double") * float(b)
        return out + F.col(self.offset).cast("double") if self.offset else out

    def predict(self, df: DataFrame, to: str = "predict") -> DataFrame:
        return df.withColumn(to, _link(self.family, self.link, self.eta(), self.power)[0])

    def with_beta(self, **beta: float) -> GLM:
        """The model with some coefficients set by hand (``Intercept`` for the constant)."""
        new = self.beta.copy()
        for k, v in beta.items():
            new[0 if k == "Intercept" else 1 + self.names.index(k)] = v
        return GLM(self.names, new, self.family, self.link, self.power, self.iterations, self.offset)

    def save(self) -> str:
        return json.dumps({**self.__dict__, "beta": self.beta.tolist()})

    @staticmethod
    def load(text: str) -> GLM:
        state = json.loads(text)
        return GLM(**{**state, "beta": np.array(state["beta"])})


def glm(df: DataFrame, response: str, names: Sequence[str], family: str = "gaussian", link: str | None = None, *, alpha=0.0, lam=0.0, power=1.5, max_iter=50, tol=1e-8, offset=None, weights=None, non_negative=False, bounds=None, standardize=False, prior=None) -> GLM:
    """Iteratively reweighted least squares: each pass sums the weighted Gram matrix, the driver solves it.

    With ``lam`` > 0 the solve is elastic net by coordinate descent on the Gram matrix (the constant is free).  bounds:
    name -> (low, high).  The Gram matrix has (number of columns)^2 cells, whatever the number of rows.  standardize:
    penalties fall on numbers of mean 0 and deviation 1 (the coefficients are given for the columns as they are).
    prior: the true share of ones, for a binomial model of balanced rows.
    """
    link = link or LINKS[family]
    if standardize:
        stats = df.dropna(subset=[response, *names]).agg(*(x for n in names for x in (F.avg(f"`{n}`"), F.stddev_samp(f"`{n}`")))).first()
        mean, sd = np.array([v or 0.0 for v in stats[::2]]), np.array([v or 1.0 for v in stats[1::2]])
        scaled = df.select("*", *(((F.col(f"`{n}`").cast("double") - float(m)) / float(v)).alias(f"_z{i}") for i, (n, m, v) in enumerate(zip(names, mean, sd, strict=True))))
        box = {f"_z{i}": tuple(b * sd[i] for b in bounds[n]) for i, n in enumerate(names) if n in bounds} if bounds else None
        own = glm(scaled, response, [f"_z{i}" for i in range(len(names))], family, link, alpha=alpha, lam=lam, power=power, max_iter=max_iter, tol=tol, offset=offset, weights=weights, non_negative=non_negative, bounds=box, prior=prior)
        slopes = own.beta[1:] / sd
        return GLM(list(names), np.concatenate([[own.beta[0] - slopes @ mean], slopes]), family, link, power, own.iterations, offset)
    k = len(names)
    xs = [F.lit(1.0), *(F.col(f"`{n}`").cast("double") for n in names)]
    y = F.col(response).cast("double")
    some = df.dropna(subset=[response, *names])
    start = some.agg(F.avg(y)).first()[0]
    beta = np.zeros(k + 1)
    beta[0] = {"identity": start, "logit": math.log(max(1e-6, min(1 - 1e-6, start)) / (1 - max(1e-6, min(1 - 1e-6, start)))) if family == "binomial" else 0.0, "log": math.log(max(start, 1e-8)), "inverse": 1 / max(start, 1e-8), "tweedie": math.log(max(start, 1e-8)) if power == 1 else max(start, 1e-8) ** (1 - power)}[link]
    limit = {n: (0.0, math.inf) for n in names} if non_negative else {}
    limit.update(bounds or {})
    done = 0
    for done in range(1, max_iter + 1):
        model = GLM(list(names), beta, family, link, power, 0, offset)
        off = F.col(offset).cast("double") if offset else F.lit(0.0)
        eta = model.eta()
        mu, slope, variance = _link(family, link, eta, power)
        w = slope * slope / F.greatest(variance, F.lit(1e-10)) * (F.col(weights).cast("double") if weights else F.lit(1.0))
        staged = some.select(*(x.alias(f"_x{i}") for i, x in enumerate(xs)), w.alias("_w"), (eta - off + (y - mu) / slope).alias("_z"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        row = staged.agg(F.sum("_w"), *(F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs), *(F.sum(F.col("_w") * F.col(f"_x{i}") * F.col("_z")) for i in range(k + 1))).first()
        g = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, row[1 : 1 + len(pairs)], strict=True):
            g[i, j] = g[j, i] = v
        new = _solve(g, np.array(row[1 + len(pairs) :], dtype=float), row[0], alpha, lam, [limit.get(n) for n in names], beta)
        moved = np.abs(new - beta).max()
        beta = new
        if moved < tol or family == "gaussian" and link == "identity":
            break
    if prior is not None and family == "binomial":
        beta = beta.copy()
        beta[0] += math.log(prior / (1 - prior)) - math.log(start / (1 - start))
    return GLM(list(names), beta, family, link, power, done, offset)


def glm_folds(df: DataFrame, response: str, names: Sequence[str], keys: Sequence[str], n_folds: int = 5, **options) -> tuple[GLM, list[float]]:
    """The model on all rows, and each fold's mean squared error of the model on the others; a hash of the keys deals the folds."""
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(*keys), F.lit(n_folds)))

    def miss(model: GLM, held: DataFrame) -> float:
        return model.predict(held, "_p").agg(F.avg(F.pow(F.col("_p") - F.col(response).cast("double"), F.lit(2.0)))).first()[0]

    return glm(df, response, names, **options), cross_validate(folded, lambda part: glm(part, response, names, **options), miss, n_folds, "_fold")


def _solve(g: np.ndarray, b: np.ndarray, n: float, alpha: float, lam: float, limits: list, start: np.ndarray) -> np.ndarray:
    if lam == 0 and not any(limits):
        return np.linalg.solve(g + 1e-12 * np.trace(g) / len(g) * np.eye(len(g)), b)
    beta = start.copy()
    for _ in range(10_000):
        before = beta.copy()
        for j in range(len(beta)):
            rest = b[j] - g[j] @ beta + g[j, j] * beta[j]
            if j == 0:
                beta[j] = rest / g[j, j]
                continue
            soft = math.copysign(max(0.0, abs(rest) - lam * alpha * n), rest)
            beta[j] = soft / (g[j, j] + lam * (1 - alpha) * n)
            if limits[j - 1]:
                beta[j] = min(max(beta[j], limits[j - 1][0]), limits[j - 1][1])
        if np.abs(beta - before).max() < 1e-10:
            break
    return beta


def lambda_path(df: DataFrame, response: str, names: Sequence[str], family: str = "gaussian", n: int = 20, smallest: float = 1e-3, alpha: float = 1.0, **options) -> list[tuple[float, GLM]]:
    """Models for falling penalties, from the smallest that leaves all coefficients at zero."""
    y = F.col(response).cast("double")
    mean = df.agg(F.avg(y)).first()[0]
    row = df.agg(*(F.abs(F.avg((F.col(f"`{c}`").cast("double")) * (y - mean))).alias(f"_{i}") for i, c in enumerate(names))).first()
    top = max(row) / max(alpha, 1e-3)
    return [(lam, glm(df, response, names, family, alpha=alpha, lam=lam, **options)) for lam in np.geomspace(top, top * smallest, n).tolist()]


# -- unsupervised -------------------------------------------------------------------------------------------------


@dataclass
class PCA:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    sdev: np.ndarray

    def project(self, df: DataFrame) -> DataFrame:
        out = []
        for j in range(self.vectors.shape[1]):
            x = F.lit(0.0)
            for i, n in enumerate(self.names):
                x = x + (F.col(f"`{n}`").cast("double") - float(self.mean[i])) * float(self.vectors[i, j] / self.scale[i])
            out.append(x.alias(f"PC{j}"))
        return df.select("*", *out)


def pca(df: DataFrame, names: Sequence[str], standardize: bool = True, max_pc: int | None = None, tolerance: float = 0.0, most_missing: float = 0.2) -> PCA:
    """From the Gram matrix of one pass; constant columns and those missing too much are left out; signs: the largest
    weight of each vector is positive."""
    stats = df.agg(F.count("*").alias("n"), *(x for i, c in enumerate(names) for x in (F.count(c).alias(f"c{i}"), F.stddev_samp(c).alias(f"s{i}")))).first()
    names = [c for i, c in enumerate(names) if stats[f"c{i}"] >= (1 - most_missing) * stats["n"] and stats[f"s{i}"]]
    whole = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names)).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = whole.agg(*(F.avg(f"`{c}`") for c in names), *(F.covar_samp(f"`{names[i]}`", f"`{names[j]}`") for i, j in pairs)).first()
    mean = np.array(row[: len(names)])
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[len(names) :], strict=True):
        cov[i, j] = cov[j, i] = v
    scale = np.sqrt(np.diag(cov)) if standardize else np.ones(len(names))
    values, vectors = np.linalg.eigh(cov / scale[:, None] / scale[None])
    order = np.argsort(-values)
    sdev, vectors = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(names))] < 0, -1, 1)
    keep = [j for j in range(len(names)) if sdev[j] > tolerance * sdev[0]][: max_pc or len(names)]
    return PCA(list(names), mean, scale, vectors[:, keep], sdev[keep])


@dataclass
class KMeans:
    names: list[str]
    centers: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    within: float
    iterations: int

    def distances(self) -> list[Column]:
        """Squared distance to each centre; missing cells are left out and the rest scaled up."""
        xs = [(F.col(f"`{n}`").cast("double") - float(m)) / float(s) for n, m, s in zip(self.names, self.mean, self.scale, strict=True)]
        out = []
        have = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
        for c in self.centers:
            total = F.lit(0.0)
            for x, v in zip(xs, c.tolist(), strict=True):
                total = total + F.coalesce((x - v) * (x - v), F.lit(0.0))
            out.append(total * len(xs) / F.greatest(have, F.lit(1)))
        return out

    def predict(self, df: DataFrame, to: str = "cluster") -> DataFrame:
        d = F.array(*self.distances())
        return df.withColumn(to, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def kmeans(df: DataFrame, names: Sequence[str], k: int, max_iter: int = 20, init: str = "furthest", normalize: bool = True, seed: int = 1, sample: int = 10_000) -> KMeans:
    """Lloyd's rounds as one aggregation each.  Starts (furthest, plusplus, none) come from at most ``sample`` rows."""
    stats = df.agg(*(x for c in names for x in (F.avg(f"`{c}`"), F.stddev_samp(f"`{c}`")))).first()
    mean = np.array([stats[2 * i] or 0.0 for i in range(len(names))]) if normalize else np.zeros(len(names))
    scale = np.array([stats[2 * i + 1] or 1.0 for i in range(len(names))]) if normalize else np.ones(len(names))
    whole = df.select(*(F.col(f"`{c}`").cast("double") for c in names)).dropna()
    n, mixed = whole.count(), F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in names))
    # tasks choose by hash, so that about ``sample`` rows travel, whatever the number of tasks
    rows = whole.where(F.lit(n <= sample) | (F.abs(mixed % (1 << 40)) < int((1 << 40) * min(1, sample / max(1, n))))).select("*", mixed.alias("_h")).collect()
    x = (np.array([list(r)[:-1] for r in sorted(rows, key=lambda r: r["_h"])], dtype=float).reshape(-1, len(names)) - mean) / scale
    rng = np.random.default_rng(seed)
    centers = [x[0]] if len(x) else [np.zeros(len(names))]
    while len(centers) < min(k, max(1, len(np.unique(x, axis=0)))):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[int(d.argmax())] if init == "furthest" else x[rng.choice(len(x), p=d / d.sum())] if init == "plusplus" else x[len(centers) % len(x)])
    model = KMeans(list(names), np.array(centers), mean, scale, math.inf, 0)
    for i in range(max_iter):
        d = F.array(*model.distances())
        best = F.array_min(d)
        xs = [((F.col(f"`{n}`").cast("double") - float(m)) / float(s)).alias(f"_x{j}") for j, (n, m, s) in enumerate(zip(names, mean, scale, strict=True))]
        got = df.select((F.array_position(d, best) - 1).alias("_k"), best.alias("_d"), *xs).groupBy("_k").agg(F.sum("_d").alias("_d"), *(F.avg(f"_x{j}") for j in range(len(names)))).collect()
        new = model.centers.copy()
        for r in got:
            new[int(r[0])] = [v if v is not None else new[int(r[0])][j] for j, v in enumerate(r[2:])]
        empty = sorted(set(range(len(new))) - {int(r[0]) for r in got})
        if empty:  # a centre without rows moves to the row that is farthest from all
            far = df.select(best.alias("_d"), *xs).orderBy(F.desc("_d")).limit(len(empty)).collect()
            for k, r in zip(empty, far, strict=False):
                new[k] = [v if v is not None else 0.0 for v in r[1:]]
        within = float(sum(r[1] for r in got))
        moved = float(np.abs(new - model.centers).max())
        model = KMeans(list(names), new, mean, scale, within, i + 1)
        if moved < 1e-6:
            break
    return model


def gap_statistic(df: DataFrame, names: Sequence[str], k_max: int, b: int = 5, seed: int = 1) -> tuple[list[dict], int]:
    """log within-sums against uniform reference frames of the same size; the smallest k within one standard error."""
    spark = df.sparkSession
    n = df.count()
    ranges = df.agg(*(x for c in names for x in (F.min(f"`{c}`"), F.max(f"`{c}`")))).first()
    out = []
    for k in range(1, k_max + 1):
        own = math.log(max(kmeans(df, names, k, normalize=False, seed=seed).within, 1e-300))
        refs = []
        for i in range(b):
            made = spark.range(n).select(*((F.lit(float(ranges[2 * j])) + (F.shiftrightunsigned(F.xxhash64(F.lit(seed * 1000 + i), F.lit(j), "id"), 11) / float(1 << 53)) * float(ranges[2 * j + 1] - ranges[2 * j])).alias(c) for j, c in enumerate(names)))
            refs.append(math.log(max(kmeans(made, names, k, normalize=False, seed=seed).within, 1e-300)))
        out.append({"k": k, "gap": float(np.mean(refs) - own), "se": float(np.std(refs) * math.sqrt(1 + 1 / b))})
    best = next((a["k"] for a, nxt in zip(out, out[1:], strict=False) if a["gap"] >= nxt["gap"] - nxt["se"]), k_max)
    return out, best


# -- survival -----------------------------------------------------------------------------------------------------


def coxph(df: DataFrame, stop: str, event: str, names: Sequence[str], start: str | None = None, ties: str = "efron", max_iter: int = 20, tol: float = 1e-9, max_times: int = 10_000, weights: str | None = None) -> dict:
    """Proportional hazards by Newton steps.  Each step aggregates by stop time and by start time, at most ``max_times`` of each.

    Returns coef, se, loglik, n, events, iterations, the means that the hazard is centred on, and the baseline: (time,
    cumulative hazard) by the estimator that goes with the ties.  weights: a column by which each row counts.
    """
    xs = [F.col(f"`{c}`").cast("double") for c in names]
    cols = [F.col(stop).cast("int").alias("_t"), F.col(event).cast("int").alias("_e"), (F.col(start).cast("int") if start else F.lit(None).cast("int")).alias("_s"), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("_w"), *(x.alias(f"_x{i}") for i, x in enumerate(xs))]
    data = df.select(*cols).where("_w > 0").dropna(subset=["_t", "_e", *(f"_x{i}" for i in range(len(names)))])
    means = np.array(data.agg(*(F.sum(F.col(f"_x{i}") * F.col("_w")) / F.sum("_w") for i in range(len(names)))).first())
    k = len(names)
    beta, ll = np.zeros(k), -math.inf
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for it in range(1, max_iter + 1):
        c = [F.col(f"_x{i}") - float(means[i]) for i in range(k)]
        r = F.exp(sum((c[i] * float(beta[i]) for i in range(k)), F.lit(0.0)))

        def sums(keep: Column, prefix: str) -> list[Column]:
            w = F.when(keep, r * F.col("_w")).otherwise(0.0)
            return [F.sum(w).alias(f"{prefix}0"), *(F.sum(w * c[i]).alias(f"{prefix}1_{i}") for i in range(k)), *(F.sum(w * c[i] * c[j]).alias(f"{prefix}2_{i}_{j}") for i, j in pairs)]

        dead = F.col("_e") == 1
        one = data.groupBy("_t").agg(F.sum("_e").alias("d"), F.sum(F.when(dead, F.col("_w")).otherwise(0.0)).alias("wd"), *(F.sum(F.when(dead, c[i] * F.col("_w")).otherwise(0.0)).alias(f"x{i}") for i in range(k)), *sums(F.lit(True), "a"), *sums(dead, "e")).orderBy(F.desc("_t")).limit(max_times + 1).collect()
        if len(one) > max_times:
            raise ValueError(f"more than {max_times} times")
        late = data.where("_s IS NOT NULL").groupBy("_s").agg(*sums(F.lit(True), "a")).orderBy(F.desc("_s")).limit(max_times + 1).collect() if start else []
        if len(late) > max_times:
            raise ValueError(f"more than {max_times} start times")

        def unpack(row, prefix):
            m = np.zeros((k, k))
            for i, j in pairs:
                m[i, j] = m[j, i] = row[f"{prefix}2_{i}_{j}"]
            return row[f"{prefix}0"], np.array([row[f"{prefix}1_{i}"] for i in range(k)]), m

        s0, s1, s2 = 0.0, np.zeros(k), np.zeros((k, k))
        new_ll, grad, hess, at, steps = 0.0, np.zeros(k), np.zeros((k, k)), 0, []
        for row in one:  # from the last time: those at risk enter at their stop and leave at their start
            a0, a1, a2 = unpack(row, "a")
            s0, s1, s2 = s0 + a0, s1 + a1, s2 + a2
            while at < len(late) and late[at]["_s"] >= row["_t"]:
                b0, b1, b2 = unpack(late[at], "a")
                s0, s1, s2, at = s0 - b0, s1 - b1, s2 - b2, at + 1
            d = row["d"]
            if not d:
                continue
            e0, e1, e2 = unpack(row, "e")
            x = np.array([row[f"x{i}"] for i in range(k)])
            new_ll += float(x @ beta)
            grad += x
            each, jump = row["wd"] / d, 0.0  # of tied deaths, each has their mean weight
            for m in range(d):
                f = m / d if ties == "efron" else 0.0
                t0, t1, t2 = s0 - f * e0, s1 - f * e1, s2 - f * e2
                new_ll -= each * math.log(t0)
                grad -= each * t1 / t0
                hess += each * (t2 / t0 - np.outer(t1, t1) / t0**2)
                jump += each / t0
            steps.append((row["_t"], jump))
        if abs(new_ll - ll) < tol * max(1.0, abs(ll)):
            break
        ll = new_ll
        beta = beta + np.linalg.solve(hess, grad)
    n, events = data.agg(F.count("*"), F.sum("_e")).first()
    baseline, total = [], 0.0
    for time, jump in reversed(steps):
        total += jump
        baseline.append((time, total))
    return {"means": dict(zip(names, means.tolist(), strict=True)), "baseline": baseline, "coef": dict(zip(names, beta.tolist(), strict=True)), "se": dict(zip(names, np.sqrt(np.diag(np.linalg.inv(hess))).tolist(), strict=True)), "loglik": new_ll, "n": n, "events": events, "iterations": it}


def survfit(model: dict, **x: float) -> list[tuple[int, float, float]]:
    """(time, cumulative hazard, survival) of a ``coxph`` model for one set of values (the means where they are not given)."""
    r = math.exp(sum(b * (x.get(n, model["means"][n]) - model["means"][n]) for n, b in model["coef"].items()))
    return [(t, h * r, math.exp(-h * r)) for t, h in model["baseline"]]


# -- saving and export --------------------------------------------------------------------------------------------


def save_model(model) -> str:
    """GLM, NaiveBayes, PCA, KMeans, Multinomial and coxph results as JSON."""
    plain = lambda v: {"_array": v.tolist()} if isinstance(v, np.ndarray) else v
    state = model if isinstance(model, dict) else model.__dict__
    return json.dumps({"kind": "dict" if isinstance(model, dict) else type(model).__name__, "state": {k: plain(v) for k, v in state.items()}})


def load_model(text: str):
    made = json.loads(text)
    state = {k: np.array(v["_array"]) if isinstance(v, dict) and "_array" in v else v for k, v in made["state"].items()}
    if made["kind"] == "dict":
        return {**state, "baseline": [tuple(r) for r in state.get("baseline", [])]}
    return {c.__name__: c for c in (GLM, NaiveBayes, PCA, KMeans, Multinomial)}[made["kind"]](**state)


def export_sql(model, names: Sequence[str] = ()) -> str:
    """A scoring expression in SQL: of a GLM its mean, of pyspark.ml trees their mean, sum of votes or margin."""
    if isinstance(model, GLM):
        eta = " + ".join([repr(float(model.beta[0])), *(f"{float(b)!r} * CAST(`{n}` AS DOUBLE)" for n, b in zip(model.names, model.beta[1:], strict=True))])
        return {"identity": f"({eta})", "logit": f"(1 / (1 + exp(-({eta}))))", "log": f"exp({eta})", "inverse": f"(1 / ({eta}))"}[model.link]
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            return repr(float(n.prediction()))
        split = n.split()
        return f"CASE WHEN CAST(`{names[split.featureIndex()]}` AS DOUBLE) <= {float(split.threshold())!r} THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return "(" + " + ".join(f"{float(w)!r} * {node(t._call_java('rootNode'))}" for w, t in zip(weights, trees, strict=True)) + ")"


# -- boosting of several classes, forests with their own test rows --------------------------------------------------


@dataclass
class Multinomial:
    """Sums of trees for each class, as SQL expressions; probabilities by softmax."""

    names: list[str]
    classes: list[str]
    start: list[float]
    trees: list[list[str]]

    def _logs(self) -> list[Column]:
        return [F.expr(" + ".join([repr(b), *(f"({t})" for t in own)])) for b, own in zip(self.start, self.trees, strict=True)]

    def predict(self, df: DataFrame) -> DataFrame:
        """``predict`` and one probability column for each class."""
        out = df.select("*", *(x.alias(f"_l{i}") for i, x in enumerate(self._logs())))
        ls = [F.col(f"_l{i}") for i in range(len(self.classes))]
        top = F.greatest(*ls)
        total = sum((F.exp(x - top) for x in ls[1:]), F.exp(ls[0] - top))
        label = F.lit(self.classes[-1])
        for c, x in reversed(list(zip(self.classes[:-1], ls[:-1], strict=True))):
            label = F.when(x == top, F.lit(c)).otherwise(label)
        return out.select(*df.columns, label.alias("predict"), *((F.exp(x - top) / total).alias(f"p.{c}") for c, x in zip(self.classes, ls, strict=True)))


def multinomial_boosting(df: DataFrame, response: str, names: Sequence[str], ntrees: int = 10, depth: int = 3, rate: float = 0.1, bins: int = 32, min_rows: int = 10, most_classes: int = 100) -> Multinomial:
    """One regression tree for each class and round, fitted to its residuals; leaves are Newton steps of the deviance.

    Equal rows are put together once, with their number as weight; all rounds read these, and the model so far is an expression.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    some = df.select(F.col(response).cast("string").alias("_y"), *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).dropna()
    some = checkpointed(some.groupBy("_y", *(f"`{n}`" for n in names)).agg(F.count("*").cast("double").alias("_w")))
    counts = {r["_y"]: r["n"] for r in some.groupBy("_y").agg(F.sum("_w").alias("n")).orderBy("_y").limit(most_classes + 1).collect()}
    if not 2 <= len(counts) <= most_classes:
        raise ValueError(f"2 to {most_classes} classes")
    classes, n = list(counts), sum(counts.values())
    model = Multinomial(list(names), classes, [math.log(counts[c] / n) for c in classes], [[] for _ in classes])
    k = len(classes)
    for _ in range(ntrees):
        scored = _assembled(model.predict(some), names)
        rounds = []
        for c in classes:
            left = scored.withColumn("_r", (F.col("_y") == c).cast("double") - F.col(f"`p.{c}`"))
            tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_r", maxDepth=depth, maxBins=bins, weightCol="_w", minWeightFractionPerNode=max(0.0, min(0.499, (min_rows - 0.5) / n)), leafCol="_leaf").fit(left)
            size = F.abs(F.col("_r"))
            steps = {int(r["_leaf"]): (k - 1) / k * r["a"] / max(r["b"], 1e-12) for r in tree.transform(left).groupBy("_leaf").agg(F.sum(F.col("_r") * F.col("_w")).alias("a"), F.sum(size * (1 - size) * F.col("_w")).alias("b")).collect()}
            rounds.append(_with_leaves(tree, names, {leaf: rate * v for leaf, v in steps.items()}))
        for own, made in zip(model.trees, rounds, strict=True):
            own.append(made)
    return model


def _with_leaves(tree, names: Sequence[str], values: dict[int, float]) -> str:
    """A tree as SQL with other values in its leaves, which are numbered from left to right."""
    at = iter(range(1 << 30))

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            return repr(float(values.get(next(at), 0.0)))
        split = n.split()
        return f"CASE WHEN `{names[split.featureIndex()]}` <= {float(split.threshold())!r} THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return node(tree._call_java("rootNode"))


def forest_out_of_bag(df: DataFrame, response: str, names: Sequence[str], keys: Sequence[str], ntrees: int = 10, depth: int = 5, rate: float = 0.632, impurity: str = "gini", seed: int = 1) -> tuple[list[str], DataFrame]:
    """(trees as SQL of the predicted class number, rows with ``oob``: the class that the trees not fitted on a row choose).

    A hash of the keys decides which rows each tree is fitted on; impurity: gini or entropy.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    data = df.withColumn("_label", F.col(response).cast("double"))
    trees, votes = [], []
    for t in range(ntrees):
        inside = F.abs(F.xxhash64(F.lit(seed * 1000 + t), *keys) % (1 << 30)) < int(rate * (1 << 30))
        model = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=depth, impurity=impurity).fit(_assembled(data.where(inside), names))
        trees.append(export_sql(model, names))
        votes.append(F.when(~inside, F.expr(trees[-1])))
    cast = F.array_compact(F.array(*votes))
    # the commonest vote, the lowest of equals
    best = F.array_max(F.transform(F.array_distinct(cast), lambda v: F.struct(F.size(F.filter(cast, lambda x: x == v)).alias("n"), (-v).alias("v"))))
    return trees, data.select(*df.columns, (-best["v"]).alias("oob"))


# -- pyspark.ml ---------------------------------------------------------------------------------------------------


def _assembled(df: DataFrame, names: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="_features", handleInvalid="skip").transform(df)


def _spread(df: DataFrame, names: Sequence[str], most: int = 1 << 18) -> DataFrame:
    """These columns, over so many tasks that each holds about ``most`` rows: the fits of pyspark.ml keep rows as objects."""
    rows = df.select(*(F.col(f"`{n}`") for n in names))
    n = rows.count()
    return rows.repartition(-(-n // most)) if n > most else rows


def tree_model(df: DataFrame, response: str, names: Sequence[str], kind: str = "gbm", classify: bool = True, **options):
    """(fitted pyspark.ml model, the columns it was fitted on).  kind: gbm (two classes, or numbers), drf, mlp."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    held = list(dict.fromkeys([*names, response, *([options["weights"]] if "weights" in options else [])]))
    data = _assembled(_spread(df, held), names).withColumn("_label", F.col(response).cast("double"))
    common = {"featuresCol": "_features", "labelCol": "_label"}
    if kind == "gbm":
        est = (C.GBTClassifier if classify else R.GBTRegressor)(**common, maxIter=options.get("ntrees", 50), maxDepth=options.get("depth", 5), stepSize=options.get("learn_rate", 0.1), minInstancesPerNode=options.get("min_rows", 10), maxBins=options.get("nbins", 32), seed=options.get("seed", 1))
    elif kind == "drf":
        more = {"impurity": options["impurity"]} if "impurity" in options else {}
        more |= {"weightCol": options["weights"]} if "weights" in options else {}
        more |= {"featureSubsetStrategy": str(options["mtries"])} if "mtries" in options else {}
        est = (C.RandomForestClassifier if classify else R.RandomForestRegressor)(**common, **more, numTrees=options.get("ntrees", 50), maxDepth=options.get("depth", 10), subsamplingRate=options.get("sample_rate", 0.6667), maxBins=options.get("nbins", 32), seed=options.get("seed", 1))
    elif kind == "mlp":
        classes = data.select("_label").distinct().count()
        est = C.MultilayerPerceptronClassifier(**common, layers=[len(names), *options.get("hidden", [10]), classes], maxIter=options.get("max_iter", 50), seed=options.get("seed", 1))
    else:
        raise ValueError(kind)
    return est.fit(data), data


def importance(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Relative importance, largest first, scaled to 1."""
    v = model.featureImportances.toArray()
    top = v.max() or 1.0
    return sorted(((n, float(x / top)) for n, x in zip(names, v, strict=True)), key=lambda p: -p[1])


def predict(model, df: DataFrame, names: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """``predict`` and one probability column for each class."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assembled(df, names))
    probs = [vector_to_array("probability")[i].alias(f"p.{c}") for i, c in enumerate(classes)] if "probability" in out.columns else []
    label = F.element_at(F.array(*map(F.lit, classes)), F.col("prediction").cast("int") + 1) if classes else F.col("prediction")
    return out.select(*df.columns, label.alias("predict"), *probs)


def grid_search(df: DataFrame, fit, score, grid: dict[str, Sequence]) -> list[tuple[dict, float]]:
    """(parameters, score) of every combination, best first."""
    from itertools import product

    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        out.append((params, score(fit(df, **params), df)))
    return sorted(out, key=lambda p: -p[1])


def cross_validate(df: DataFrame, fit, score, k: int, fold: str = "fold") -> list[float]:
    """score(model fitted on the other folds, fold) for each fold of a frame that has a fold column."""
    return [score(fit(df.where(F.col(fold) != i)), df.where(F.col(fold) == i)) for i in range(k)]


def prior_correction(p: Column, share_in_model: float, share_in_truth: float) -> Column:
    """A probability from a model of balanced classes, for the true share."""
    a, b = share_in_truth / share_in_model, (1 - share_in_truth) / (1 - share_in_model)
    return p * a / (p * a + (1 - p) * b)


def scorecard(df: DataFrame, rules: dict[str, list[tuple[str, float]]], start: float = 0.0, to: str = "score") -> DataFrame:
    """Sum over features of the first rule (SQL condition, points) that holds."""
    total = F.lit(start)
    for group in rules.values():
        points = F.lit(0.0)
        for condition, p in reversed(group):
            points = F.when(F.expr(condition), F.lit(p)).otherwise(points)
        total = total + points
    return df.withColumn(to, total)


def pcr(df: DataFrame, response: str, names: Sequence[str], n: int, family: str = "gaussian") -> tuple[PCA, GLM]:
    """Principal components, then a linear model on the first n."""
    p = pca(df, names, max_pc=n)
    return p, glm(p.project(df), response, [f"PC{i}" for i in range(p.vectors.shape[1])], family)


def anomaly(df: DataFrame, names: Sequence[str], n: int, factor: float = 10.0) -> DataFrame:
    """Reconstruction error from n principal components, and whether it is over ``factor`` times its mean."""
    p = pca(df, names, max_pc=n)
    scores = p.project(df)
    error = F.lit(0.0)
    for i, c in enumerate(p.names):
        back = F.lit(0.0)
        for j in range(p.vectors.shape[1]):
            back = back + F.col(f"PC{j}") * float(p.vectors[i, j])
        x = (F.col(f"`{c}`").cast("double") - float(p.mean[i])) / float(p.scale[i])
        error = error + (x - back) * (x - back)
    out = scores.select(*df.columns, (error / len(p.names)).alias("mse"))
    mean = out.agg(F.avg("mse")).first()[0]
    return out.withColumn("anomaly", F.col("mse") > factor * (mean or 0.0))


def design_glm(df: DataFrame, response: str, cols: Sequence[str], family: str = "gaussian", **options) -> GLM:
    """A model over factors (one-hot) and standardised numbers."""
    made, names = encode.design(df, cols)
    return glm(made, response, names, family, **options)
