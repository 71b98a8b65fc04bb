"""Recalibration of calls: features, normalisation, good and bad mixtures, log odds, ROC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.intervals import before, buckets
from varloom.operators.qc import cumulative, sample_cap
from varloom.sources.shared import stored

FEATURES = ["biallelic", "inb_coeff", "leg", "n_ratio", "alt_perfect", "both_imperfect"]
#: Training rows that the mixtures are fitted to, at most.
MAX_ROWS = 50_000


def leg(q_start: Column, q_end: Column, length: Column) -> Column:
    """The shorter unaligned end of a scaffold, in whole per cent."""
    s = F.least(F.floor(q_start * 100 / length), F.lit(100))
    e = F.least(F.floor(q_end * 100 / length), F.lit(100))
    return F.least(s, 100 - e)


def sample_features(sites: DataFrame, genotypes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per site and sample the FEATURES, of genotyped VCF (read_vcf): whether the site has one alternative, InbCoeff to two digits, the shorter
    unaligned end of the sample's scaffold (QR id-start-end, the last one of several), the share of N (NR) in per cent to one digit, and of the reads
    (AA) those that fit the alternative only and neither. lengths: sample, scaffold, len.

    Sites without InbCoeff or QR have none, nor samples that are missing, without a place or without four counts; a scaffold without a
    length is an error where it is met."""
    from varloom.operators.support import with_lengths

    own = sites.where(F.col("info").getItem("InbCoeff").isNotNull()).select(
        F.col("line_no").alias("site"), "chrom", "pos", (F.size("alts") == 1).cast("double").alias("biallelic"), F.round(F.col("info").getItem("InbCoeff").cast("double"), 2).alias("inb_coeff")
    )
    tag = lambda k: F.col("fmt").getItem(k)
    counts = F.split(tag("AA"), ",")
    there = (F.coalesce("gt", F.lit("./.")) != "./.") & (F.size(counts) == 4) & (F.coalesce(tag("QR"), F.lit(".")) != ".")
    place = F.split(F.element_at(F.split(tag("QR"), ","), -1), "-")
    scaffold = F.when(F.size("place") > 3, F.concat_ws("-", F.get("place", 0), F.get("place", 1))).otherwise(F.get("place", 0))
    rows = genotypes.where(there).select(F.col("line_no").alias("site"), "sample", place.alias("place"), tag("NR").cast("double").alias("nr"), F.get(counts, 1).cast("double").alias("alt_perfect"), F.get(counts, 3).cast("double").alias("both_imperfect"))
    rows = rows.select("site", "sample", scaffold.alias("scaffold"), F.element_at("place", -2).cast("long").alias("q_start"), F.element_at("place", -1).cast("long").alias("q_end"), "nr", "alt_perfect", "both_imperfect")
    rows = with_lengths(rows, lengths).withColumn("leg", leg(F.col("q_start"), F.col("q_end"), F.col("len")).cast("double")).withColumn("n_ratio", F.floor(1000 * F.col("nr") + 0.5) / 10)
    return own.join(rows, "site").select("site", "chrom", "pos", "sample", *FEATURES)


def site_features(sites: DataFrame, genotypes: DataFrame, lengths: DataFrame, training: DataFrame) -> DataFrame:
    """What recalibrate() takes: per site the medians of its samples' features, and whether the site is among the training sites
    (chrom, pos). A site none of whose samples has features is left out."""
    from varloom.operators.support import marked

    rows = sample_features(sites, genotypes, lengths)
    medians = rows.groupBy("site", "chrom", "pos").agg(*[F.median(c).alias(c) for c in FEATURES])
    return marked(medians, training, ["chrom", "pos"], "training")


def scored_vcf(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """Sites (read_vcf) with their scores: VQ (the log odds to two digits) and CU (the culprit) in INFO, POSITIVE_TRAIN_SITE and
    NEGATIVE_TRAIN_SITE where they are, and VQ, but nothing below 0, as QUAL. scores: site (the line number), lod, culprit, positive, negative."""
    lod = F.round("lod", 2)
    more = F.map_from_arrays(F.array(F.lit("VQ"), F.lit("CU")), F.array(lod.cast("string"), F.col("culprit")))
    flag = lambda c, name: F.when(F.col(c), F.create_map(F.lit(name), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    new = ["VQ", "CU", "POSITIVE_TRAIN_SITE", "NEGATIVE_TRAIN_SITE"]
    rows = sites.join(scores.withColumnRenamed("site", "line_no"), "line_no")
    kept = F.map_filter(F.coalesce("info", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*new))
    info = F.map_concat(kept, more, flag("positive", new[2]), flag("negative", new[3]))
    return rows.withColumns({"info": info, "qual": F.greatest(lod, F.lit(0.0))}).select(*sites.columns)


def info_text(info: Column) -> Column:
    """INFO by key; keys without a value stand alone."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(info), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))), ";")


def site_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """A16."""
    return df.groupBy("site").agg(*[F.median(c).alias(c) for c in features])


def normalised(df: DataFrame, features: list[str], least: float = 1e-5) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Z-scores by population deviation, and whether one is over 10. One row of moments comes to the driver;
    a constant feature is an error."""
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    flat = [c for c in features if m[f"s_{c}"] is None or m[f"s_{c}"] < least]
    if flat:
        raise ValueError(f"features without variance: {flat}")
    z = {c: (F.col(c) - m[f"m_{c}"]) / m[f"s_{c}"] for c in features}
    out = df.withColumns({f"z_{c}": z[c] for c in features}).withColumn("failing", F.greatest(*[F.abs(z[c]) for c in features]) > 10)
    return out, {c: (m[f"m_{c}"], m[f"s_{c}"]) for c in features}


class Mixture:
    """A full-covariance Gaussian mixture."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> None:
        self.weight, self.mean, self.cov = weight, mean, cov

    def joint(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w, m, c in zip(self.weight, self.mean, self.cov, strict=True):
            chol = np.linalg.cholesky(c)
            y = np.linalg.solve(chol, (x - m).T)
            out.append(np.log(w) - 0.5 * (y**2).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * len(m) * np.log(2 * np.pi))
        return np.stack(out, 1)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        j = self.joint(x)
        top = j.max(1, keepdims=True)
        return top[:, 0] + np.log(np.exp(j - top).sum(1))

    def bic(self, x: np.ndarray) -> float:
        k, d = self.mean.shape
        return -2 * float(self.log_likelihood(x).sum()) + (k * (1 + d + d * (d + 1) / 2) - 1) * np.log(len(x))


def moments(x: np.ndarray) -> np.ndarray:
    """1, the features and their products, per row: densities and sums of all components are products with this."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


def run_em(x: np.ndarray, phi: np.ndarray, k: int, seed: int, rounds: int = 150, tol: float = 2e-3, floor: float = 1e-3) -> tuple[Mixture, float, bool]:
    """One start from k random rows: the mixture, its mean log-likelihood and whether it converged. phi: moments(x)."""
    rng = np.random.default_rng(seed)
    (n, d), (i, j) = x.shape, np.triu_indices(x.shape[1])
    twice = np.where(i == j, 1.0, 2.0)
    mean = x[rng.choice(n, k, replace=n < k)]
    m = Mixture(np.full(k, 1 / k), mean, np.stack([np.cov(x.T).reshape(d, d) + floor * np.eye(d)] * k))
    last = -np.inf
    for _ in range(rounds):
        inv = np.linalg.inv(m.cov)
        line = np.einsum("kij,kj->ki", inv, m.mean)
        const = np.log(m.weight) - 0.5 * (np.linalg.slogdet(m.cov)[1] + (line * m.mean).sum(1) + d * np.log(2 * np.pi))
        joint = phi @ np.concatenate([const[:, None], line, -0.5 * inv[:, i, j] * twice], 1).T
        top = joint.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        if abs(norm.mean() - last) < tol:
            return m, last, True
        last = float(norm.mean())
        sums = np.exp(joint - norm[:, None]).T @ phi
        mass = sums[:, 0] + 1e-9
        mean = sums[:, 1 : d + 1] / mass[:, None]
        cov = np.zeros((k, d, d))
        cov[:, i, j] = cov[:, j, i] = sums[:, d + 1 :] / mass[:, None]
        m = Mixture(mass / mass.sum(), mean, cov - mean[:, :, None] * mean[:, None, :] + floor * np.eye(d))
    return m, last, False


#: Starts of each mixture.
STARTS = 100


def best_mixture(spark: SparkSession, x: np.ndarray, most: int, seed: int = 1, starts: int = STARTS) -> Mixture:
    """Of mixtures of 1 to most components, each from so many random starts, the converged one of the least BIC (the
    fewest components and the first start on ties); an error if none converges. Every start is a row, dealt over tasks; the
    training rows (MAX_ROWS at most) go along. One row comes back."""
    kind = "k int, start int, bic double, weight array<double>, mean array<double>, cov array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phi = moments(x)
        for b in batches:
            rows = []
            for job in b["id"]:
                k, start = divmod(int(job), starts)
                m, _, done = run_em(x, phi, k + 1, seed * 1_000_003 + int(job))
                if done:
                    rows.append((k + 1, start, m.bic(x), m.weight.tolist(), m.mean.ravel().tolist(), m.cov.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["k", "start", "bic", "weight", "mean", "cov"])

    jobs = most * starts
    # hashed, so that each task gets starts of every size
    done = spark.range(jobs).repartition(min(jobs, 4 * spark.sparkContext.defaultParallelism), F.xxhash64("id")).mapInPandas(run, kind)
    best = done.agg(F.min_by(F.struct("k", "weight", "mean", "cov"), F.struct("bic", "k", "start")).alias("b")).first()["b"]
    if best is None:
        raise RuntimeError(f"no mixture of up to {most} components converged in {starts} starts each")
    k, d = best["k"], x.shape[1]
    return Mixture(np.array(best["weight"]), np.array(best["mean"]).reshape(k, d), np.array(best["cov"]).reshape(k, d, d))


def log_odds(df: DataFrame, good: Mixture, bad: Mixture | None, features: list[str], prior: float = 2.0) -> DataFrame:
    """Lod (log10 of the densities, with the prior) and the culprit, the feature of the least 1-D difference."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[[f"z_{c}" for c in features]].to_numpy(float)
            lod = good.log_likelihood(x) / np.log(10)
            culprit = [None] * len(b)
            if bad is not None:
                lod = prior + lod - bad.log_likelihood(x) / np.log(10)
                one = [np.stack([marginal(m, x[:, i], i) for i in range(x.shape[1])], 1) for m in (good, bad)]
                culprit = [features[i] for i in (one[0] - one[1]).argmin(1)]
            yield b.assign(lod=lod, culprit=culprit)

    kinds = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    return df.mapInPandas(score, f"{kinds}, lod double, culprit string")


def marginal(m: Mixture, x: np.ndarray, i: int) -> np.ndarray:
    """log10 density of one feature; the variance stands where a deviation would."""
    sd = m.cov[:, i, i]
    j = np.log(m.weight) - 0.5 * ((x[:, None] - m.mean[None, :, i]) / sd) ** 2 - np.log(sd * np.sqrt(2 * np.pi))
    top = j.max(1, keepdims=True)
    return (top[:, 0] + np.log(np.exp(j - top).sum(1))) / np.log(10)


def training_rows(df: DataFrame, features: list[str], most: int = MAX_ROWS, seed: int = 1) -> np.ndarray:
    """At most so many rows, by a seeded hash of the site."""
    return sample_cap(df, most, "site", seed).select(*[f"z_{c}" for c in features]).toPandas().to_numpy(float)


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold, tpr and fpr in descending order of the score, and each threshold's share of the area."""
    n = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("f"))
    total = n.agg(F.sum("p").alias("_P"), F.sum("f").alias("_F"))
    rows = n.withColumn("_at", -buckets(n, score)).withColumn("_o", -F.col(score)).withColumn("_all", F.lit(0))
    rows = before(rows, ["_all"], "_at", ["_at", "_o"], {"tp0": ("sum", F.col("p")), "fp0": ("sum", F.col("f"))}, bits=0)
    rows = rows.join(F.broadcast(total))
    return rows.select(
        F.col(score).alias("threshold"), ((F.col("tp0") + F.col("p")) / F.col("_P")).alias("tpr"), ((F.col("fp0") + F.col("f")) / F.col("_F")).alias("fpr"),
        ((F.col("f") / F.col("_F")) * (2 * F.col("tp0") + F.col("p")) / F.col("_P") / 2).alias("area"),
    )


def lod_cutoff(roc_rows: DataFrame, tpr: float = 0.99) -> float:
    """The rounded threshold of the first point over that rate (half away from zero)."""
    return float(roc_rows.where(F.col("tpr") > tpr).agg(F.round(F.max("threshold")).alias("t")).first()["t"])


def recalibrate(sites: DataFrame, features: list[str], seed: int = 1, starts: int = STARTS) -> DataFrame:
    """Sites (site, training, features) with lod, culprit, failing and marks of both training sets; a row of each site's row. The sites and
    their first scores are made once, as every step of the fit reads them."""
    spark = sites.sparkSession
    rows, _ = normalised(stored(sites.select("site", "training", *features), "sites"), features)
    good = best_mixture(spark, training_rows(rows.where("training and not failing"), features, seed=seed), 6, seed, starts)
    first = log_odds(rows, good, None, features).select("site", "training", "failing", *[f"z_{c}" for c in features], F.col("lod").alias("first"))
    first = stored(first, "scored")
    cut = lod_cutoff(roc(first, "first", "training"))
    first = first.withColumn("negative", (F.col("first") < cut) & ~F.col("failing"))
    x = training_rows(first.where("negative"), features, seed=seed)
    bad = best_mixture(spark, x, 4, seed, starts) if len(x) > 2 * len(features) else None
    return log_odds(first, good, bad, features).select("site", "training", "negative", "failing", "lod", "culprit")


def culprit_points(df: DataFrame, score: str, features: list[str]) -> DataFrame:
    """The points of each culprit's scatter plot: score and the culprit's own value, of training sites and others. df: culprit, training,
    line_no, the score and the features."""
    value = F.coalesce(*[F.when(F.col("culprit") == c, F.col(c).cast("double")) for c in features])
    return df.where(F.col("culprit").isin(*features)).select("culprit", "training", "line_no", F.col(score).cast("double").alias("score"), value.alias("value"))


def culprits(df: DataFrame) -> DataFrame:
    """How often each feature is the culprit, and the sites over each threshold."""
    return df.groupBy("culprit").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("lod") >= t).alias(f"lod{t}") for t in range(5)])


def feature_summary(df: DataFrame, c: str) -> DataFrame:
    """Mean, deviation and quartiles. The quartiles are read off the cumulative counts of the values, interpolated between
    neighbours, so no task holds all values."""
    rows = cumulative(df.where(F.col(c).isNotNull()), c)
    rows = rows.join(F.broadcast(rows.agg(F.max("running").alias("_n"))))  # one row
    at = lambda i: F.min(F.when(F.col("running") > i, F.col(c).cast("double")))
    quartiles = []
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        place = (F.col("_n") - 1) * p
        quartiles += [at(F.floor(place)).alias(f"_lo{name}"), at(F.ceil(place)).alias(f"_hi{name}"), F.max(place - F.floor(place)).alias(f"_at{name}")]
    found = rows.agg(*quartiles).select(*[(F.col(f"_lo{q}") + (F.col(f"_hi{q}") - F.col(f"_lo{q}")) * F.col(f"_at{q}")).alias(q) for q in ("q25", "q50", "q75")])
    out = df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).join(F.broadcast(found))
    return out.select("mean", "std", F.col("q50").alias("median"), "q25", "q50", "q75")


def sample_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """Z-scores per sample, moments over its non-zero rows."""
    live = lambda c: F.when(F.col(c) != 0, F.col(c))
    m = df.groupBy("sample").agg(*[f(live(c)).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return df.join(m, "sample").select(*df.columns, *[((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))).alias(f"z_{c}") for c in features])


def combined_mapping_quality(df: DataFrame) -> DataFrame:
    """Per site, over samples with a positive score."""
    s = F.when(F.col("score") > 0, F.col("score"))
    return df.groupBy("site").agg((-10 * F.log10(1 - F.sum(s) / F.sum(s / (1 - F.col("mismap"))))).alias("phred"))
