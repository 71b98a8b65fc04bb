"""Genotyping: allele evidence, per-site mixtures, inbreeding, pedigrees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.variants import by_key

GENOTYPES = ["1/1", "0/1", "0/0"]  # in order of the share of reference reads


def reference_ratio(df: DataFrame, ref: str = "rr", alt: str = "aa") -> DataFrame:
    """Share of reference reads (1 without evidence), and whether there is evidence."""
    n = F.col(ref) + F.col(alt)
    return df.withColumns({"ratio": F.when(n > 0, F.col(ref) / n).otherwise(F.lit(1.0)), "informative": n > 0})


def add_filter(old: Column, name: str = "FALSE_GENOTYPE") -> Column:
    """P25: replaces . and PASS, else comes first, once."""
    return F.when(old.isin(".", "PASS"), name).when(F.array_contains(F.split(old, ";"), name), old).otherwise(F.concat(F.lit(f"{name};"), old))


def callable_sites(df: DataFrame, least: int = 10) -> DataFrame:
    """Sites with fewer samples than that, not all informative, are not callable."""
    n = df.groupBy("site").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("informative")).alias("_blank"))
    return df.join(n.select("site", ((F.col("_n") >= least) | (F.col("_blank") == 0)).alias("callable")), "site")


def blank_without_evidence(df: DataFrame) -> DataFrame:
    """P27."""
    none = ~F.col("informative")
    return df.withColumns({"gt": F.when(none, "./.").otherwise(F.col("gt")), "gq": F.when(none, 0).otherwise(F.col("gq")), "pl": F.when(none, ".").otherwise(F.col("pl"))})


def allele_counts(df: DataFrame) -> DataFrame:
    """Allele count and inbreeding coefficient per site; the genotype counts of p and q start at 1."""
    alleles = F.aggregate(F.transform(F.split("gt", "[/|]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    called = F.col("gt") != "./."
    n = df.groupBy("site").agg(
        F.sum(F.when(called, alleles).otherwise(0)).alias("ac"),
        F.count_if(F.col("gt") == "0/0").alias("n_ref"), F.count_if(F.col("gt") == "0/1").alias("n_het"), F.count_if(F.col("gt") == "1/1").alias("n_hom"),
    )
    r, h, m = (F.col(c) + 1 for c in ("n_ref", "n_het", "n_hom"))
    p = (2.0 * r + h) / (2.0 * (r + h + m))
    total = F.col("n_ref") + F.col("n_het") + F.col("n_hom")
    out = n.withColumn("inb_coeff", F.when(total > 0, 1.0 - F.col("n_het") / (2.0 * p * (1.0 - p) * total)))
    same = (F.col("n_ref") == total) | (F.col("n_het") == total) | (F.col("n_hom") == total)
    return out.withColumn("false_genotype", same)


def accepted(converged: Column, inbreeding: Column) -> Column:
    """M06."""
    return converged & (inbreeding > -0.7)


def mendel(genotypes: DataFrame, ped: DataFrame) -> DataFrame:
    """Per trio and site whether the child's genotype agrees with its parents'; trios with a missing
    genotype don't count. Two equi-joins, on site and sample."""
    gt = genotypes.select("site", "sample", F.regexp_replace("gt", "[/|]", "").alias("gt")).where("gt != '..'")
    order = lambda c: F.when(F.col(c) == "10", "01").otherwise(F.col(c))
    side = lambda who: gt.select("site", F.col("sample").alias(who), order("gt").alias(f"{who}_gt"))
    trios = ped.select("child", "father", "mother").join(side("child"), "child").join(side("father"), ["site", "father"]).join(side("mother"), ["site", "mother"])
    a, b, c = F.least("father_gt", "mother_gt"), F.greatest("father_gt", "mother_gt"), F.col("child_gt")
    known = F.col("father_gt").isin("00", "01", "11") & F.col("mother_gt").isin("00", "01", "11") & c.isin("00", "01", "11")
    pair = F.concat(a, F.lit("+"), b)
    fits = (
        F.when(pair == "00+00", c == "00").when(pair == "11+11", c == "11").when(pair == "01+01", F.lit(True))
        .when(pair == "01+11", c != "00").when(pair == "00+01", c != "11").when(pair == "00+11", c == "01")
    )
    return trios.withColumn("fits", F.when(known, fits))


def mendel_summary(trios: DataFrame) -> DataFrame:
    """Matches, violations and trios seen."""
    return trios.agg(F.count_if(F.col("fits")).alias("matches"), F.count_if(~F.col("fits")).alias("violations"), F.count(F.lit(1)).alias("trios"))


def run_summary(calls: DataFrame) -> DataFrame:
    """Genotype ratios and quality counts."""
    n = F.count_if(F.col("gt") != "./.")
    ratio = lambda g: F.round(F.count_if(F.col("gt") == g) / n, 6)
    return calls.agg(n.alias("called"), *[F.count_if(F.col("gq") >= q).alias(f"gq{q}") for q in (10, 20, 30)], ratio("0/0").alias("ref_ratio"), ratio("0/1").alias("het_ratio"), ratio("1/1").alias("hom_ratio"))


def genotype_quality(p: float) -> int:
    """M05."""
    return int(-10 * math.log10(1 - min(p, 0.9999999999)) + 0.5)


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None, :] + (x[:, None] - mean[None, :]) ** 2 / var[None, :])


def _em(x: np.ndarray, mean: np.ndarray, rounds: int = 50, tol: float = 1e-3, floor: float = 1e-3):
    """Runs from several first means (a row each) side by side: converged, means and variances of each. A run that has converged
    stays as it is."""
    runs, k = mean.shape
    mean, weight, var = mean.copy(), np.full((runs, k), 1 / k), np.full((runs, k), 0.002)
    last, done = np.full(runs, -np.inf), np.zeros(runs, bool)
    for _ in range(rounds):
        on = np.flatnonzero(~done)
        joint = -0.5 * (np.log(2 * np.pi * var[on])[:, None, :] + (x[None, :, None] - mean[on][:, None, :]) ** 2 / var[on][:, None, :]) + np.log(weight[on])[:, None, :]
        top = joint.max(2, keepdims=True)
        norm = top[:, :, 0] + np.log(np.exp(joint - top).sum(2))
        total = norm.sum(1)
        ended = np.abs(total - last[on]) < tol
        done[on[ended]] = True
        last[on] = total
        if done.all():
            break
        on, joint, norm = on[~ended], joint[~ended], norm[~ended]
        resp = np.exp(joint - norm[:, :, None])
        mass = resp.sum(1) + 1e-300
        mean[on] = np.einsum("rnk,n->rk", resp, x) / mass
        var[on] = (resp * (x[None, :, None] - mean[on][:, None, :]) ** 2).sum(1) / mass + floor
        weight[on] = np.maximum(mass / len(x), 1e-300)
    return done, mean, var


def bias_of(mean: np.ndarray, first: np.ndarray) -> float:
    """How far the means moved. Of three components the outer ones count with their sign: moves away from the middle one are a gain."""
    if len(mean) == 3:
        return float((mean[0] - first[0]) + abs(mean[1] - first[1]) + (first[2] - mean[2]))
    return float(np.abs(mean - first).sum())


#: Stands for zero in likelihoods and caps a posterior, from below one (fixed value).
NEARLY_ONE = 1 - 1e-10


def phred_likelihoods(log: np.ndarray) -> np.ndarray:
    """Phred-scaled likelihoods of the components, of equal weights, from their log densities (a row per sample): the sample's likelihood
    times the posterior over the weight. A posterior or a likelihood of zero counts as nearly one; halves are cut towards zero."""
    weight = 1 / log.shape[1]
    top = log.max(1, keepdims=True)
    total = top + np.log((weight * np.exp(log - top)).sum(1, keepdims=True))
    post = np.exp(np.log(weight) + log - total)
    post[post == 0] = NEARLY_ONE
    likelihood = np.exp(total + np.log(post) - np.log(weight))
    likelihood[likelihood == 0] = NEARLY_ONE
    return (-10 * np.log10(likelihood) + 0.5).astype(int)


def fit_site(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
    """Three components, else pairs, else one; among converged restarts the one whose means moved
    least from where they began. Returns means, variances and the genotype of each component, or None."""
    start = np.array([0.001, 0.5, 1.0])
    for sets in ([(0, 1, 2)], [(0, 1), (1, 2), (0, 2)], [(0,), (1,), (2,)]):
        best = None
        for chosen in sets:
            first = start[list(chosen)]
            for ok, mean, var in zip(*_em(x, first * np.linspace(0.8, 1.2, 8)[:, None]), strict=True):
                label = [int(np.abs(start - m).argmin()) for m in mean]
                if not ok or len(set(label)) < len(label):
                    continue
                bias = bias_of(mean, first)
                if best is None or bias < best[0]:
                    best = bias, mean, var, label
        if best:
            return best[1:]
    return None


CALLS = "site long, sample string, gt string, gq int, pl string, converged boolean"


def call_site(x: np.ndarray, informative: np.ndarray) -> list[tuple[str, int, str, bool]]:
    """gt, gq, pl and whether the site's model converged, of each sample. x: share of reference reads."""
    found = fit_site(x[informative]) if informative.any() else None
    if found is None:
        return [("./.", 0, ".", False)] * len(x)
    mean, var, label = found
    log = _log_density(x, mean, var)  # the weights count as equal
    post = np.exp(log - log.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    scores, likelihoods = np.full((len(x), 3), 65535), phred_likelihoods(log)
    for j, g in enumerate(label):
        scores[:, 2 - g] = likelihoods[:, j]
    return [(GENOTYPES[label[j]], genotype_quality(float(p)), ",".join(map(str, s)), True) for j, p, s in zip(post.argmax(1), post.max(1), scores, strict=True)]


def _called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    names = ["site", "sample", "gt", "gq", "pl", "converged"]
    out: list[tuple] = []
    for site, group in by_key(batches, 1):
        _, samples, ratio, informative = zip(*group, strict=True)
        out += [(site, s, *c) for s, c in zip(samples, call_site(np.array(ratio, float), np.array(informative, bool)), strict=True)]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def genotype(evidence: DataFrame) -> DataFrame:
    """Site, sample, gt, gq, pl. One small model per site, sites spread over tasks; a site has a row
    per sample (the cohort), which bounds a group."""
    rows = reference_ratio(evidence)
    called = rows.select("site", "sample", "ratio", "informative").repartition("site").sortWithinPartitions("site", "sample").mapInArrow(_called, CALLS)
    return blank_without_evidence(called.join(rows.select("site", "sample", "informative"), ["site", "sample"]))
