"""Operator 3: a quality classifier from trusted positives and unlabelled text.

Minimises the non-negative unbiased risk of positive-unlabelled learning: the risk that
unlabelled rows put on the negative class, less what the positives among them account for
by the class prior, never counted below zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, table
from .textstats import RATIOS, bounded, one_label, text_counts, with_ratios

#: Rows that the fit takes at most, about: trusted positives, and unlabelled rows.
POSITIVES, UNLABELLED = 10_000, 20_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of a linear score for the logistic loss."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        plus = -prior * (p.T @ (1 - sp)) / len(p)  # gradient of prior * E_p[loss(+1)]
        negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        minus = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        g = plus + minus if negative >= 0 else -minus
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from these two samples alone.

    A logistic score that tells half of the positives from half of the unlabelled rows ranks
    the other halves. The share of unlabelled rows above a threshold over that of positives
    there is never below the prior, but for chance, and comes nearest where only positives
    are left; the threshold taken has the least upper bound on that ratio.
    """
    rng = np.random.default_rng(seed)
    p, u = (x[rng.permutation(len(x))] for x in (pos, unl))
    (p0, p1), (u0, u1) = ((x[: len(x) // 2], x[len(x) // 2 :]) for x in (p, u))
    if not len(p0) or not len(u0):
        return 0.5
    w = fit_nnpu(p0, u0, 0.5)
    sp, su = (np.sort(x @ w[:-1]) for x in (p1, u1))
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.99, 200)))
    qp, qu = (1 - np.searchsorted(s, cuts) / len(s) for s in (sp, su))
    doubt = sum(np.sqrt(np.log(4 / delta) / (2 * len(s))) for s in (sp, su))
    best = int(np.argmin(qu / qp + (1 + slack) * doubt / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.95))


def linear_score(names: list[str], mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bound: float = 6.0) -> Column:
    """The logistic score over standardised, bounded columns as one expression."""
    z = F.lit(float(w[-1]))
    for k, c in enumerate(names):
        x = F.least(F.greatest((F.col(c) - float(mean[k])) / float(scale[k]), F.lit(-bound)), F.lit(bound))
        z = z + x * float(w[k])
    return 1 / (1 + F.exp(-z))


def pu_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None) -> DataFrame:
    """Every row's ``id`` and ``score``, the chance of label 1.

    ``learn`` (over id_col) says whose labels may be used; null counts as no. Positives are
    labelled 1 there; unlabelled rows come from the same rows, whatever their label. Labels
    of 0 are never looked at: the prior is estimated from the positives and the unlabelled
    rows. Without any of either the score is 0.5. A null text scores like an empty one; long
    texts are read whole. Ids may be null (never labelled) or repeat: each row is scored for
    itself, so repeated rows and ties score alike; of an id's several labels the least
    counts. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(with_ratios(text_counts(docs, id_col, text_col)).select("id", *RATIOS), "stats")
    usable = stats if learn is None else stats.withColumnRenamed("id", id_col).where(learn).withColumnRenamed(id_col, "id")
    known = usable.join(one_label(labels, id_col, label_col), "id")
    rows = lambda df, most, seed: np.array([list(r) for r in bounded(df, most, seed).select(*RATIOS).collect()], float).reshape(-1, len(RATIOS))
    pos, unl = rows(known.where("label = 1"), POSITIVES, 3), rows(usable, UNLABELLED, 4)
    if not len(pos) or not len(unl):
        return stats.select("id", F.lit(0.5).alias("score"))
    mean, scale = unl.mean(axis=0), np.maximum(unl.std(axis=0), 1e-6)
    cut = lambda x: np.clip((x - mean) / scale, -6, 6)
    pos, unl = (cut(x[np.lexsort(x.T)]) for x in (pos, unl))
    prior = estimate_prior(pos, unl)
    w = fit_nnpu(pos, unl, prior)
    # Scores of 0.5 and more go to as large a share of unlabelled rows as the prior says.
    w[-1] -= np.quantile(unl @ w[:-1] + w[-1], 1 - prior)
    return stats.select("id", linear_score(RATIOS, mean, scale, w).alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pu_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return out.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
