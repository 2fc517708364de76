"""Operator 9: quality rules as a learned decision list.

Sequential covering on labelled statistics: each rule grows, threshold by threshold, the
conjunction that best tells bad texts apart on one part of the labelled rows, is pruned on
the other part, and covers its rows; the list becomes one ordered Spark conditional.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .textstats import RATIOS, bounded, one_label, text_counts, with_ratios

#: Labelled rows to learn from, at most about; a rule's least precision on the pruning part.
LABELLED, PRECISION = 20_000, 0.9
Rule = list[tuple[str, str, float]]


def _holds(x: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, sign, cut in rule:
        v = x[:, names.index(name)]
        ok &= v >= cut if sign == ">=" else v <= cut
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> Rule:
    """Adds the threshold of the highest FOIL gain while there is one."""
    rule: Rule = []
    live = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for k, name in enumerate(names):
            for cut in np.unique(np.quantile(x[live & bad, k], np.linspace(0, 1, 33))):
                for sign in (">=", "<="):
                    ok = live & (x[:, k] >= cut if sign == ">=" else x[:, k] <= cut)
                    p = int((ok & bad).sum())
                    if p:
                        gain = p * (math.log2(p / int(ok.sum())) - base)
                        if gain > best[0]:
                            best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _holds(x, names, rule[-1:])
    return rule


def _worth(x: np.ndarray, bad: np.ndarray, names: list[str], rule: Rule) -> float:
    ok = _holds(x, names, rule)
    p = int((ok & bad).sum())
    return (2 * p - int(ok.sum())) / max(1, int(ok.sum())) if p else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], most_rules: int = 12, most_terms: int = 4, precision: float = PRECISION, seed: int = 9) -> list[Rule]:
    """An ordered list of conjunctions; a text that meets one is dropped. Empty without both labels."""
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    live, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules:
        grow, prune = live & part, live & ~part
        if bad[grow].sum() < 5 or not (~bad[grow]).any():
            break
        rule = _grow(x[grow], bad[grow], names, most_terms)
        while len(rule) > 1 and _worth(x[prune], bad[prune], names, rule[:-1]) >= _worth(x[prune], bad[prune], names, rule):
            rule = rule[:-1]
        ok = _holds(x[prune], names, rule)
        if not rule or ok.sum() < 2 or bad[prune][ok].mean() < precision:
            break
        rules.append(rule)
        live &= ~_holds(x, names, rule)
    return rules


def as_condition(rules: list[Rule]) -> Column:
    """Whether a text is kept: the rules in order, as one conditional."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (F.col(name) >= cut if sign == ">=" else F.col(name) <= cut)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Every row's id, counts, ratios and ``verdict``, and the list learned.

    At most about LABELLED labelled rows come to the driver, as statistics. Null texts have
    counts of zero; null or repeated ids stay rows of their own; label 0 is bad; without
    labels of both kinds nothing is learned and every verdict is to keep.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.keep(with_ratios(text_counts(docs, id_col, text_col)), "stats")
    known = bounded(stats.join(one_label(labels, id_col, label_col), "id"), LABELLED, 9)
    rows = np.array([list(r) for r in known.select("label", *RATIOS).orderBy("id").collect()], float).reshape(-1, 1 + len(RATIOS))
    rules = learn_rules(rows[:, 1:], rows[:, 0] == 0, RATIOS)
    return stats.withColumn("verdict", as_condition(rules)), rules


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "verdict")
    return base.withColumn("kept", ~F.col("base_failed") & F.col("verdict")).drop("verdict")
