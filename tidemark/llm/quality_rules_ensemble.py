"""Quality classifier: a sparse ensemble of conjunctive rules over document statistics.

Boosted trees propose rules: every path from a root to a node is a conjunction of thresholds.  A lasso
logistic regression over these rules and nothing else keeps the few that matter, and the surviving rules
are compiled into one Spark column expression, so scoring runs inside the JVM on the statistics.

Null and empty texts have zero statistics and get the score these give.  Without labels, or with labels
of one class only, every score is the smoothed prior (one half without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out
from tidemark.llm.text_stats import FEATURES, feature_columns, with_counts
from tidemark.llm.training import MAX_LABELLED, labelled_sample
from tidemark.llm.trees import Tree, boost

#: A condition: feature, True for "at most" and False for "above", threshold.
Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([rule_hits(r, x) for r, _ in self.rules], axis=1) if self.rules else np.zeros((len(x), 0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + self.matrix(x) @ np.array([w for _, w in self.rules])
        return 1 / (1 + np.exp(-z))

    def score(self, features: dict[str, Column]) -> Column:
        """The same score as a Spark expression over feature columns."""
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            hit = F.lit(True)
            for j, below, t in conditions:
                c = features[FEATURES[j]]
                hit = hit & ((c <= t) if below else (c > t))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_hits(conditions, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, below, t in conditions:
        hit &= (x[:, j] <= t) if below else (x[:, j] > t)
    return hit.astype(np.float64)


def paths(tree: Tree) -> list[tuple[Condition, ...]]:
    """The conjunctions of all nodes but the root; of repeated tests of a feature only the tightest stays."""
    out = []

    def walk(node: int, held: dict[tuple[int, bool], float]):
        if held:
            out.append(tuple(sorted((j, below, t) for (j, below), t in held.items())))
        if (j := int(tree.feature[node])) < 0:
            return
        t = float(tree.threshold[node])
        walk(int(tree.left[node]), held | {(j, True): min(t, held.get((j, True), np.inf))})
        walk(int(tree.right[node]), held | {(j, False): max(t, held.get((j, False), -np.inf))})

    walk(0, {})
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept is free."""
    n, m = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    gram_top = np.linalg.norm(a.T @ a / n, 2) / 4
    w = np.zeros(m + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - g / gram_top
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - strength / gram_top, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < 1e-6
        w, t = new, t_new
        if done:
            break
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, strength: float = 5e-4) -> RuleModel:
    """Propose rules by boosting on random halves, then weigh all of them by the lasso.

    A rule that holds for fewer than 0.2 % or more than 99.8 % of the rows, or for the same rows as an earlier rule or
    the opposite ones, adds nothing to the fit and is not proposed.
    """
    start, grown = boost(x, y, trees, depth, rate=0.2, share=0.5)
    rules: dict[tuple, np.ndarray] = {}
    seen: set[bytes] = set()
    for tree in grown:
        for rule in paths(tree):
            hit = rule_hits(rule, x)
            key = np.packbits(hit.astype(bool)).tobytes()
            other = np.packbits(~hit.astype(bool)).tobytes()
            if 0.002 * len(x) <= hit.sum() <= 0.998 * len(x) and key not in seen and other not in seen:
                seen.add(key)
                rules[rule] = hit
    if not rules:
        return RuleModel(start, [])
    intercept, weights = lasso_logistic(np.stack(list(rules.values()), axis=1), y, strength)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: id, held_out, score (higher: label 1 likelier), predicted.

    Labels are learned outside the held-out fold only, from at most ``limit`` documents.  A null id is
    never held out.  Repeated ids keep a row each.
    """
    model = fit(*labelled_sample(docs, labels, id_col, text_col, limit=limit))
    stats = with_counts(docs, id_col, text_col)
    features = stats.select(F.col(id_col), *(c.alias(k) for k, c in feature_columns().items()))
    score = model.score({k: F.col(k) for k in FEATURES})
    return features.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
