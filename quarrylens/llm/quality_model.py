"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees are grown over whole-text statistics; every path from a root to a node below it
becomes a conjunctive rule; an L1-penalised logistic regression picks few of the rules and weighs them;
the chosen ones are compiled to one Spark column expression, so scoring is a projection over measured
texts.  Statistics are ratios of ``textstats.MEASURES``; label, language, source and id are no inputs.

Learning reads at most ``MAX_TRAIN_ROWS`` labelled rows (those with the smallest hash of their id, a
documented bound that does not grow with the input); measuring and scoring cover every row.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other; without any
usable label the model is unfitted and scores 0.5; with labels of one class only it scores that class's
smoothed share; labels null or other than 0 and 1 are not learned from; several labels of one id are all
learned from; repeated rows are scored one by one; only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id
from .textstats import with_stats

MAX_TRAIN_ROWS = 12_000
THRESHOLD = 0.7

#: Statistic: SQL over the measures (``w``: words, at least 1; ``l``: lines, at least 1).
STATISTICS = {
    "symbol_rate": "n_symbols / w",
    "symbol_word_rate": "n_symbol_words / w",
    "bare_symbol_rate": "n_bare_symbol_words / w",
    "bang_rate": "n_bang_words / w",
    "upper_rate": "n_upper_words / w",
    "adjacent_rate": "n_adjacent_repeats / w",
    "repeat_rate": "n_repeat_words / w",
    "distinct_rate": "n_distinct_words / w",
    "word_chars": "word_chars / w",
    "digit_rate": "n_digit_words / w",
    "long_rate": "n_long_words / w",
    "dup_line_rate": "n_dup_lines / l",
    "end_line_rate": "n_end_lines / l",
    "words_per_line": "least(w / l, 1000.0)",
}


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, "<=" or ">", bound), all of which must hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, bound in self.conditions:
            value = x[:, names.index(name)]
            out &= value <= bound if sign == "<=" else value > bound
        return out

    def column(self) -> Column:
        parts = [F.col(n) <= F.lit(b) if s == "<=" else F.col(n) > F.lit(b) for n, s, b in self.conditions]
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class RuleModel:
    intercept: float = 0.0
    weights: tuple[float, ...] = ()
    rules: tuple[Rule, ...] = ()
    fitted: bool = False
    n_train: int = field(default=0, compare=False)

    def logit_column(self) -> Column:
        terms = [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for w, r in zip(self.weights, self.rules, strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def score_column(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit_column()))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for w, r in zip(self.weights, self.rules, strict=True):
            z += w * r.holds(x, names)
        return 1 / (1 + np.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """A least-squares tree: its nodes as (conditions, rows), and its prediction for ``rows``."""
    nodes, fitted = [], np.zeros(len(x))

    def grow(own: np.ndarray, conditions: tuple, left: int) -> None:
        y = residual[own]
        fitted[own] = y.mean()
        if not left or len(own) < 2 * least:
            return
        best, total, n = (1e-9, None, None), y.sum(), len(own)
        for j, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            bins = np.searchsorted(bounds, x[own, j], side="left")  # value <= bounds[i] has bin <= i
            below_n = np.cumsum(np.bincount(bins, minlength=len(bounds) + 1))[:-1]
            below_y = np.cumsum(np.bincount(bins, y, len(bounds) + 1))[:-1]
            ok = (below_n >= least) & (n - below_n >= least)
            if ok.any():
                gain = np.where(ok, below_y**2 / np.maximum(below_n, 1) + (total - below_y) ** 2 / np.maximum(n - below_n, 1), -np.inf)
                i = int(gain.argmax())
                if gain[i] - total**2 / n > best[0]:
                    best = (gain[i] - total**2 / n, j, float(bounds[i]))
        if best[1] is None:
            return
        _, j, bound = best
        for sign, part in (("<=", own[x[own, j] <= bound]), (">", own[x[own, j] > bound])):
            nodes.append((*conditions, (j, sign, bound)))
            grow(part, nodes[-1], left - 1)

    grow(rows, (), depth)
    return nodes, fitted


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], n_trees: int = 24, depth: int = 3, rate: float = 0.2, seed: int = 7) -> list[Rule]:
    """Boost trees on half samples of the rows and a random part of the statistics, and take the paths to all their nodes as rules."""
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        mids = (values[1:] + values[:-1]) / 2
        cuts.append(mids if len(mids) <= 64 else np.unique(np.quantile(mids, np.linspace(0, 1, 64))))
    z = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(n_trees):
        rows = np.sort(rng.choice(len(x), max(2, len(x) // 2), replace=False))
        some = set(rng.choice(len(names), max(2, len(names) // 2), replace=False).tolist())
        own_cuts = [c if j in some else c[:0] for j, c in enumerate(cuts)]
        residual = y - 1 / (1 + np.exp(-z))
        nodes, _ = _tree(x, own_cuts, residual, rows, depth, max(3, len(x) // 500))
        for node in nodes:
            rules[Rule(tuple((names[j], s, b) for j, s, b in node))] = None
        # the step uses every row's leaf mean
        for node in nodes:
            inside = Rule(tuple((names[j], s, b) for j, s, b in node)).holds(x, names)
            if inside.any() and not any(len(o) > len(node) and o[: len(node)] == node for o in nodes):
                z[inside] += rate * 4 * residual[inside].mean()
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss and ``penalty`` times the L1 norm; the intercept is free."""
    n, p = a.shape
    scale = np.linalg.norm(a, 2) ** 2 / n / 4 + 0.25
    w, b, v, c, t = np.zeros(p), 0.0, np.zeros(p), 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ v + c))) - y
        w_new = v - a.T @ g / n / scale
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - penalty / scale, 0)
        b_new = c - g.mean() / scale
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        done = np.abs(w_new - w).max(initial=0) + abs(b_new - b) < 1e-7
        w, b, t = w_new, b_new, t_new
        if done:
            break
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 5e-3) -> RuleModel:
    """Fit on statistics ``x`` (rows by names) and labels ``y`` (0 or 1)."""
    if not len(y):
        return RuleModel()
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))), fitted=True, n_train=len(y))
    order = np.lexsort([*x.T, y])  # the same model whatever the order of rows
    x, y = x[order], y[order].astype(float)
    found: dict[bytes, Rule] = {}
    for rule in grow_rules(x, y, names):
        inside = rule.holds(x, names)
        if 0 < inside.sum() < len(y):
            key = min(inside.tobytes(), (~inside).tobytes())
            if key not in found or len(rule.conditions) < len(found[key].conditions):
                found[key] = rule
    rules = list(found.values())
    a = np.stack([r.holds(x, names) for r in rules], 1).astype(float)
    centre, spread = a.mean(0), a.std(0)
    b, w = lasso_logistic((a - centre) / spread, y, penalty)
    w = w / spread
    b -= float(w @ centre)
    chosen = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b), tuple(w[chosen].tolist()), tuple(rules[i] for i in chosen), True, len(y))


def statistics(docs: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns and ``STATISTICS`` as doubles."""
    found = with_stats(docs, text_col, key_cols).withColumns({"w": F.greatest("n_words", F.lit(1)), "l": F.greatest("n_lines", F.lit(1))})
    return found.select(*key_cols, *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(F.col(id_col)) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Learn from at most ``max_rows`` labelled rows, none of which is held out."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = (
        usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(max_rows)
    )
    # the chosen ids are bounded by max_rows, whatever the input
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = statistics(own, "__text", ("__id", "__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows)
    names = list(STATISTICS)
    found = rows.select("__label", *names).toPandas()
    return fit(found[names].to_numpy(float), found["__label"].to_numpy(), names)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row."""
    found = statistics(docs, text_col, (id_col,)).withColumn("score", model.score_column())
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that the model does not reject; an unfitted model rejects none."""
    if not model.fitted:
        return docs
    columns = docs.columns
    positions = [F.col(f"c{i}") for i in range(len(columns))]
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = f"c{columns.index(text_col)}"
    measured = statistics(plain, at, tuple(p for p in plain.columns))
    kept = measured.where(model.score_column() >= threshold)
    return kept.select(*[p.alias(c) for p, c in zip(positions, columns, strict=True)])
