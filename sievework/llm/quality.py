"""A quality classifier: a sparse ensemble of rules over statistics of the text.

Shallow trees are grown on resampled rows and random columns; every path from a root to a node is a conjunctive
rule; logistic regression with an L1 penalty keeps few rules; what is left is compiled into a Spark column, so the
corpus is scored in one pass of built-in expressions.  The model is fitted on the driver from at most ``limit``
labelled rows of statistics.

Null texts count as empty; an empty text has a score like any other.  Without labels, or with labels of one class
only, the score is that class's share (0.5 without labels).  Other columns of the input pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WORD, label_split, sample_of

#: Rows a model is fitted on at most.
FIT_ROWS = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text by name; shares are in the number of characters, words or lines."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    parts = F.split(t, r"[\x20\x09-\x0D]+")
    words = F.greatest(F.regexp_count(t, F.lit(WORD)), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    among = lambda marks: (F.length(t) - F.length(F.translate(t, marks, ""))) / chars
    return {
        "chars": F.length(t).cast("double"),
        "words": F.regexp_count(t, F.lit(WORD)).cast("double"),
        "word_length": F.length(t) / words,
        "capitals": among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": among("0123456789"),
        "symbols": among("*&%$#@^~+=<>{}[]\\/_"),
        "bars": among("|"),
        "calls": among("!?"),
        "stops": among(".,;:"),
        "distinct_words": F.size(F.array_distinct(parts)) / F.greatest(F.size(parts), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.length(t) / F.greatest(F.size(lines), F.lit(1)),
    }


@dataclass(frozen=True)
class Test:
    column: int
    above: bool
    limit: float


Rule = tuple[Test, ...]


@dataclass
class RuleModel:
    """``intercept`` and weighted rules over the named statistics."""

    names: list[str]
    intercept: float
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def column(self, stats: dict[str, Column] | None = None) -> Column:
        """The score as a column; ``stats`` maps names to columns (by default columns of these names)."""
        of = lambda t: (stats or {}).get(self.names[t.column], F.col(self.names[t.column]))
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for t in rule:
                holds = holds & (of(t) > t.limit if t.above else of(t) <= t.limit)
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * _holds(x, rule)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= x[:, t.column] > t.limit if t.above else x[:, t.column] <= t.limit
    return out


def grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int, least: int, path: Rule = ()) -> list[Rule]:
    """The rules of one tree: every path below the root.  A split is where the squared error falls most."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return [path] if path else []
    best, total = (1e-9, None), y.sum()
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, s = x[order, c], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(n[cut] >= least) & (len(y) - n[cut] >= least)]
        if len(cut):
            gain = s[cut] ** 2 / n[cut] + (total - s[cut]) ** 2 / (len(y) - n[cut]) - total**2 / len(y)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = gain[i], (int(c), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[1] is None:
        return [path] if path else []
    c, limit = best[1]
    above = x[:, c] > limit
    rules = [path] if path else []
    for side, rows in ((True, above), (False, ~above)):
        rules += grow(x[rows], y[rows], columns, depth - 1, least, (*path, Test(c, side, limit)))
    return rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the intercept is free."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ off) / n
        nw, nb = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0), vb - step * off.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return RuleModel(names, float(np.log(share / (1 - share))))
    rng, found = np.random.default_rng(seed), {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 2_000), replace=False)
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        for rule in grow(x[rows], y[rows].astype(float), columns, depth, max(5, len(rows) // 200)):
            held = _holds(x, rule)
            if 0 < held.sum() < len(y):
                found.setdefault(np.packbits(held).tobytes(), (rule, held))
    rules = [r for r, _ in found.values()]
    z = np.stack([h for _, h in found.values()], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    middle = z.mean(0)
    w, b = lasso(z - middle, y.astype(float), penalty)
    return RuleModel(names, b - float(w @ middle), [(float(v), r) for v, r in zip(w, rules) if v])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, out: int = 2, limit: int = FIT_ROWS) -> RuleModel:
    """Fit on labelled rows whose ``label_split`` into ``parts`` isn't ``out``."""
    chosen = sample_of(labels, label, label_split(F.col("doc_id"), parts) != out, limit)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(chosen, "doc_id")
    stats = statistics(F.col("text"))
    rows = texts.select("label", *[c.alias(n) for n, c in stats.items()]).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the same model whatever the order of rows
    return fit(rows[list(stats)].to_numpy(float), rows["label"].to_numpy(int), list(stats))


def score(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every row; a column of that name is replaced."""
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col(text)).items()])
    # inside the lambda the statistics have a name, so that no optimiser rule copies them into every test of a rule
    scored = F.transform(F.array(stats), lambda row: model.column({n: row[n] for n in model.names}))[0]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*kept, scored.alias(out))
