"""Document quality by hierarchical empirical Bayes.

A document classifier (logistic regression on measures of the text) gives each document evidence, a
log-odds. Its site adds to that: grouped aggregation over all documents sums the known labels and,
where there is none, the classifier's probabilities, per host and per path of a host. A host's rate
is shrunk toward the global rate, a path's toward its host's, by strengths that empirical Bayes
takes from how much the rates differ beyond chance: sparse sites stay near their prior, large ones
speak for themselves. A document's own share is taken out of its site first. Then

    log-odds = evidence + log-odds(path rate without the document) - log-odds(global rate).

All measures are built-in functions. They are worked out once and written to the shared folder,
without the texts. Hosts and paths are summed map-side before the shuffle, so a hot host is no hot
task.

Defined cases: a null text counts as empty; a null host or path is a site of its own; documents
without a label take part with their probability; several labels of one document count by their
mean; with labels of one kind only, or none, evidence is the constant log-odds of the smoothed
rate; repeated rows give repeated rows; an empty table gives an empty result. Other columns of
the documents may have any name.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.shared import named, written

#: Labelled documents that the classifier is fitted on, at most (nearly): a sample by hash, in which
#: documents with equal measures are one row with a weight.
FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
MEASURES = ("symbols", "marks", "capitals", "digits", "blanks", "repeated", "word_size", "n_words", "lines")


def measures(text: Column) -> dict[str, Column]:
    """Shares and sizes of a text that tell running text from junk."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))

    def share(signs: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, signs, ""))) / size

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "symbols": share(SYMBOLS),
        "marks": share("!?,.;:"),
        "capitals": share(string.ascii_uppercase),
        "digits": share(string.digits),
        "blanks": share(" \t\n\x0b\f\r"),
        "repeated": 1 - F.size(F.array_distinct(words)) / n,
        "word_size": F.least(size / n, F.lit(30.0)) / 10,
        "n_words": F.log1p(F.size(words).cast("double")) / 5,
        "lines": (F.length(text) - F.length(F.translate(text, "\n", ""))) / n,
    }


@dataclass
class Classifier:
    weights: list[float]  # of MEASURES
    constant: float

    def evidence(self) -> Column:
        total = F.lit(self.constant)
        for name, weight in zip(MEASURES, self.weights, strict=True):
            total = total + F.col(f"_{name}") * weight
        return F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0))


def logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, times: np.ndarray | None = None
) -> Classifier:
    """Ridge logistic regression by Newton's method on scaled measures; a row counts `times`."""
    times = np.ones(len(y)) if times is None else times
    if len(y) == 0 or y.min() == y.max():
        rate = ((times * y).sum() + 0.5) / (times.sum() + 1)
        return Classifier([0.0] * x.shape[1], float(np.log(rate / (1 - rate))))
    mean = np.average(x, axis=0, weights=times)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=times))
    scale[scale == 0] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (times * (p - y)) + penalty * w
        curve = (a * (times * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier((w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] * mean / scale).sum()))


def measured(
    docs: DataFrame, host: Column, path: Column, text: str, keep: list[str], key: Column
) -> DataFrame:
    """Columns of this module begin with an underscore; those in `keep` must not."""
    return docs.select(
        *named(keep),
        host.alias("_host"),
        path.alias("_path"),
        key.alias("_id"),
        *(c.alias(f"_{name}") for name, c in measures(F.col(text)).items()),
    )


def fit(rows: DataFrame, label: str = "_label", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on measured rows with a label. Of more than `fit_rows`, every group of equal measures and label
    gives its part, rounded up or down by a hash: copies count for what they are, in one row."""
    known = rows.where(F.col(label).isNotNull())
    values = [F.col(f"_{m}") for m in MEASURES]
    groups = known.groupBy(*values, F.col(label).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    n = known.count()
    if n > fit_rows:
        point = F.pmod(F.xxhash64(*values, "_y"), F.lit(1 << 30)) / float(1 << 30)
        groups = groups.withColumn("_n", F.floor(F.col("_n") * (fit_rows / n) + point)).where(F.col("_n") > 0)
    part = groups.select(*values, "_y", F.col("_n").cast("double")).toPandas().to_numpy(dtype=float)
    part = part[np.lexsort(part.T)]  # sums in one order
    return logistic(part[:, :-2], part[:, -2], times=part[:, -1])


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: how many documents a group's prior is worth."""
    between = groups.where(F.col("n") > 0).agg(
        F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("variance"),
    )
    row = between.collect()[0]
    if not row["groups"] or row["groups"] < 2 or not row["variance"]:
        return 1e6
    size = row["n"] - row["nn"] / row["n"]
    excess = (row["spread"] - row["chance"]) / max(size, 1.0)
    variance = row["variance"] / row["n"]
    return float(np.clip(variance / excess - 1, 1.0, 1e6)) if excess > 0 else 1e6


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def combine(rows: DataFrame, classifier: Classifier, label: str = "_label") -> DataFrame:
    """Adds evidence, host_rate, path_rate and p_quality to measured rows; host and path are dropped."""
    scored = rows.withColumn("evidence", classifier.evidence()).drop(*(f"_{m}" for m in MEASURES))
    share = F.coalesce(F.col(label).cast("double"), 1 / (1 + F.exp(-F.col("evidence"))))
    scored = scored.withColumn("_share", share)
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_share").alias("s"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()[0]
    rate = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    host_strength = _strength(hosts, F.lit(rate))
    hosts = hosts.withColumn("rate", (F.col("s") + host_strength * rate) / (F.col("n") + host_strength))
    of_host = hosts.select(F.col("_host").alias("_of"), F.col("n").alias("_host_n"), F.col("s").alias("_host_s"), "rate")
    sites = paths.join(of_host, F.col("_host").eqNullSafe(F.col("_of"))).drop("_of")
    path_strength = _strength(sites, F.col("rate"))
    sites = sites.select(
        F.col("_host").alias("_h"), F.col("_path").alias("_p"),
        F.col("n").alias("_n"), F.col("s").alias("_s"), "_host_n", "_host_s",
    )
    joined = scored.join(
        sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))
    )
    own = F.col("_share")
    host_rate = (F.col("_host_s") - own + host_strength * rate) / (F.col("_host_n") - 1 + host_strength)
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("_s") - own + path_strength * F.col("host_rate")) / (F.col("_n") - 1 + path_strength)
    joined = joined.withColumn("path_rate", path_rate)
    odds = F.col("evidence") + _log_odds(F.col("path_rate")) - float(np.log(rate / (1 - rate)))
    return joined.withColumn("p_quality", 1 / (1 + F.exp(-odds))).drop(
        "_host", "_path", "_share", "_h", "_p", "_n", "_s", "_host_n", "_host_s", label
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    keep: list[str],
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The columns in `keep` with evidence, host_rate, path_rate, p_quality.

    labels: id_col and label (0 or 1), only those that may be learned from.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.round(F.avg(label)).cast("int").alias("_label"))
    )
    rows = measured(docs, host, path, text, keep, F.col(id_col))
    rows = written(rows.join(known, "_id", "left").drop("_id"), "quality")
    return combine(rows, fit(rows, fit_rows=fit_rows))
