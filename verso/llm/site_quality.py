"""Quality classifier: document evidence combined with empirical Bayes posteriors of hosts and paths.

A logistic model on text features gives each document's own evidence. Hosts and paths below them
gather labels and evidence in grouped sums; sparse sites shrink toward the level above with strengths
found by the method of moments. A document's score is its own log odds plus those of its path, without
its own share, less the global ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import fold, staged

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "points", "unique_words", "echo_words", "echo_lines")
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
POINTS = np.frombuffer(b"!?.,;:", np.uint8)


def text_features(text: str | None) -> list[float]:
    """Features of a whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    echo = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        np.log1p(len(words)),
        size / n,
        counts[SYMBOLS].sum() / size,
        counts[65:91].sum() / size,
        counts[48:58].sum() / size,
        counts[POINTS].sum() / size,
        len(set(words)) / n**0.9,
        echo / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
    ]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = np.array([text_features(t) for t in pdf.pop("_text")], dtype=float).reshape(-1, len(FEATURES))
        for i, name in enumerate(FEATURES):
            pdf[name] = values[:, i]
        yield pdf


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (intercept last) by iteratively reweighted least squares."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, total: Column, n: Column, mu: float) -> float:
    """Pseudo-count of the prior: mu (1 - mu) over the variance between groups beyond chance, less one."""
    row = groups.agg(F.sum(n * (total / n - mu) ** 2), F.sum(n), F.count(F.lit(1))).first()
    if not row[2] or row[2] < 2 or not row[1]:
        return 100.0
    spread = row[0] / row[1] - mu * (1 - mu) * row[2] / row[1]
    return float(min(max(mu * (1 - mu) / spread - 1 if spread > 0 else 1e6, 1.0), 1e6))


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    label_col: str = "quality",
    sample: int = 50_000,
) -> DataFrame:
    """(id, held_out, quality_pred, score, evidence, host_posterior, path_posterior, site_rows) of every row.

    `labels` has the identifier and a 0/1 label for some rows; fold 2 of the identifier is held out of
    all learning. The logistic model is fitted on at most `sample` labelled rows, the first by a hash of
    the identifier; site sums cover all rows. The path is taken below its host. Null hosts and paths
    are groups of their own; null and empty texts have the features of an empty text; repeated labels
    of an identifier count once (the smallest); without labels every prior is one half. An empty table
    gives no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(host.cast("string"), F.lit("\u0000")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("\u0000")).alias("path"),
        F.col(text_col).alias("_text"),
    )
    schema = f"_id {kind}, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).cast("double").alias("_y"))
    table = rows.mapInPandas(_features, schema).join(known, "_id", "left")
    table = staged(table.withColumn("held_out", fold(F.col("_id")) == 2), "features")

    chosen = table.filter("_y is not null and not held_out").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    train = chosen.select("_y", *FEATURES).toPandas()
    mean, scale, w = fit_logistic(train[list(FEATURES)].to_numpy(float), train["_y"].to_numpy(float))
    z = sum(((F.col(f) - float(m)) / float(s) * float(c) for f, m, s, c in zip(FEATURES, mean, scale, w, strict=False)), F.lit(float(w[-1])))
    odds = table.withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    odds = odds.withColumn("_z", F.when(~F.col("held_out"), F.col("_y")).otherwise(F.lit(None))).withColumn("_z", F.coalesce("_z", "evidence"))
    odds = staged(odds.select("_id", "host", "path", "held_out", "evidence", "_z"), "evidence")

    paths = staged(odds.groupBy("host", "path").agg(F.sum("_z").alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n")), "hosts")
    whole = hosts.agg(F.sum("host_s"), F.sum("host_n")).first()
    mu = float(min(max(whole[0] / whole[1], 1e-6), 1 - 1e-6)) if whole[1] else 0.5
    k_host = _strength(hosts, F.col("host_s"), F.col("host_n"), mu)
    k_path = _strength(paths, F.col("s"), F.col("n"), mu)
    sites = paths.join(hosts, "host")
    placed = odds.join(sites, ["host", "path"])
    # Each row sees its host and path without its own share.
    at_host = (F.col("host_s") - F.col("_z") + k_host * mu) / (F.col("host_n") - 1 + k_host)
    at_path = (F.col("s") - F.col("_z") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    scored = placed.withColumn("host_posterior", at_host).withColumn("path_posterior", at_path)
    base = float(np.log(mu / (1 - mu)))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_posterior")) - base)))
    return scored.select(
        F.col("_id").alias(id_col),
        "held_out",
        (score >= 0.5).cast("int").alias("quality_pred"),
        F.round(score, 9).alias("score"),
        F.round("evidence", 9).alias("evidence"),
        F.round("host_posterior", 9).alias("host_posterior"),
        F.round("path_posterior", 9).alias("path_posterior"),
        F.col("n").alias("site_rows"),
    )
