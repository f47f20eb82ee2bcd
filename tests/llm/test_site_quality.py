import random
import zlib
from collections import defaultdict

import numpy as np

from tests.llm.fixtures import empty, rows, table
from verso.llm.site_quality import classify, text_features


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["quality_pred"] == r["quality"] for r in held) / len(held) > 0.95


def test_sparse_sites_shrink(spark):
    good = "plain words that read like any other sentence of the corpus and go on for a while"
    data = [(i, good, "en", "big", 1) for i in range(80)] + [(i, good, "en", "bad", 1) for i in range(100, 140)] + [(200, good, "en", "tiny", 1)]
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(i, 0) for i in range(100, 140)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in classify(table(spark, data), labels).collect()}
    assert out[0]["path_posterior"] > out[200]["path_posterior"] > out[100]["path_posterior"]


def strength(groups, mu):
    n = np.array([len(g) for g in groups], float)
    mean = np.array([np.mean(g) for g in groups])
    spread = (n * (mean - mu) ** 2).sum() / n.sum() - mu * (1 - mu) * len(groups) / n.sum()
    return min(max(mu * (1 - mu) / spread - 1 if spread > 0 else 1e6, 1.0), 1e6)


def test_against_brute_force(spark):
    """Logistic evidence by gradient steps and posteriors by loops over the documents of a site."""
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 60)))
    poor = lambda: " ".join(rng.choice(["#$%", "AAA", "buy", "!!"]) for _ in range(rng.randrange(5, 60)))
    data, truth = [], {}
    for i in range(200):
        host = rng.choice(["h1", "h2", "h3", None])
        bad = rng.random() < {"h1": 0.1, "h2": 0.8, "h3": 0.4, None: 0.5}[host]
        data.append((i, None if i % 50 == 7 else poor() if bad else good(), rng.choice(["en", "de", None]), host, 1))
        if i % 3:
            truth[i] = int(not bad)
    twice = [(i, y) for i, y in truth.items()] + [(10, 1), (10, 0), (None, 1), (11, None)]
    truth[10] = 0
    labels = spark.createDataFrame(twice, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in classify(table(spark, data), labels).collect()}
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    learned = [i for i in truth if i not in held]
    x = np.array([text_features(r[1]) for r in data])
    mean, scale = x[learned].mean(0), x[learned].std(0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, y = np.zeros(z.shape[1]), np.array([truth[i] for i in learned], float)
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-z[learned] @ w))
        w += 0.01 * (z[learned].T @ (y - p) - w)
    evidence = 1 / (1 + np.exp(-z @ w))
    share = np.array([truth[i] if i in truth and i not in held else evidence[i] for i in range(200)])
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, lang, host, _ in data:
        hosts[host].append(i), paths[host, lang].append(i)
    mu = share.mean()
    k_host, k_path = (strength([share[g] for g in x.values()], mu) for x in (hosts, paths))
    logit = lambda v: np.log(v / (1 - v))
    for i, _, lang, host, _ in data:
        at_host = (sum(share[j] for j in hosts[host] if j != i) + k_host * mu) / (len(hosts[host]) - 1 + k_host)
        at_path = (sum(share[j] for j in paths[host, lang] if j != i) + k_path * at_host) / (len(paths[host, lang]) - 1 + k_path)
        score = 1 / (1 + np.exp(-(logit(evidence[i]) + logit(at_path) - logit(mu))))
        r = out[i]
        assert np.allclose([r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]], [evidence[i], at_host, at_path, score], atol=2e-4)
        assert r["site_rows"] == len(paths[host, lang]) and r["held_out"] == (i in held) and r["quality_pred"] == int(r["score"] >= 0.5)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classify(table(spark), none).count() == len(rows())
    twice = spark.createDataFrame([(3, 1), (3, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert classify(table(spark), twice).count() == len(rows())
    assert classify(empty(spark), twice).count() == 0
