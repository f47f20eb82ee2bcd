import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verso.llm import url_filter

PAGES = "page_id long, url string, html string, host string, c0 string, key string, _bits string, verdict string"
RULES = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path


def brute(urls, rules, listed):
    for url in urls:
        host, path = parts(url)
        fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        blocked = best[2] if best else any(h and (host == h or host.endswith("." + h)) for h in listed)
        yield url, host, path, best[3] if best else None, "block" if blocked else "allow"


def urls(seed=3, n=400):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))
    made = ["https://" + ".".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "?", "#x/"]) + "/".join(part() for _ in range(rng.randint(0, 3))) for _ in range(n)]
    odd = [None, "", "a.b/", "x://", "://", "h://A.B.", "h://a.b:80/a", "h://.a/", "h://u@a.b/a?://x", "HTTP://É.A/É", "h://" + "a." * 5000 + "b/" + "a/" * 5000, "h://a\nb.a/\nb"]
    return made + odd + odd


def frame(spark, found):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z", "b", "v") for i, u in enumerate(found)], PAGES).repartition(3)


def some_rules(seed=5, n=30):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    return [(".".join(part() for _ in range(rng.randint(1, 3))), "/" + rng.choice(["", "a", "ab/", "b/a"]), rng.choice(["allow", "block"])) for _ in range(n)]


def result(df):
    return Counter((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect())


def test_verdicts_equal_brute_force(spark):
    rules = some_rules() + [("a.b", "", "allow"), ("É.a", "/É", "block")]
    listed = ["aa", "b.a", "bb.b"]
    odd = [(None, "/", "block"), ("", "/", "block"), ("a", "b", "block"), ("b", None, "block"), ("ab", "/", "maybe"), rules[0]]
    df = frame(spark, urls())
    got = url_filter.judged(df, spark.createDataFrame(rules + odd, RULES), spark.createDataFrame([(h,) for h in [*listed, None, "", "aa"]], "host string"))
    assert got.columns == ["page_id", "url", "html", "c0", "key", "_bits", "host", "path", "rule", "verdict"]
    want = [(h.replace("É", "É"), p, v) for h, p, v in rules] + [("b", "", "block")]
    found = result(got)
    assert found == Counter(brute(urls(), want, listed))
    assert len({r[3:] for r in found}) > 8


def test_empty_lists_and_tables(spark):
    none, no_hosts = spark.createDataFrame([], RULES), spark.createDataFrame([], "host string")
    assert result(url_filter.judged(frame(spark, urls()), none, no_hosts)) == Counter(brute(urls(), [], []))
    assert url_filter.judged(frame(spark, []), spark.createDataFrame(some_rules(), RULES), no_hosts).count() == 0


@pytest.mark.parametrize(("load", "most"), [(12, 1 << 22), (4, 128)])
def test_cascade_is_exact(spark, monkeypatch, load, most):
    """Crowded words force many levels, a small bound forces several cascades."""
    monkeypatch.setattr(url_filter, "LOAD", load)
    monkeypatch.setattr(url_filter, "MOST_WORDS", most)
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    keys = universe.filter(F.crc32(F.col("key").cast("binary")) % 40 == 0).union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    held = url_filter.cascades(keys, universe.union(universe.limit(50)))
    assert max(len(c.sizes) for c in held) > 1 if load > 4 else len(held) > 1
    listed = {r["key"] for r in keys.collect()}
    found = set()
    for c in held:
        found |= {r["key"] for r in c.attached(universe).filter(c.holds(F.col("key"))).select("key").collect()}
    assert found == listed - {"elsewhere", None}


def test_no_join_shuffle_or_python(spark):
    df = frame(spark, urls())
    out = url_filter.judged(df, spark.createDataFrame(some_rules(), RULES), spark.createDataFrame([("aa",)], "host string"))
    main = out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert not any(x in main for x in ("Join", "Python", "Arrow", "hashpartitioning"))


def test_suspect_hosts(spark):
    got = url_filter.suspect_hosts(frame(spark, ["h://x.ADS-a.b/", "h://ads.b", "h://adsx.b/ads", None]), ("ads",)).collect()
    assert sorted(r["host"] for r in got) == ["ads.b", "x.ads-a.b"]
