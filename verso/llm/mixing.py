"""Mix sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that claim them); patterns supply
capacity, sources have quotas, and repeating a pattern's words costs more with each repetition
(convex cost). The flow is solved on the aggregated graph, whose size is the number of patterns and
not of documents. Whole documents are then selected in a seeded order until each pattern's flow is met, and a few single ones make up for what is missing.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verso.llm.common import BLANK, as_given, numbered, staged

#: The flow graph is solved on the driver; more patterns than this raise an error.
MAX_PATTERNS = 100_000


def targets(sizes: dict[str | None, int], most: float = 3.0) -> dict[str | None, float]:
    """Target of each source: weights 1, 2, 3, repeating by code point order (null last), at most `most` sizes.

    The excess over a cap is shared by weight among the others until no target is above its cap. If
    all reach their caps, as when there is nothing to share, the targets are the caps.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, found, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        left = total - sum(found.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return found | share
        found |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in found]
    return found


def flows_of(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int = 3) -> list[list[tuple[int, int]]]:
    """The min-cost flow; a source that is a pattern of its own and part of no other needs no search."""
    uses = [0] * len(quota)
    for ms in members:
        for s in ms:
            uses[s] += 1
    alone = [len(ms) == 1 and uses[ms[0]] == 1 for ms in members]
    out: list[list[tuple[int, int]]] = [[(ms[0], min(quota[ms[0]], repeats * capacity[p]))] if alone[p] else [] for p, ms in enumerate(members)]
    rest = [p for p in range(len(members)) if not alone[p]]
    open_ = sorted({s for p in rest for s in members[p]})
    number = {s: i for i, s in enumerate(open_)}
    found = min_cost_flow([capacity[p] for p in rest], [[number[s] for s in members[p]] for p in rest], [quota[s] for s in open_], repeats)
    for p, sent in zip(rest, found, strict=True):
        out[p] = [(open_[s], words) for s, words in sent]
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int = 3) -> list[list[tuple[int, int]]]:
    """Words that each pattern sends to each source: [(source, words), ...] per pattern.

    The r-th repetition of a pattern's words costs r - 1 a word; quotas are met as far as the patterns
    can. Successive shortest paths with potentials on the bipartite graph; arcs from a pattern to one
    source need no search.
    """
    flow: list[dict[int, int]] = [{} for _ in capacity]
    used = [0] * len(capacity)
    need = list(quota)
    by_source: list[list[int]] = [[] for _ in quota]
    for p, ms in enumerate(members):
        for s in ms:
            by_source[s].append(p)
    while True:
        # Distances from all sources with need, over residual arcs source -> pattern -> source.
        dist, back, heap = {}, {}, []
        for s in range(len(quota)):
            if need[s] > 0:
                dist[("s", s)] = 0
                heapq.heappush(heap, (0, 0, s))
        end = None
        best: tuple[int, int] | None = None
        while heap:
            d, kind, x = heapq.heappop(heap)
            if best is not None and d >= best[0]:
                break
            if kind == 0:
                if d > dist.get(("s", x), d):
                    continue
                for p in by_source[x]:
                    if d < dist.get(("p", p), 1 << 60):
                        dist[("p", p)], back[("p", p)] = d, x
                        heapq.heappush(heap, (d, 1, p))
                continue
            if d > dist.get(("p", x), d):
                continue
            if used[x] < repeats * capacity[x]:
                cost = d + used[x] // max(1, capacity[x])
                if best is None or cost < best[0]:
                    best, end = (cost, x), x
            for s, words in flow[x].items():
                if words > 0 and d < dist.get(("s", s), 1 << 60):
                    dist[("s", s)], back[("s", s)] = d, x
                    heapq.heappush(heap, (d, 0, s))
        if end is None:
            return [sorted(f.items()) for f in flow]
        # Walk back to the source in need; push as much as this cost level allows.
        path, p = [], end
        while True:
            s = back[("p", p)]
            path.append((p, s))
            if ("s", s) not in back:
                break
            p = back[("s", s)]
        level = capacity[end] - used[end] % capacity[end]
        push = min(need[path[-1][1]], level, *(flow[path[i + 1][0]][path[i][1]] for i in range(len(path) - 1)))
        for i, (p, s) in enumerate(path):
            flow[p][s] = flow[p].get(s, 0) + push
            if i + 1 < len(path):
                flow[path[i + 1][0]][s] -= push
        used[end] += push
        need[path[-1][1]] -= push


def _plan(spark: SparkSession, table: DataFrame, most: int) -> DataFrame:
    """(pattern, source, source_size, target, flow) from the sizes of the patterns."""
    rows = table.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group small sources before mixing")
    sizes: dict[str | None, int] = {}
    for r in rows:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    names = list(sizes)
    number = {s: i for i, s in enumerate(names)}
    wanted = targets(sizes, float(most))
    # Overlapping members count in each of their sources; quotas then share all words once.
    goal = [int(round(wanted[s])) for s in names]
    flows = flows_of([r["size"] for r in rows], [[number[s] for s in r["members"]] for r in rows], goal, most)
    out = []
    for r, sent in zip(rows, flows, strict=True):
        words = sum(w for _, w in sent)
        first = sorted(r["members"], key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
        name = first[0] if first else None
        out.append((r["pattern"], sizes.get(name, 0), float(wanted.get(name, 0.0)), words, r["size"]))
    return spark.createDataFrame(out, "pattern string, source_size long, target double, flow long, pattern_size long")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 11,
    most: int = 3,
    bins: int = 4096,
    top_ups: int = 3,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies, row_key) for every row of `df`.

    `source_col` is a string or an array of strings, the sources that claim the document; null is a
    source of its own, an empty array no source. A document is taken `copies` times as a whole, at
    most `most` times; taken = copies * size. Documents of size 0 are taken as often as their place
    in the order says and change nothing. Null texts have size 0. The order is a seeded hash of
    identifier and text, so reruns agree; repeated rows stand side by side in it. An empty table
    gives an empty result. source_size and target are those of the first of a document's sources.
    """
    spark = df.sparkSession
    array = df.schema[source_col].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.col(source_col))) if array else F.array(F.col(source_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("long").alias("size"),
        members.alias("members"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("row_key"),
    )
    rows = rows.withColumn("pattern", F.to_json(F.struct(F.transform("members", lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))))))
    table = staged(rows, "sizes")
    plan = _plan(spark, table, most)  # at most MAX_PATTERNS rows
    # Seeded order: first by bin of the hash, then, in the one bin where the flow ends, by hash.
    keyed = table.withColumn("bin", F.pmod(F.shiftrightunsigned("row_key", 20), F.lit(bins)).cast("int"))
    per_bin = keyed.groupBy("pattern", "bin").agg(F.sum("size").alias("bin_size")).join(F.broadcast(plan), "pattern")
    rest = F.col("flow") - F.col("pattern_size") * F.floor(F.col("flow") / F.greatest("pattern_size", F.lit(1)))
    before = F.sum("bin_size").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("bin_size")
    per_bin = per_bin.select(
        "pattern",
        "bin",
        "source_size",
        "target",
        F.floor(F.col("flow") / F.greatest("pattern_size", F.lit(1))).alias("full"),
        (rest - before).alias("left"),
        (rest - before - F.col("bin_size")).alias("after"),
    )
    edge = (F.col("left") > 0) & (F.col("after") < 0)
    placed = keyed.join(staged(per_bin, "bins"), ["pattern", "bin"])
    w = Window.partitionBy("pattern", "bin").orderBy("row_key", "_id", "size")
    inside = placed.filter(edge).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("extra", F.when(F.col("upto") <= F.col("left"), 1).otherwise(0)).drop("upto")
    others = placed.filter(~edge).withColumn("extra", F.when(F.col("after") >= 0, 1).otherwise(0))
    chosen = staged(others.unionByName(inside).drop("left", "after", "bin", "members"), "chosen")
    # What is still missing is made up by single documents, the largest that fit and last the closest.
    for turn in range(top_ups):
        missing = chosen.groupBy("pattern").agg(F.sum(F.col("extra") * F.col("size")).alias("sum")).join(F.broadcast(plan), "pattern")
        missing = missing.select("pattern", (rest - F.col("sum")).alias("missing"))
        gap = F.abs(F.col("missing") - F.col("size"))
        spare = chosen.filter((F.col("extra") == 0) & (F.col("full") < most)).join(F.broadcast(missing), "pattern").filter(gap < F.col("missing"))
        if turn < top_ups - 1:
            spare = spare.filter(F.col("size") <= F.col("missing"))
        last = spare.groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "row_key")).alias("best"))
        last = last.select("pattern", F.col("best.row_key").alias("last_key"))
        done = chosen.join(F.broadcast(last), "pattern", "left")  # as many rows as patterns
        hit = F.coalesce(F.col("row_key") == F.col("last_key"), F.lit(False))
        twin = F.row_number().over(Window.partitionBy("row_key").orderBy("extra", "_id"))
        topped = done.filter(hit).withColumn("extra", F.when(twin == 1, 1).otherwise(F.col("extra")))
        chosen = staged(done.filter(~hit).unionByName(topped).drop("last_key"), f"chosen-{turn}")
    copies = F.least(F.col("full") + F.col("extra"), F.lit(most)).cast("long")
    return chosen.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "row_key"
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """The rows of `df`, each as many times as the mix takes it; columns as given.

    Rows with one identifier and one text (null counting as empty) are told apart by nothing that the mix
    sees: the copies that it takes of them are dealt out evenly, and the first ones get what is left
    over. Empty texts are taken as often as their place in the order says. An empty table gives no rows.
    """
    rows, ident, text, source = numbered(df, id_col, text_col, source_col)
    taken = mix(rows, ident, text, source, seed=seed, **options)
    totals = taken.groupBy("row_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    keyed = rows.withColumn("row_key", F.xxhash64(F.lit(seed), F.col(ident), F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(totals.filter("_copies > 0"), "row_key")
    single, twins = joined.filter("_rows = 1"), joined.filter("_rows > 1")
    # Rows that are equal in every column are one row with a count, so that no key is gathered in one task.
    hashed = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]
    equal = twins.groupBy("row_key", "_copies", "_rows", F.xxhash64(*hashed).alias("_same"))
    equal = equal.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rows.columns)).alias("_row"))
    upto = F.sum("_n").over(Window.partitionBy("row_key").orderBy("_same"))
    least, over = F.floor(F.col("_copies") / F.col("_rows")), F.col("_copies") % F.col("_rows")
    more = F.greatest(F.least(upto, over) - F.least(upto - F.col("_n"), over), F.lit(0))
    dealt = equal.select("_row.*", (least * F.col("_n") + more).alias("_times"))
    every = single.withColumn("_times", F.col("_copies")).select(*rows.columns, "_times").unionByName(dealt)
    return as_given(every.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))), df)
