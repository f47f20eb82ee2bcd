"""URL verdicts from lists of hosts and paths, held in a cascade of Bloom filters.

The keys of a url are every suffix of its host at a dot, each with every start of its path that has the length
of some listed path. The first level of the cascade encodes the listed keys; the keys of the whole corpus that
it lets through by mistake are the second level, the listed keys that the second lets through the third, and so on
until a level makes no mistake. The first level that turns a key away then says exactly whether it is listed. The
levels reach the tasks as a scalar subquery, so urls are judged where they lie, without a join or a shuffle.

A level is an array of 64-bit words in blocks. A key sets up to `BITS` bits of one word for each of its probes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import staged, without

OUTPUT = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits that a key sets in a word, keys that come to a word on average, words of a block.
BITS, LOAD, BLOCK = 5, 4, 1024
#: Words of a level at most (32 MB), which bounds what is sent to a task; longer lists are held in several cascades.
MOST_WORDS = 1 << 22
#: Probes of the first level: some 2 in 100,000 other keys pass two of them.
PROBES = 2
#: Keys that one projection tests; their code then stays under the limit of a method.
AT_ONCE = 4

ALLOW, BLOCKED, LISTED = "a", "b", "h"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def labels(host: Column) -> Column:
    """Number of parts of a host."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


@dataclass
class Cascade:
    """A cascade for the listed keys whose group, a hash modulo `groups`, is `group`."""

    bits: DataFrame  # (level, words), one row per level
    sizes: list[tuple[int, int]]  # of each level, the number of words and probes
    groups: int
    group: int

    def attached(self, rows: DataFrame) -> DataFrame:
        """`rows` with _bits, the levels' words; one value for a task, which generated code doesn't copy into rows."""
        levels = self.bits.agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "words"))), lambda x: x["words"]))
        return rows.withColumn("_bits", levels.scalar())

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed, exactly; for rows with _bits."""
        answer = F.lit(len(self.sizes) % 2 == 1)
        for i in reversed(range(len(self.sizes))):
            answer = F.when(_passes(F.get("_bits", F.lit(i)), key, i, *self.sizes[i]), answer).otherwise(F.lit(i % 2 == 1))
        return answer if self.groups == 1 else F.when(_group(key, self.groups) == self.group, answer).otherwise(F.lit(False))


def _group(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups))


def _place(key: Column, level: int, probe: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(words))


def _mask(key: Column, level: int, probe: int) -> Column:
    """The bits that a key sets in its word."""
    h = F.xxhash64(F.lit(level), key, F.lit(probe))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def _passes(level_words: Column, key: Column, level: int, words: int, probes: int) -> Column:
    found = F.lit(True)
    for probe in range(probes):
        at, mask = _place(key, level, probe, words), _mask(key, level, probe)
        word = F.get(F.get(level_words, F.floor(at / BLOCK).cast("int")), (at % BLOCK).cast("int"))
        found = found & (word.bitwiseAND(mask) == mask)
    return found


def _level(keys: DataFrame, level: int, words: int, probes: int) -> DataFrame:
    """One row (level, words): the words of all `keys`, in blocks."""
    marks = [F.struct(_place(F.col("key"), level, i, words).alias("at"), _mask(F.col("key"), level, i).alias("word")) for i in range(probes)]
    marked = keys.select(F.inline(F.array(*marks)))
    blank = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    flat = marked.union(blank).groupBy("at").agg(F.bit_or("word").alias("word"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("at", x))), lambda s: s[x]).alias("words")
    blocks = flat.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(ordered("word"))
    return blocks.withColumnRenamed("block", "at").agg(ordered("words")).select(F.lit(level).alias("level"), "words")


def _words(n: int, probes: int) -> int:
    return max(1, -(-n * probes // LOAD))


def cascades(keys: DataFrame, universe: DataFrame) -> list[Cascade]:
    """Cascades that hold the column key of `keys` exactly for every key in `universe` (both may repeat keys).

    Whatever the lists' length, a level has at most `MOST_WORDS` words: longer lists are dealt over several
    cascades, and a first level that lets too many other keys through is made again with another probe.
    """
    keys = staged(keys.filter("key is not null").distinct(), "listed")
    groups = max(1, -(-_words(keys.count(), PROBES) // (MOST_WORDS // 2)))
    return [_cascade(keys.filter(_group(F.col("key"), groups) == g), universe, groups, g) for g in range(groups)]


def _cascade(keys: DataFrame, universe: DataFrame, groups: int, group: int) -> Cascade:
    n, probes = keys.count(), PROBES
    own = universe.filter("key is not null").filter(_group(F.col("key"), groups) == group) if groups > 1 else universe.filter("key is not null")
    while True:
        first = (_words(n, probes), probes)
        found = Cascade(staged(_level(keys, 0, *first), "level"), [first], groups, group)
        passed = found.attached(own).filter(found.holds(F.col("key"))).select("key", F.lit(False).alias("own"))
        marked = passed.union(keys.select("key", F.lit(True))).groupBy("key").agg(F.bool_or("own").alias("own"))
        others = staged(marked.filter("not own").select("key"), "passed")
        n_others = others.count()
        if _words(n_others, 1) <= MOST_WORDS:
            break
        probes += 1
    # From here on both sides are known: each level encodes what the one before let through by mistake.
    inside, outside, left = others, keys, n_others
    while left:
        level, size = len(found.sizes), (_words(left, 1), 1)
        found = Cascade(found.bits.union(staged(_level(inside, level, *size), "level")), [*found.sizes, size], groups, group)
        passed = found.attached(outside).filter(_passes(F.get("_bits", F.lit(level)), F.col("key"), level, *size))
        inside, outside = staged(passed.select("key"), "passed"), inside
        left = inside.count()
    return found


def _key(tag: str, host: Column, path: Column | str = "") -> Column:
    return F.concat(F.lit(tag), host, F.lit(path) if isinstance(path, str) else path)


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (parts of the host, length of the path) of the rules."""
    found = rules.select(labels(F.col("host")).alias("k"), F.length("path").alias("n")).distinct().collect()
    return sorted((r["k"], r["n"]) for r in found)


def judged(df: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to every row.

    `rules` has host, path and verdict, `listed` has host. A rule fits its host and all subdomains if the url's
    path starts with the rule's; of several the longest wins (then that with the longer host; a rule listed as allow
    and as block blocks). Without a rule a url is blocked if its host or a domain above it is in `listed`.

    A null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Rules and
    listed hosts that are null or empty fit nothing, nor do rules with another verdict; repeated ones count once.
    Empty lists allow everything; an empty table gives an empty result. Columns of `df` named like an
    output column are replaced, all other names are of no effect.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.filter("host <> '' and verdict in ('allow', 'block') and (path = '' or path like '/%')")
    hosts = listed.select(F.translate("host", UPPER, LOWER).alias("host")).filter("host <> ''")
    tag = F.when(F.col("verdict") == "allow", F.lit(ALLOW)).otherwise(F.lit(BLOCKED))
    keys = rules.select(F.concat(tag, F.col("host"), F.col("path")).alias("key")).union(hosts.select(_key(LISTED, F.col("host")).alias("key")))
    shapes = _shapes(rules)
    depths = sorted(r["k"] for r in hosts.select(labels(F.col("host")).alias("k")).distinct().collect())

    def part(tag: str, host: Column, path: Column, k: int, n: int = 0) -> Column:
        """A key of the url, null where its host or path is too short for one."""
        key = _key(tag, F.substring_index(host, ".", -k), F.left(path, F.lit(n)) if n else "")
        return F.when((labels(host) >= k) & (F.length(path) >= n), key)

    names = [f"c{i}" for i in range(len(df.columns))]
    host, path = split_url(F.col(names[df.columns.index(url_col)]))
    rows = df.toDF(*names).withColumns({"host": host, "path": path})
    h, p = F.col("host"), F.col("path")
    all_parts = [part(t, h, p, k, n) for k, n in shapes for t in (ALLOW, BLOCKED)] + [part(LISTED, h, p, k) for k in depths]
    universe = rows.select(F.explode(F.array(*all_parts)).alias("key")) if all_parts else keys
    rows = rows.withColumns({"_best": F.lit(None).cast("struct<n:int,h:int,block:boolean,rule:string>"), "_listed": F.lit(False)})
    held = cascades(keys, universe)
    for i, cascade in enumerate(held):
        rows = cascade.attached(rows)
        for at in range(0, len(shapes), AT_ONCE):
            fits = []
            for k, n in shapes[at : at + AT_ONCE]:
                for t in (ALLOW, BLOCKED):
                    key = part(t, h, p, k, n)
                    rule = F.substring(key, 2, 1 << 30)
                    size = F.length(F.substring_index(h, ".", -k))
                    found = F.struct((size + n).alias("n"), size.alias("h"), F.lit(t == BLOCKED).alias("block"), rule.alias("rule"))
                    fits.append(F.when(key.isNotNull() & cascade.holds(key), found))
            rows = rows.withColumn("_best", F.greatest("_best", *fits))
        for at in range(0, len(depths), AT_ONCE):
            hits = F.col("_listed")
            for k in depths[at : at + AT_ONCE]:
                key = part(LISTED, h, p, k)
                hits = hits | F.coalesce(key.isNotNull() & cascade.holds(key), F.lit(False))
            rows = rows.withColumn("_listed", hits)
        rows = rows.drop("_bits")
        if i + 1 < len(held):
            rows = staged(rows, "judged")  # the next cascade takes the place of this one in the tasks
    block = F.coalesce(F.col("_best.block"), F.col("_listed"))
    kept = without(df, *OUTPUT).columns
    return rows.select(
        *(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c in kept),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.when(block, "block").otherwise("allow").alias("verdict"),
    )


def suspect_hosts(df: DataFrame, words: tuple[str, ...], url_col: str = "url") -> DataFrame:
    """(host) of the urls' hosts that have a listed word between dots and hyphens; A-Z count as a-z."""
    host, _ = split_url(df[url_col])
    return df.select(host.alias("host")).filter(F.arrays_overlap(F.split("host", "[.-]"), F.lit(list(words)))).distinct()
