from pyspark.sql import functions as F

from verso.functions.text import DOT_GROUPS
from verso.operators import layout, ledger, lexicon, splits

WORD = "page long, line int, pos int, text string, conf double, x0 int, y0 int, x1 int, y1 int"


def word(page, line, pos, text, x0, x1, y0=0, y1=10, conf=90.0):
    return (page, line, pos, text, conf, x0, y0, x1, y1)


def test_number_cells_are_ordered_right_to_left(spark):
    rows = [word(1, 0, 0, "13", 100, 120), word(1, 0, 1, "23", 200, 220), word(1, 0, 2, "9", 60, 70), word(1, 0, 3, "x", 20, 50)]
    out = layout.segments(spark.createDataFrame(rows, WORD), ["page", "line"], F.lit(True)).orderBy("piece_order", "pos").collect()
    assert [r["text"] for r in out] == ["23", "13", "9", "x"]


def test_a_gap_is_a_column_only_beside_another(spark):
    rows = [word(1, 0, 0, "a", 0, 10), word(1, 0, 1, "b", 50, 60), word(1, 1, 0, "c", 0, 10, 20, 30), word(1, 1, 1, "d", 50, 60, 20, 30), word(1, 2, 0, "e", 0, 10, 40, 50), word(1, 2, 1, "f", 90, 99, 40, 50)]
    cuts = {(r["line"], r["pos"]) for r in layout.table_cuts(spark.createDataFrame(rows, WORD), "page").collect()}
    assert cuts == {(0, 1), (1, 1)}


def test_lone_edge_marks_go(spark):
    rows = [word(1, 0, 0, "5", 0, 5), word(1, 0, 1, "word", 40, 60), word(1, 0, 2, "a", 63, 66), word(2, 0, 0, "x", 0, 5), word(2, 0, 1, "y", 50, 55)]
    out = layout.trim_edges(spark.createDataFrame(rows, WORD), ["page", "line"], F.length("text")).orderBy("page", "pos").collect()
    assert [r["text"] for r in out] == ["word", "a", "y"]


def test_clean_halves_beat_a_merged_reading(spark):
    rows = [(1, "whole", 10.0, 0, 0, 100, 10), (1, "left", 7.0, 0, 0, 45, 10), (1, "right", 6.0, 55, 0, 100, 10), (1, "below", 1.0, 0, 30, 90, 40)]
    df = spark.createDataFrame(rows, "page long, cand string, score double, x0 int, y0 int, x1 int, y1 int")
    out = [(r["cand"], r["row"]) for r in layout.select_readings(df, "page").collect()]
    assert out == [("right", 0), ("left", 0), ("below", 1)]


def test_paragraphs_and_text(spark):
    rows = [(1, i, f"l{i}", y, y + 10) for i, y in enumerate([0, 12, 24, 60, 72])]
    lines = layout.paragraphs(spark.createDataFrame(rows, "page long, line int, text string, y0 int, y1 int"), "page")
    assert [r["text"] for r in layout.page_text(lines, "page").collect()] == ["l0\nl1\nl2\n\nl3\nl4"]


def test_overlap_pairs_once(spark):
    rows = [(1, i, 0, i * 50, 100, i * 50 + 70) for i in range(6)]
    df = spark.createDataFrame(rows, "page long, id int, x0 int, y0 int, x1 int, y1 int")
    out = layout.box_overlap(df, df, "page", band=16).filter("a_id < b_id").collect()
    assert sorted((r["a_id"], r["b_id"]) for r in out) == [(i, i + 1) for i in range(5)]


def test_runs_and_loops(spark):
    df = spark.createDataFrame([(1, "aabbbcc"), (2, ""), (3, None), (4, "ééx")], "id int, t string")
    assert {r["id"]: (r["char"], r["run"]) for r in layout.longest_run(df, "id", "t").collect()} == {1: ("b", 3), 2: ("", 0), 3: ("", 0), 4: ("é", 2)}
    assert layout.loop_length("start " + "abc" * 30) == 90 and layout.loop_length("no loop here") == 0


def test_spelling_repairs(spark):
    lex = spark.createDataFrame([(w,) for w in "صبحگاهی نماز بسیاری استخراج اداره داره بهار".split()], "word string")
    words = spark.createDataFrame([(w,) for w in ["صبخگاهی", "بمار", "بسپیاری", "اس‌تخراج", "آداره", "نماز", "ab1"]], "word string")
    out = {r["word"]: (r["fixed"], r["rule"]) for r in lexicon.repair(words, lex, DOT_GROUPS).collect()}
    assert out["صبخگاهی"] == ("صبحگاهی", "moved") and out["بمار"] == ("بمار", "kept") and out["بسپیاری"] == ("بسیاری", "single")
    assert out["اس‌تخراج"] == ("استخراج", "closed") and out["آداره"] == ("اداره", "moved") and out["نماز"] == ("نماز", "kept") and out["ab1"] == ("ab1", "kept")


def test_one_edit_includes_transpositions(spark):
    lex = spark.createDataFrame([("house",), ("mouse",), ("horse",)], "word string")
    words = spark.createDataFrame([("huose",), ("hose",), ("houses",), ("xxxxx",), ("house",)], "word string")
    assert {r["word"]: r["fix"] for r in lexicon.edit_one(words, lex).collect()} == {"huose": "house", "hose": "horse", "houses": "house"}


def test_splits_do_not_leak(spark):
    groups = spark.createDataFrame([(s, f"{s}{i}", i % 3 + 1) for s in "ab" for i in range(10)] + [("c", "c0", 1)], "stratum string, unit string, n long")
    both = splits.stratified_split(groups, "stratum", "unit", "seed")
    sides = {r["stratum"]: r["k"] for r in both.groupBy("stratum").agg(F.count_distinct("split").alias("k")).collect()}
    assert sides == {"a": 2, "b": 2, "c": 1} and splits.leaks(both, "unit").count() == 0
    greedy = splits.greedy_split(groups, "stratum", "unit", "n")
    total = {r["stratum"]: r["t"] for r in greedy.filter("split = 'dev'").groupBy("stratum").agg(F.sum("n").alias("t")).collect()}
    assert total["a"] >= 11 and total["c"] == 1


def test_ledger(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.5), (4, None), (5, 3.0)], "i int, s double")
    out = ledger.best_so_far(rows, "s", "i").orderBy("i").collect()
    assert [r["is_best"] for r in out] == [True, True, False, False, True] and [r["worse_runs"] for r in out] == [0, 0, 1, 2, 0]
    assert ledger.best_row(rows, "s", "i").first()["i"] == 5
    assert [r["i"] for r in ledger.newest(rows, "i", 2, "i").collect()] == [5, 4]


def test_guarded_fixes(spark):
    words = spark.createDataFrame([(0, "haus", 50.0), (1, "häus", 50.0), (2, "häus", 85.0), (3, "hä", 10.0), (4, "häu5", 10.0), (5, "hauss", 84.9)], "i int, word string, conf double")
    lex = spark.createDataFrame([("haus",), ("ha",)], "word string")
    got = {r["i"]: (r["fixed"], r["rule"]) for r in lexicon.fix_words(words, lex, ("aä",), script="^[a-zä]+$").collect()}
    assert got == {0: ("haus", "kept"), 1: ("haus", "moved"), 2: ("häus", "kept"), 3: ("hä", "kept"), 4: ("häu5", "kept"), 5: ("haus", "single")}


def test_competing_readings(spark):
    schema = "page long, line int, pos int, text string, key string, conf double, x0 int, y0 int, x1 int, y1 int"
    row = lambda line, pos, text, conf, y=None: (1, line, pos, text, text, conf, pos * 50, 50 * line if y is None else y, pos * 50 + 40, (50 * line if y is None else y) + 40)
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    native = make(row(0, 0, "سلام", 95.0), row(0, 1, "2-", 30.0), row(0, 2, "دنیا", 90.0), row(1, 0, "xx", 20.0), row(1, 1, "دو", 20.0))
    foreign = make(row(0, 0, "qq", 40.0), row(0, 1, "Roya", 92.0), row(0, 2, "zz", 60.0), row(1, 0, "Hello", 90.0), row(1, 1, "a", 90.0), row(2, 0, "low", 50.0))
    layouts = make(row(0, 0, "۱۲", 80.0, 300))
    sparse = make(row(5, 0, "free", 50.0, 600), row(6, 0, "near", 50.0, 310), row(7, 0, "n0", 50.0, 800))
    got = sorted((r["reading"], r["line"], r["pos"], r["text"]) for r in layout.competing_readings(native, foreign, layouts, sparse, "page").collect())
    assert [g for g in got if g[0] == "mix"] == [("mix", 0, 0, "سلام"), ("mix", 0, 1, "Roya"), ("mix", 0, 2, "دنیا")]
    assert [g[1] for g in got if g[0] == "foreign"] == [0, 0, 0, 1, 1] and [g[3] for g in got if g[0] == "sparse"] == ["free"]
    assert len([g for g in got if g[0] == "native"]) == 5 and len([g for g in got if g[0] == "layout"]) == 1


def test_readings_against_a_plain_search(spark):
    """Best first, then exchanges for what each kept reading displaced, over random boxes of one page."""
    import random
    from itertools import combinations

    rng = random.Random(2)
    rows = [(1, f"c{i}", round(rng.uniform(1, 20), 3), x, y, x + rng.randrange(30, 200), y + 40) for i in range(40) for x, y in [(rng.randrange(0, 600), rng.randrange(0, 400))]]

    def over(a0, a1, b0, b1):
        return max(0, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0))

    def clash(a, b):
        return over(a[4], a[6], b[4], b[6]) > 0.4 and over(a[3], a[5], b[3], b[5]) > 0.3

    pool, kept = sorted(rows, key=lambda r: -r[2]), []
    for r in pool:
        if not any(clash(r, k) for k in kept):
            kept.append(r)
    for _ in range(3):
        before = list(kept)
        for k in before:
            rest = [o for o in kept if o is not k]
            free = [r for r in pool if r not in kept and clash(r, k) and not any(clash(r, o) for o in rest)][:8]
            sets = [s for n in range(1, len(free) + 1) for s in combinations(free, n) if not any(clash(a, b) for a, b in combinations(s, 2))] if len(free) > 1 else []
            best = max(sets, key=lambda s: sum(r[2] for r in s), default=())
            if sum(r[2] for r in best) > k[2] * 1.05:
                kept = [*rest, *best]
        if kept == before:
            break
    df = spark.createDataFrame(rows, "page long, cand string, score double, x0 int, y0 int, x1 int, y1 int")
    out = layout.select_readings(df, "page").collect()
    assert sorted(r["cand"] for r in out) == sorted(k[1] for k in kept)
    heads, number = [], {}
    for k in sorted(kept, key=lambda r: ((r[4] + r[6]) / 2, -r[5])):
        if not heads or over(k[4], k[6], heads[-1][4], heads[-1][6]) <= 0.5:
            heads.append(k)
        number[k[1]] = len(heads) - 1
    assert {r["cand"]: r["row"] for r in out} == number


def test_competing_readings_against_a_plain_search(spark):
    """Words of a line meet in one row: three joins for the sparse lines, none for the words, and what a plain search finds."""
    import random
    import re

    rng = random.Random(8)
    schema = "page long, line int, pos int, text string, key string, conf double, x0 int, y0 int, x1 int, y1 int"
    texts = ["سلام", "دنیا", "سلامدنیا", "دو", "2-", "xx", "Roya", "Roya", "a", "۱۲", "no 1", None]

    def reading(lines):
        spots = [(p, i, k, rng.randrange(120), 50 * i + rng.randrange(30)) for p in range(8) for i in lines for k in range(rng.randrange(1, 7))]
        texted = [(*s, rng.choice(texts), rng.choice([None, 20.0, 75.0, 80.0, 95.0, 95.0])) for s in spots]
        return [(p, i, k, t, t, c, x, y, x + rng.randrange(10, 60), y + 40) for p, i, k, x, y, t, c in texted]

    native, foreign, layouts, sparse = reading(range(40)), [*reading(range(40)), (None, 1, 0, "Roya", "Roya", 95.0, 0, 0, 9, 9)], reading(range(0, 40, 9)), reading(range(60))
    over = lambda a0, a1, b0, b1: max(0, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0))
    covers = lambda a, b: over(a[6], a[8], b[6], b[8]) > 0.5 and over(a[7], a[9], b[7], b[9]) > 0.3
    has = lambda rx, w: w[3] is not None and re.search(rx, w[3]) is not None
    conf = lambda w: -1.0 if w[5] is None else w[5]

    def lines(rows):
        found = {}
        for w in rows:
            found.setdefault(w[:2], []).append(w)
        return found

    want = {"native": lines(native), "foreign": {k: ws for k, ws in lines(foreign).items() if k[0] is not None and any(has("[A-Za-z]{2,}", w) and conf(w) >= 70 for w in ws)}, "layout": lines(layouts), "mix": {}}
    for at, ws in lines(native).items():
        if sum(len(w[4]) for w in ws if has("[ء-ی]", w) and conf(w) >= 80) * 2 < max(1, sum(len(w[4] or "") for w in ws)):
            continue
        guess = lambda w: w[3] is not None and not has("[ء-ی]", w)
        fresh = []
        for t in lines(foreign).get(at, []):
            near = [w for w in ws if covers(w, t)]
            sure = has("^[A-Za-z]{2,}$", t) and conf(t) >= 75
            calls = [False if w[3] is None and w[5] is not None and w[5] < t[5] or has("[ء-ی]", w) else None if w[3] is None or w[5] is None else w[5] >= t[5] for w in near] if sure else []
            if sure and any(guess(w) for w in near) and not any(w[3] == t[3] for w in near) and True not in calls and False in calls:
                fresh.append(t)
        if fresh:
            want["mix"][at] = [w for w in ws if not (guess(w) and any(covers(w, t) for t in fresh))] + fresh
    box = lambda ws: (min(w[6] for w in ws), min(w[7] for w in ws), max(w[8] for w in ws), max(w[9] for w in ws))
    numeric = [(k[0], box(ws)) for found in want.values() for k, ws in found.items() if any(has(r"\d", w) for w in ws)]
    clash = lambda a, b: over(a[1], a[3], b[1], b[3]) > 0.4 and over(a[0], a[2], b[0], b[2]) > 0.3
    bare = {k: ws for k, ws in lines(sparse).items() if any(w[3] is not None for w in ws) and not any(has(r"\d", w) for w in ws)}
    want["sparse"] = {k: ws for k, ws in bare.items() if not any(p == k[0] and clash(box(ws), b) for p, b in numeric)}
    found = layout.competing_readings(*(spark.createDataFrame(rows, schema) for rows in (native, foreign, layouts, sparse)), "page")
    got = [(r["reading"], *r[:10]) for r in found.collect()]
    rows = [(name, *w) for name, found_lines in want.items() for ws in found_lines.values() for w in ws]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert all(len(found_lines) >= 3 for found_lines in want.values()), {name: len(found_lines) for name, found_lines in want.items()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
