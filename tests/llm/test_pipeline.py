from collections import Counter, defaultdict

import corpus_pipeline as C
from tests.llm.fixtures import empty, rows, table
from verso.llm import mixing, packing, quality_rules, simhash


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, rows(n=90)).drop("kept", "size", "fp", "_text")
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == packing.pack(table(spark)).columns
    read = lambda k: spark.read.parquet(str(tmp_path / C.STAGES[k][0]))
    good, single, apart = read(0), read(1), read(2)
    want = quality_rules.judged(table(spark, rows(n=90))).filter("kept").count()
    assert good.count() == want
    assert single.count() == good.select("text").distinct().count()
    groups = simhash.near_duplicates(single).select("component_id").distinct().count()
    assert apart.count() == groups
    # The mix takes whole documents as often as the operator says, and every piece of each is packed once.
    key = lambda r: (r["doc_id"], r["text"])
    copies, taken = Counter(), Counter(map(key, read(3).collect()))
    text_of = {r["doc_id"]: r["text"] for r in apart.collect()}
    for r in mixing.mix(apart).collect():
        copies[r["doc_id"], text_of[r["doc_id"]]] += r["copies"]
    assert taken == Counter({k: n for k, n in copies.items() if n})
    pieces = read(4).collect()
    vocabulary, pattern = packing.default_vocabulary()
    ids = {i: len(packing.token_ids(t, vocabulary, pattern)) + 1 for (i, t) in taken}
    held, places = Counter(), defaultdict(list)
    for r in pieces:
        held[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == Counter({i: ids[i] * n for (i, _), n in taken.items()})
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_empty_table(spark, tmp_path):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
        if "text" not in docs.columns:
            break
