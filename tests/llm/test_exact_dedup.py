from collections import defaultdict
from hashlib import sha256

from tests.llm.fixtures import empty, rows, table
from verso.llm.exact_dedup import drop_exact_duplicates, mark_exact_duplicates


def test_marks_equal_brute_force(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        found = mark_exact_duplicates(table(spark), keep=keep, salts=3).collect()
        assert len(found) == len(rows())
        kept = defaultdict(int)
        for r in found:
            ids = groups[r["text"] or ""]
            known = [i for i in ids if i is not None]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == (pick(known) if known else None)
            assert r["text_sha256"] == sha256((r["text"] or "").encode()).hexdigest()
            kept[r["text"] or ""] += r["kept"]
            if r["kept"]:
                assert r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1}


def test_drop_keeps_columns(spark):
    df = table(spark)
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert out.count() == len({r[1] or "" for r in rows()})
    assert drop_exact_duplicates(empty(spark)).count() == 0
