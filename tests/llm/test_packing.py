import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import empty, rows, table
from verso.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(reference):
    vocabulary, pattern = P.default_vocabulary()
    rng = random.Random(1)
    texts = [r[1] or "" for r in rows()] + ["It's 3,5 €  \n\n tab\there <|endoftext|> end", "é" * 50 + "🙂" * 9, "á   x", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500))]
    for t in texts:
        assert reference.encode(t, add_special_tokens=False).ids == P.token_ids(t, vocabulary, pattern).tolist()


def test_plan_places_every_item_once(spark):
    rng = random.Random(4)
    for size in (7, 50):
        counts = {n: rng.randrange(0, 40) for n in range(1, size + 1)}
        got = defaultdict(int)
        bins = P.best_fit({k: v for k, v in counts.items() if v}, size)
        for items, n in bins:
            assert sum(items) <= size
            for x in items:
                got[x] += n
        assert dict(got) == {k: v for k, v in counts.items() if v}
        total = sum(k * v for k, v in counts.items())
        least = max(total / size, sum(v for k, v in counts.items() if 2 * k > size))
        assert sum(n for _, n in bins) <= least * 1.2 + 1


def test_pack(spark, reference):
    for length in (64, 2048):
        out = P.pack(table(spark), length=length).collect()
        used = defaultdict(list)
        ids = defaultdict(list)
        for r in rows():
            ids[r[0]].append(np.array(reference.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4"))
        want = defaultdict(int)
        for i, many in ids.items():
            for one in many:
                first = len(one) % length or length
                cuts = [0, *range(first, len(one) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    want[(i, k, a, b - a, zlib.crc32(one[a:b].tobytes()))] += 1
        got = defaultdict(int)
        for r in out:
            got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        assert got == want
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= length
    assert P.pack(empty(spark)).count() == 0
