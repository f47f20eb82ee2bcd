import re
from collections import Counter
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import empty, rows, table
from verso.llm import fm_index, matching, run_index

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_bytes(data, window):
    last = 1 << 62
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            k = b[s : s + window]
            first[k] = min(first.get(k, last + 1), last if i is None else i)
    for i, t in data:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (last if i is None else i):
                gone[s : s + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def cut_words(data, window):
    count = Counter()
    for _, t in data:
        w = WORD.findall(t or "")
        count.update(tuple(w[s : s + window]) for s in range(len(w) - window + 1))
    for i, t in data:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        yield i, len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def test_substrings_equal_brute_force(spark):
    data = [(r[0], r[1]) for r in rows()]
    for crowd in (100_000, 3):
        out = run_index.remove_repeated_substrings(table(spark), block_mb=0.02, crowd=crowd).collect()
        assert sorted(map(key, out)) == sorted(map(key, cut_bytes(data, 50)))


def test_passages_equal_brute_force(spark):
    data = [(r[0], r[1]) for r in rows()]
    for crowd in (100_000, 3):
        out = fm_index.remove_repeated_passages(table(spark), block_mb=0.02, crowd=crowd).drop("n_spans").collect()
        assert sorted(map(key, out)) == sorted(map(key, cut_words(data, 35)))


def test_identifiers_of_other_types(spark):
    """Strings are compared by their order, so "10" comes before "9"; a date is an identifier like any other."""
    data = [(None if r[0] is None else str(r[0]), r[1]) for r in rows()]
    place = {i: k for k, i in enumerate(sorted({i for i, _ in data if i is not None}))}
    df = table(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = run_index.remove_repeated_substrings(df, block_mb=0.02)
    assert dict(out.dtypes)["doc_id"] == "string"
    want = cut_bytes([(None if i is None else place[i], t) for i, t in data], 50)
    name = {k: i for i, k in place.items()}
    assert sorted(map(key, out.collect())) == sorted(key((None if w[0] is None else name[w[0]], *w[1:])) for w in want)
    found = fm_index.remove_repeated_passages(df, block_mb=0.02).drop("n_spans").collect()
    assert sorted(map(key, found)) == sorted(map(key, cut_words(data, 35)))
    dates = table(spark).withColumn("doc_id", F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int")))
    assert fm_index.remove_repeated_passages(dates, block_mb=0.02).filter("doc_id is not null").count() == sum(i is not None for i, _ in data)
    assert run_index.remove_repeated_substrings(empty(spark).withColumn("doc_id", F.lit("x"))).count() == 0


def test_order_of_a_text_with_more_ties_than_24_bits(monkeypatch):
    """The two ways to sort ties give one order."""
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, 3000 + 40)
    order, new = matching.suffix_order(symbols, 8, 3000, 40)
    monkeypatch.setattr(matching, "MOST_TIES", 100)
    again = matching.suffix_order(symbols, 8, 3000, 40)
    assert (order == again[0]).all() and (new == again[1]).all()


def test_empty(spark):
    assert run_index.remove_repeated_substrings(empty(spark)).count() == 0
    assert fm_index.remove_repeated_passages(empty(spark)).count() == 0


def test_word_hashes_split_like_the_contract():
    texts = ["a b\tc\x0bd", "", " \n", "é x y", "one"]
    hashes, lens = matching.word_hashes([t.encode() for t in texts])
    assert lens.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(hashes.tolist())) == len(set(flat))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=9, unique=True), st.randoms())
def test_indexes_against_counting(pieces, rng):
    window = 6
    weights = np.array([rng.randrange(50) for _ in pieces])
    body = [p.encode() for p in pieces]
    lengths = np.array(list(map(len, body)))
    small = run_index.smallest_holders(b"".join(body), lengths, weights, window)
    symbols = b"".join(bytes([c, 0, 0, 0, 0, 1]) for p in body for c in p)
    many = fm_index.places_of_windows(symbols, lengths, weights, window)
    at = 0
    for p in body:
        for s in range(len(p) - window + 1):
            own = p[s : s + window]
            assert small[at] == min(w for q, w in zip(body, weights, strict=True) if own in q)
            assert many[at] == sum(w * sum(q[i : i + window] == own for i in range(len(q))) for q, w in zip(body, weights, strict=True))
            at += 1


def test_run_length_index_compresses_and_ranks():
    text = np.frombuffer(b"\xff".join([b"banana" * 20] * 3) + b"\xff", np.uint8)
    index = run_index.RunLengthIndex(text, 10)
    assert len(index.start) < len(text) / 4 and len(index.sample) == len(index.start)
    assert index.size.sum() == len(text)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    matrix = fm_index.WaveletMatrix(seq, 37)
    for _ in range(200):
        c, i = int(rng.integers(0, 37)), int(rng.integers(0, 501))
        assert matrix.rank(np.array([c]), np.array([i]))[0] == np.count_nonzero(seq[:i] == c)
