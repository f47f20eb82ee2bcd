"""Edit scripts and matching blocks against brute force and the standard library."""

import difflib
import random
import time
import tracemalloc

from verso.functions import distance


def plain_substitutions(gt, pred):
    rows = [list(range(len(pred) + 1))]
    for i, a in enumerate(gt, 1):
        row = [i]
        for j, b in enumerate(pred, 1):
            row.append(min(rows[-1][j - 1] + (a != b), rows[-1][j] + 1, row[j - 1] + 1))
        rows.append(row)
    i, j, out = len(gt), len(pred), []
    while i and j:
        if rows[i][j] == rows[i - 1][j - 1] + (gt[i - 1] != pred[j - 1]):
            if gt[i - 1] != pred[j - 1]:
                out.append((gt[i - 1], pred[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def pairs(seed, n, chars, most):
    rng = random.Random(seed)
    for _ in range(n):
        a = "".join(rng.choice(chars) for _ in range(rng.randint(0, most)))
        b = "".join(c if rng.random() > 0.2 else rng.choice(["", "x", c + c]) for c in a) if rng.random() < 0.6 else "".join(rng.choice(chars) for _ in range(rng.randint(0, most)))
        yield a, b


def test_substitutions_equal_the_whole_table():
    for a, b in [*pairs(1, 600, "ab", 12), *pairs(2, 200, "abcdé", 70), ("", "abc"), ("abc", ""), ("", "")]:
        assert distance.substitutions(a, b) == plain_substitutions(a, b), (a, b)


def test_long_fields_take_little_memory():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(10_000))
    b = "".join(c if rng.random() > 0.1 else rng.choice("abcxyz") for c in a)
    tracemalloc.start()
    began = time.time()
    found = distance.substitutions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 300 < len(found) <= 1100 and time.time() - began < 30
    assert peak < 4_000_000  # a whole table would be 100 million cells


def test_blocks_equal_the_standard_library():
    for a, b in [*pairs(4, 300, "abc", 20), *pairs(5, 60, "abcdefghij ", 400), *pairs(6, 20, "ab", 260), ("", ""), ("", "a")]:
        assert distance.block_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
        x, y = distance._codes(a), distance._codes(b)
        at, to, size = distance.longest_block(x, y, y == y)
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert size == want.size and (not size or (at, to) == (want.a, want.b))
