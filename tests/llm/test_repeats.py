import random

import numpy as np
import pytest

from hapframe.llm import repeats
from hapframe.llm.run_index import GRAM, RunIndex
from test_llm import removed


def some_segments(rng, n, side, letters, grams):
    parts = [(bytes(rng.choice(letters) for _ in range(rng.randrange(side + 1))), bytes([65 + rng.randrange(grams)]) * GRAM, bytes(rng.choice(letters) for _ in range(rng.randrange(side + 1)))) for _ in range(n)]
    rows = np.zeros((n, GRAM + 2 * side), np.uint8)
    for i, (a, g, b) in enumerate(parts):
        rows[i, side - len(a) : side + GRAM + len(b)] = np.frombuffer(a + g + b, np.uint8)
    return parts, rows, np.array([len(a) for a, _, _ in parts]), np.array([len(b) for _, _, b in parts])


def suffix(part, d):
    a, g, b = part
    return a[len(a) - d :] + g + b


def common(x, y):
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    side, letters = rng.choice([8, 9, 30]), rng.choice([b"\0\1", b"ab", b"abc\0", b"a"])
    held, patterns = some_segments(rng, rng.choice([1, 40, 200]), side, letters, 2), some_segments(rng, 60, side, letters, 3)
    if seed % 2:
        k = min(30, len(held[0]))
        patterns = ([*held[0][:k], *patterns[0][k:]], *(np.concatenate([x[:k], y[k:]]) for x, y in zip(held[1:], patterns[1:])))
    docs = np.array([rng.randrange(50) for _ in held[0]])
    index = RunIndex(*held[1:], docs, side)
    got = {(w, d): n for d, who, lengths, _ in index.stream(*patterns[1:]) for w, n in zip(who.tolist(), lengths.tolist())}
    found = {(w, d): least for w, d, least in zip(*(x.tolist() for x in index.long_matches(*patterns[1:])))}
    for i, part in enumerate(patterns[0]):
        for d in range(len(part[0]) + 1):
            own = suffix(part, d)
            lengths = [(common(own, suffix(x, d)), doc) for x, doc in zip(held[0], docs) if len(x[0]) >= d]
            assert got.get((i, d), 0) == max((n for n, _ in lengths), default=0)
            assert found.get((i, d)) == min((doc for n, doc in lengths if n >= GRAM + side), default=None)


def test_runs_are_few_where_text_repeats():
    rng, side = random.Random(1), 30
    parts, rows, left, right = some_segments(rng, 1, side, b"abcd", 1)
    assert RunIndex(*(np.repeat(x, 5000, 0) for x in (rows, left, right)), np.arange(5000), side).runs() == RunIndex(rows, left, right, np.arange(1), side).runs()


@pytest.mark.parametrize("seed,width,hot,size", [(1, 50, 1 << 18, 4 << 20), (2, 50, 0, 50), (3, 28, 3, 1000), (4, 100, 3, 1000), (5, 73, 0, 4 << 20)])
def test_removal_is_that_of_brute_force(spark, seed, width, hot, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab\0é") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([3, 30, 300]))]
    lines = ["".join(rng.choice(words) + " " for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = [(i, None if i % 20 == 7 else "".join(rng.choice(lines) if rng.random() < 0.6 else "".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))) for i in (rng.randrange(60) for _ in range(80))]
    rows += [(rng.randrange(60), "x" * rng.randrange(40, 300)) for _ in range(6)]
    want = sorted(removed(rows, width))
    of = {"width": width, "hot": hot, "chunk_bytes": size}
    assert sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **of).drop("kept").collect())) == want
    named = spark.createDataFrame([(f"k{d:03d}", t) for d, t in rows] + [(None, rows[0][1])], "doc_id string, text string")
    got = [tuple(r) for r in repeats.remove_repeats(named, **of).drop("kept").collect()]
    assert sorted(r for r in got if r[0] is not None) == [(f"k{r[0]:03d}", *r[1:]) for r in want]  # a null id is neither earlier nor later
    assert [r[2] for r in got if r[0] is None] == [0]


def test_one_line_in_very_many_documents(spark):
    line = "The same licence line stands in each and every one of these documents, word for word."
    frame = spark.range(200_000).selectExpr("id AS doc_id", f"concat('a', id, ' {line}', ' b', id % 7) AS text")
    got = repeats.remove_repeats(frame).selectExpr("min(if(doc_id = 0, 0, n_removed)) AS a", "max(n_removed) AS b", "sum(if(doc_id = 0, n_removed, 0)) AS c", "count(*) AS n", "max(n_spans) AS s").first()
    assert got.n == 200_000 and got.c == 0 and got.s == 1 and got.b >= len(line)
    text = [r.text.encode() for r in frame.where("doc_id < 400").collect()]
    few = sorted(map(tuple, repeats.remove_repeats(frame.where("doc_id < 400"), hot=50).drop("kept").collect()))
    assert few == sorted(removed([(i, t.decode()) for i, t in enumerate(text)]))


def test_ids_at_the_ends_of_their_range(spark):
    line, most = "The same licence line stands in each and every one of these documents, word for word.", 2**63 - 1
    rows = [(most, line), (-(2**63), line), (0, line), (None, line), (most, line), (5, "é" + line)]
    got = sorted((tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect() if r.doc_id is not None))
    assert got == sorted(removed([r for r in rows if r[0] is not None]))
