"""The join against brute force over word tuples, its search against plain counting, and odd inputs."""

import random
import re
from collections import Counter

import numpy as np

from relaudit.llm import ngram

VOCABULARY = [f"w{i}" for i in range(400)]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent):
    """(size, component) of each document by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, families=6, copies=20):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(VOCABULARY, k=25))
    rows = []
    for _ in range(families):
        base = rng.choices(VOCABULARY, k=rng.choice([3, 8, 40, 120]))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            text = " ".join(words)
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else f"{text} {passage}" if rng.random() < 0.3 else text))
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram.jaccard_groups(df, **options).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert got(spark, rows, words=4, percent=85) == brute(rows, 4, 85)


def test_large_groups_are_searched_in_blocks(spark):
    rows = corpus(2, families=3, copies=40)
    assert got(spark, rows, words=4, percent=85, block=7, bucket=500) == brute(rows, 4, 85)


def test_long_lists_are_set_aside(spark):
    rng = random.Random(4)
    passages = [rng.choices(VOCABULARY, k=30) for _ in range(7)]
    rows = [(i, " ".join(sum(rng.sample(passages, 4), []))) for i in range(150)]  # all tokens are common, few texts are similar
    rows += [(1000 + i, f"{t} {rng.choice(VOCABULARY)}") for i, t in rows[:20]]
    want = brute(rows, 4, 80)
    assert 1 < len({c for _, c in want.values()}) < len(rows)
    for long in (2, 64):
        assert got(spark, rows, words=4, percent=80, long=long, block=9) == want


def test_a_repeated_id_counts_with_its_largest_set(spark):
    rng = random.Random(6)
    a, b = (rng.choices(VOCABULARY, k=60) for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b + ["more"])), (2, " ".join(a + ["x"])), (3, " ".join(b + ["y"])), (4, " ".join(a + ["z"]))]
    assert {i: c for i, (_, c) in got(spark, rows).items()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_rows_without_an_id_take_no_part(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram.jaccard_groups(df).collect()) == [(1, 2, 1), (2, 2, 1)]
    assert sorted((r.doc_id or 0) for r in ngram.keep_one(df).collect()) == [0, 1]


def test_a_token_that_most_sets_hold(spark):
    rng = random.Random(7)
    rows = [(i, "one passage that all of them have in common " + " ".join(rng.choices(VOCABULARY, k=3))) for i in range(300)]
    assert got(spark, rows, words=4, percent=80, block=16) == brute(rows, 4, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c"), (7, "a  b\tc"), (8, "x " * 30_000), (9, "É b"), (10, "é b"), (8, "x " * 30_000)]
    assert got(spark, rows) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9), 10: (1, 10)}
    assert got(spark, rows[:3]) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    assert got(spark, []) == {}


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (3, None, 7, None)], "doc_id long, text string, component_id int, n_shingles string")
    out = ngram.keep_one(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c d e f", 5, "x"), (3, None, 7, None)]


def test_divide_skip_counts_like_a_counter(monkeypatch):
    rng = random.Random(5)
    for window in (1, 7, ngram.WINDOW):
        monkeypatch.setattr(ngram, "WINDOW", window)
        for _ in range(200):
            lists = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40)))) for _ in range(rng.randint(1, 9))]
            count = Counter(x for xs in lists for x in xs.tolist())
            for least in (1, 3, 6):
                for n_long in (0, 2, 5):
                    place, times = ngram.divide_skip(lists, least, n_long)
                    assert list(zip(place.tolist(), times.tolist(), strict=True)) == sorted((x, n) for x, n in count.items() if n >= least)


def test_shingle_sets_match_tuples():
    texts = [t for _, t in corpus(3)] + ["", None, "one", "Two  words", "\x1cone two\x0bthree four five"]
    assert [len(s) for s in ngram.shingle_sets(texts, 4)] == [len(shingles(t, 4)) for t in texts]
