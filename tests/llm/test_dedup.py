"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from opsreview.llm import exact_dedup, near_dedup
from opsreview.llm.components import components

from .corpus import awkward, frame, words

BLANK = re.compile("[\x20\x09-\x0d]+")


def key(row):
    return tuple((x is None, x) for x in row)


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0))
    out = []
    for norm, own in groups.items():
        own.sort()
        for k, (_, missing, doc) in enumerate(own):
            out.append((None if missing else doc, None if own[0][1] else own[0][2], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_awkward_rows(spark, extra):
    rows = awkward() + [(100 + k, " \n".join("same text".split()), "en", "a") for k in range(50)]
    got = exact_dedup.deduplicated(frame(spark, rows, extra).repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == brute_exact(rows)


def test_exact_run_over_many_partitions(spark):
    rows = [(k, "copy " * (1 + k % 3), "en", "a") for k in range(3000)] + [(5000 + k, f"own {k}", "en", "a") for k in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup.deduplicated(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=key) == brute_exact(rows)


def test_exact_empty_table(spark):
    assert exact_dedup.deduplicated(frame(spark, [])).collect() == []


def shingles(text, width):
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < width:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(zip(*[own[k:] for k in range(width)], strict=False))


def brute_near(rows, width, percent):
    sets = [shingles(t, width) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            group[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (doc, *_) in enumerate(rows):
        if doc is not None and (least[root(k)] is None or doc < least[root(k)]):
            least[root(k)] = doc
    out = []
    for k, (doc, *_) in enumerate(rows):
        component = least[root(k)] if sets[k] else doc
        out.append((doc, len(sets[k]), component, component is None or doc == component))
    return sorted(out, key=key)


def near_family(draw, start, n, size=150, most=40):
    """Copies of one text with up to ``most`` words changed, so that many pairs lie near the threshold."""
    base = words(draw, size)
    rows = []
    for k in range(n):
        own = list(base)
        for at in draw.sample(range(size), draw.randrange(most)):
            own[at] = f"y{draw.randrange(10_000)}"
        rows.append((start + k, " ".join(own), "en", "a"))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_awkward_rows(spark, width, percent):
    draw = random.Random(4)
    rows = awkward() + near_family(draw, 1000, 120, most=12) + near_family(draw, 2000, 60, size=80, most=6)
    settings = near_dedup.NearSettings(shingle=width, percent=percent, tile_rows=16)
    got = near_dedup.grouped(frame(spark, rows, True).repartition(5), settings).collect()
    assert sorted(map(tuple, got), key=key) == brute_near(rows, width, percent)


def test_near_chain_without_a_common_leader(spark):
    draw = random.Random(9)
    text = words(draw, 200)
    rows = []
    for k in range(40):  # each text differs a little from the one before it, the ends differ in everything
        text = [*text[5:], *[f"z{draw.randrange(100_000)}" for _ in range(5)]]
        rows.append((k, " ".join(text), "en", "a"))
    got = near_dedup.grouped(frame(spark, rows), near_dedup.NearSettings(shingle=3, percent=85)).collect()
    assert sorted(map(tuple, got), key=key) == brute_near(rows, 3, 85)


def test_near_one_row_of_each_group_stays(spark):
    rows = awkward()
    got = near_dedup.deduplicated(frame(spark, rows, True))
    assert got.columns == frame(spark, [], True).columns
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == sorted({r[0] for r in brute_near(rows, 5, 80) if r[3]})


def test_near_empty_table(spark):
    assert near_dedup.grouped(frame(spark, [])).collect() == []
    assert near_dedup.deduplicated(frame(spark, [])).collect() == []


def test_collisions_leave_few_misses():
    settings = near_dedup.NearSettings(percent=85)
    t = near_dedup.least_collisions(settings)
    assert 30 < t < 0.85 * settings.coordinates


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101 + k) for k in range(50)] + [(300, 300), (400, 401)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 151), 100), 400: 400, 401: 400}


def test_own_columns_of_clashing_names_stay(spark):
    rows = [(k, " ".join(words(random.Random(k), 40)), "en", "a") for k in range(6)] + [(9, " ".join(words(random.Random(3), 40)), "en", "a"), (9, "x", "en", "a")]
    docs = frame(spark, rows).selectExpr("*", "'mine' AS kept_id", "'mine' AS row", "'mine' AS id", "'mine' AS rows")
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns and {r["kept_id"] for r in got.collect()} == {"mine"}
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 9]
