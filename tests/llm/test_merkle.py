"""Hash trees against a plain recomputation."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opsreview.llm import merkle

from .corpus import awkward, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc, text, lang, source, n = row
    values = [None if x is None else str(x) for x in (doc, source, lang, n, text)]
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in values))


def climbed(nodes):
    """The root, and for each node its siblings before and after on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            start = i // 3 * 3
            path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    rows = [(doc, text, lang, source, None if text is None else len(text)) for doc, text, lang, source in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *climbed([leaf(r) for r in own]))
    root, above = climbed([trees[s][1] for s in sources])
    out = []
    for s, outer in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for row, inner in zip(own, paths, strict=True):
            doc, text, *rest = row
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf((doc, text, *rest))
            for before, after in inner + outer:
                folded = h(before, folded, after)
            out.append((doc, leaf(row), subroot, root, h(*(x + y for x, y in inner + outer)), folded, folded == root))
    return out


def held(df):
    return merkle.manifest(df, merkle.without_line_breaks(F.col("text"), F.col("doc_id")), merkle.MerkleSettings(levels=2))


def same(got, rows):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    draw = random.Random(3)
    rows = awkward() + [(100 + k, f"a line\nand {k}\n", draw.choice(["en", None]), "hot") for k in range(250)] + [(7, "again\n", "en", "hot")] * 30
    same(held(frame(spark, rows, extra).repartition(5)).collect(), rows)


def test_more_sources_than_a_superblock_holds(spark):
    rows = [(k, "é\n" * (k % 3), None, None if k == 5 else f"s{k % 97}é") for k in range(400)]
    same(held(frame(spark, rows).repartition(3)).collect(), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 81, 82])
def test_sizes_around_full_trees(spark, n):
    rows = [(k, "x\n", "en", "a") for k in range(n)]
    same(held(frame(spark, rows)).collect(), rows)


def test_untampered_rows_are_verified(spark):
    got = merkle.manifest(frame(spark, awkward())).collect()
    assert all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1


def test_empty_table(spark):
    assert held(frame(spark, [])).collect() == []
