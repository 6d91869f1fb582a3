"""Pages of a sorted table against sorting all of it."""

import random

import pytest
from pyspark.sql import functions as F

from opsreview.functions.pages import Pages


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    return [(draw.choice([None, 1, 2, 3]), draw.choice(["a", "b", None]), k) for k in range(200)]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return Pages(spark.createDataFrame(rows, "level int, name string, id long").repartition(5), ["-level", "name", "id"], blocks=7)


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))


def test_pages_at_any_depth(pages, rows):
    want = sorted_rows(rows)
    assert pages.total == 200
    for limit, offset in ((1, 0), (30, 0), (30, 25), (200, 0), (7, 193), (50, 180), (5, 200), (5, 900)):
        got = [tuple(r) for r in pages.page(limit, offset).collect()]
        assert got == [(*r, 200) for r in want[offset : offset + limit]]
    for bad in ((0, 0), (5, -1)):
        with pytest.raises(ValueError):
            pages.page(*bad)


def test_a_page_reads_few_blocks(pages):
    assert len(pages._counts) > 4
    for offset in (0, 100, 190):
        read = pages.page(5, offset)._jdf.queryExecution().toString()
        assert "PushedFilters" in read and "_block" in read.split("PushedFilters")[1].split("\n")[0]
    blocks = pages._rows.select("_block", F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"] for r in blocks}) == len(blocks)  # a file holds one block, so its statistics leave it out


def test_following_rows(pages, rows):
    want = sorted_rows(rows)
    for k in (0, 57, 120, 150, 198, 199):
        last = dict(zip(("level", "name", "id"), want[k], strict=True))
        assert [tuple(r)[:3] for r in pages.after(last, 20).collect()] == want[k + 1 : k + 21]


def test_an_empty_table(spark):
    empty = Pages(spark.createDataFrame([], "id long"), ["id"])
    assert empty.total == 0 and empty.page(10).collect() == [] and empty.after({"id": 1}, 5).collect() == []
