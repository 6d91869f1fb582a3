"""Files cut into pieces against readers that take a file whole."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from opsreview.sources import files, pieces
from opsreview.sources.files import read_batch
from tests.test_ingest import ENTITY


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


COLUMNS = "c0 string, c1 string, c2 string, c3 string"


def whole_csv(spark, path):
    read = spark.read.schema(COLUMNS).options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=True).csv(path)
    return [tuple(r) for r in read.coalesce(1).collect()]


def cut_csv(spark, path):
    found = pieces.csv_records(spark, path)
    assert found is not None
    records, open_quote = found
    rows = records.select("_row", F.from_csv("value", COLUMNS, {"quote": '"', "escape": '"'}).alias("c")).select("_row", "c.*").collect()
    assert sorted(r["_row"] for r in rows) == list(range(1, len(rows) + 1))
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["_row"])], open_quote


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(1))
def test_written_csv(spark, tmp_path, small_splits, seed, end):
    draw = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", 'b "x"\ny', "c"])
    for _ in range(120):
        writer.writerow(["".join(draw.choice(["x", " ", '"', ",", "\n", "é", "word"]) for _ in range(draw.randrange(0, 9))) for _ in range(3)])
    (tmp_path / "x.csv").write_bytes(out.getvalue().replace("\r\n", "\n").replace("\n", end).encode())
    got, open_quote = cut_csv(spark, str(tmp_path / "x.csv"))
    assert got == whole_csv(spark, str(tmp_path / "x.csv")) and not open_quote and len(got) > 50


@pytest.mark.parametrize("seed", range(2))
def test_stray_quotes_and_empty_lines(spark, tmp_path, small_splits, seed):
    """Quotes inside plain fields open nothing; empty lines are no records outside quotes and text inside."""
    draw = random.Random(100 + seed)
    kinds = ['5" pipe', "plain", "", '"quoted, with ""more"" text"', '"two\nlines"', '"three\n\nlines"', "x y", '"closed" tail', '""']
    lines = ["a,b,c"]
    for _ in range(150):
        lines.append(",".join(draw.choice(kinds) for _ in range(draw.randrange(1, 4))))
        if draw.random() < 0.1:
            lines.append("")
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    got, open_quote = cut_csv(spark, str(tmp_path / "x.csv"))
    assert got == whole_csv(spark, str(tmp_path / "x.csv")) and not open_quote


def test_several_files_have_several_headers(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f'{k},"{i}\n!"\n' for i in range(40)))
    got, open_quote = cut_csv(spark, str(tmp_path))
    assert got == [(str(k), f"{i}\n!", None, None) for k in range(3) for i in range(40)] and not open_quote


def test_open_quotes_and_mixed_line_ends(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n' + "2,y\n" * 50)
    assert cut_csv(spark, str(tmp_path / "open.csv"))[1]
    for name, text in (("mixed", 'a,b\r\n1,"x\ny"\r\n'), ("lone", 'a,b\n1,"x\ry\nz"\n')):
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        assert pieces.csv_records(spark, str(tmp_path / f"{name}.csv")) is None


def test_a_spanning_csv_upload_is_read_by_many_tasks(spark, tmp_path, small_splits):
    columns = [c for c in ENTITY if c not in ("name",)]
    rows = [",".join(["name", *columns])]
    rows += ['"a ""b""\n%d",' % k + ",".join(str(dict(ENTITY, entity_id=f"ENT-{k}")[c]) for c in columns) for k in range(60)]
    (tmp_path / "e.csv").write_text("\n".join(rows) + "\n")
    assert spark.read.text(str(tmp_path / "e.csv")).rdd.getNumPartitions() > 5
    batch = read_batch(spark, "entities", str(tmp_path / "e.csv"))
    got = sorted(batch.rows.collect(), key=lambda r: r[files.ROW])
    assert [(r[files.ROW], r["name"], r["entity_id"]) for r in got] == [(k + 1, f'a "b"\n{k}', f"ENT-{k}") for k in range(60)] and batch.fatal == ()


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return "".join(draw.choice(['{', '}', '[', ']', '"', '\\', ',', ':', ' ', 'é', 'records', '\n']) for _ in range(draw.randrange(0, 8)))
    if kind < 5:
        return draw.choice([1, -2.5, True, None, "x"])
    if kind == 5:
        return [value(draw, depth + 1) for _ in range(draw.randrange(0, 3))]
    return {f"k{i}": value(draw, depth + 1) for i in range(draw.randrange(0, 3))} | ({"records": [{"in": 1}]} if draw.random() < 0.2 else {})


@pytest.mark.parametrize("form, seed", [("list", 0), ("records", 1), ("around", 2)])
def test_json_documents(spark, tmp_path, small_splits, form, seed):
    draw = random.Random(seed)
    rows = [{"n": k, "v": value(draw), "records": value(draw)} for k in range(60)]
    indent = draw.choice([None, 2])
    document = rows if form == "list" else {"records": rows} if form == "records" else {"meta": {"of": [{"records": [1]}], "text": '"records": [{'}, "records": rows, "tail": [{"x": "]}"}]}
    (tmp_path / "x.json").write_text(json.dumps(document, indent=indent, ensure_ascii=bool(seed % 2)))
    found, balanced = pieces.json_elements(spark, str(tmp_path / "x.json"))
    assert found is not None and balanced
    got = sorted(found.collect(), key=lambda r: r["_row"])
    assert [r["_row"] for r in got] == list(range(1, 61)) and [json.loads(r["value"]) for r in got] == rows


@pytest.mark.parametrize(
    "text",
    ["[1", "[]", "{}", '{"rows": [{"a": 1}]}', '[{"a": 1}, 2]', '[{"a": 1} {"b": 2}]', '[{"a": 1}]]', '[{"a": 1}', '[{"a": "x}]', '{"records": [{"a": 1}], "b": }', '[3, {"a": 1}]', '{"records": {"a": [{"b": 1}]}}', "x {"],
)
def test_other_json_is_left_to_the_whole_reader(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    found, balanced = pieces.json_elements(spark, str(tmp_path / "x.json"))
    assert found is None and (balanced or read_batch(spark, "entities", str(tmp_path / "x.json")).fatal == ("malformed_json",))
    assert read_batch(spark, "entities", str(tmp_path / "x.json")).fatal or text == "[]"


EMPTY_LISTS = ["[]", " [ \n] ", '{"records": []}', '{"source": {"name": "}{"}, "records": [\t], "end": [{}]}']


def test_empty_lists_do_not_send_other_documents_to_the_whole_reader(spark, tmp_path, small_splits):
    """Partitions without rows are written as documents without elements."""
    rows = [{"n": k, "v": "]}[{"} for k in range(60)]
    for k, text in enumerate([EMPTY_LISTS[0], json.dumps(rows[:25]), *EMPTY_LISTS[1:], json.dumps({"a": [], "records": rows[25:]}), EMPTY_LISTS[3]]):
        (tmp_path / f"{k}.json").write_text(text)
    found, balanced = pieces.json_elements(spark, str(tmp_path))
    assert found is not None and balanced
    got = sorted(found.collect(), key=lambda r: r["_row"])
    assert [r["_row"] for r in got] == list(range(1, 61)) and [json.loads(r["value"]) for r in got] == rows


@pytest.mark.parametrize("text, code", [('{"records": [], "b": }', "malformed_json"), ('[[{"a": 1}]]', "invalid_json_structure")])
def test_what_only_begins_like_an_empty_list_is_refused(spark, tmp_path, text, code):
    (tmp_path / "0.json").write_text('[{"a": 1}]')
    (tmp_path / "1.json").write_text(text)
    assert pieces.json_elements(spark, str(tmp_path))[0] is None
    folder = tmp_path / "up.json"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text((tmp_path / f"{k}.json").read_text())
    assert read_batch(spark, "entities", str(folder)).fatal == (code,)


def test_a_folder_of_empty_lists_has_no_rows(spark, tmp_path):
    folder = tmp_path / "up.json"
    folder.mkdir()
    for k, text in enumerate(EMPTY_LISTS):
        (folder / f"{k}.json").write_text(text)
    batch = read_batch(spark, "entities", str(folder))
    assert batch.fatal == () and batch.row_count == 0 and batch.rows.count() == 0


def test_json_uploads_are_numbered_over_files(spark, tmp_path, small_splits):
    folder = tmp_path / "up.json"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps([dict(ENTITY, entity_id=f"ENT-{k}{i}") for i in range(9)]))
    batch = read_batch(spark, "entities", str(folder))
    got = sorted(batch.rows.collect(), key=lambda r: r[files.ROW])
    assert [r["entity_id"] for r in got] == [f"ENT-{k}{i}" for k in range(2) for i in range(9)] and [r[files.ROW] for r in got] == list(range(1, 19))
    (folder / "1.json").write_text('[{"a": 01}]')
    assert read_batch(spark, "entities", str(folder)).fatal == ("malformed_json",)


def test_a_document_of_one_line_is_no_single_row(spark, tmp_path):
    path = tmp_path / "alerts.json"
    path.write_text("[" + ",".join('{"alert_id": "ALR-%d", "colour": "rød"}' % i for i in range(2000)) + "]")
    longest = files.stretches(spark, str(path), "json").agg(F.max(F.length("value"))).first()[0]
    assert longest < 60
    assert files.read_batch(spark, "alerts", str(path)).row_count == 2000
    path.write_bytes(path.read_bytes().replace("ø".encode(), b"\xc3", 1))
    assert files.read_batch(spark, "alerts", str(path)).fatal == ("content_format_mismatch",)
