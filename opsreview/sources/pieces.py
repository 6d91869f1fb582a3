"""Records that span lines or splits, found without reading a file in one task.

A file is read in pieces that any task can cut: lines for CSV, stretches up to a closing brace for a JSON
document. What a piece means depends on what came before it: whether a quote is open, and how deep the brackets
are. A task therefore follows its split for both answers to "does it begin inside quotes?". There is one summary row per split;
running sums over these rows tell every split how it really begins. Then each piece knows its record, and only
the pieces of records that have several are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.session import write_through

SPLIT = ("_file", "_start")
_PLACE = "_file string, _start long, _at long, value string"


def position() -> list[Column]:
    """File, start of the split, and a number that ascends along a split."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ]


def _new_splits(batch: pa.RecordBatch, before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows at which another split begins, and the split of the last row."""
    files = batch["_file"].dictionary_encode()
    code, start = files.indices.to_numpy(zero_copy_only=False), batch["_start"].to_numpy()
    first = (files.dictionary[code[0]].as_py(), int(start[0]))
    at = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
    at = np.concatenate([[0], at]) if first != before else at
    return at, (files.dictionary[code[-1]].as_py(), int(start[-1]))


def _before(column: Column, *keys: str) -> Column:
    """The sum over earlier splits, of the same keys where there are any."""
    window = (W.partitionBy(*keys) if keys else W).orderBy(*SPLIT).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _assembled(pieces: DataFrame, several: Column, glue: str) -> DataFrame:
    """``_file, _n, value``: the pieces of each record ``_n`` in order; those that stand alone stay where they are."""
    alone = pieces.where(~several).select("_file", "_n", "value")
    parts = pieces.where(several).groupBy("_file", "_n").agg(F.array_sort(F.collect_list(F.struct("_start", "_at", "value"))).alias("parts"))
    return alone.unionByName(parts.select("_file", "_n", F.array_join(F.transform("parts", lambda p: p["value"]), glue).alias("value")))


# --- CSV --------------------------------------------------------------------------------

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
#: Lines that end outside quotes: those that begin outside, and those that begin inside.
_ENDS_OUTSIDE = (re.compile(f"{_FIELD}(?:,{_FIELD})*+"), re.compile(rf'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+'))


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add, for a split that begins outside and for one that begins inside quotes, whether each line begins and ends inside."""
    split, now = None, (False, True)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh, split = _new_splits(batch, split)
        quoted = np.flatnonzero(pc.match_substring(batch["value"], '"').to_numpy(zero_copy_only=False))
        starts, marked = set(fresh.tolist()), set(quoted.tolist())
        begins, ends = np.zeros((2, n), bool), np.zeros((2, n), bool)
        done = 0
        for i in sorted(starts | marked):  # other lines change nothing
            begins[:, done:i] = ends[:, done:i] = np.array(now)[:, None]
            if i in starts:
                now = (False, True)
            begins[:, i] = now
            if i in marked:
                line = batch["value"][i].as_py()
                now = tuple(not _ENDS_OUTSIDE[inside].fullmatch(line) for inside in now)
            ends[:, i] = now
            done = i + 1
        begins[:, done:] = ends[:, done:] = np.array(now)[:, None]
        columns = {c: batch[c] for c in ("_file", "_start", "_at", "value")}
        yield pa.RecordBatch.from_pydict({**columns, "b0": begins[0], "b1": begins[1], "e0": ends[0], "e1": ends[1]})


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, bool] | None:
    """The records of CSV files as ``_row, value``, the header left out, and whether a quote stays open in some file.

    Null where carriage returns are mixed into the lines, so that what ends a line is a matter of the whole file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *position())
    bare = F.rtrim("value", F.lit("\r"))
    returned = F.endswith("value", F.lit("\r"))
    per_file = lines.groupBy("_file").agg(
        F.bool_or(F.contains(F.expr("substr(value, 1, length(value) - 1)"), F.lit("\r"))).alias("lone"),
        F.bool_or(returned).alias("some"),
        # The last line of a file may lack its end.
        (F.count(F.when(~returned, 1)) - F.max_by(F.when(returned, 0).otherwise(1), F.struct("_start", "_at"))).alias("without"),
    )
    if not per_file.where(F.col("lone") | (F.col("some") & (F.col("without") > 0))).isEmpty():
        return None
    scanned = lines.select("_file", "_start", "_at", bare.alias("value")).mapInArrow(_scan_lines, f"{_PLACE}, b0 boolean, b1 boolean, e0 boolean, e1 boolean")
    landed = write_through(scanned, "csv-lines")
    # A split maps "begins outside" and "begins inside" to where it ends: it keeps, turns, or fixes the state. The state at
    # a split is what the last fixing one before it says, turned as often as splits in between turn it.
    splits = landed.groupBy(*SPLIT).agg(F.max_by(F.struct("e0", "e1"), "_at").alias("ends")).select(*SPLIT, "ends.*")
    along = W.partitionBy("_file").orderBy("_start")
    turns = (F.col("e0") & ~F.col("e1")).cast("long")
    splits = splits.withColumn("turned", F.sum(turns).over(along))
    fixed = F.when(F.col("e0") == F.col("e1"), F.col("e0") != (F.col("turned") % 2 == 1))
    last_fixed = F.last(fixed, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    inside = F.coalesce(last_fixed, F.lit(False)) != ((F.col("turned") - turns) % 2 == 1)
    splits = write_through(splits.select(*SPLIT, F.struct("e0", "e1").alias("ends"), inside.alias("inside")), "csv-splits")
    last = splits.groupBy("_file").agg(F.max_by(F.when(F.col("inside"), F.col("ends.e1")).otherwise(F.col("ends.e0")), "_start").alias("open"))
    open_quote = bool(last.agg(F.bool_or("open")).first()[0])

    pieces = landed.join(splits.drop("ends"), list(SPLIT))
    pieces = pieces.select("_file", "_start", "_at", "value", F.when(F.col("inside"), F.col("b1")).otherwise(F.col("b0")).alias("b"), F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0")).alias("e"))
    pieces = pieces.where(F.col("b") | (F.col("value") != ""))  # an empty line between records is none
    first = (~F.col("b")).cast("long")
    counts = pieces.groupBy(*SPLIT).agg(F.sum(first).alias("n"))
    files_before = F.dense_rank().over(W.orderBy("_file"))
    counts = counts.select(*SPLIT, _before(F.col("n")).alias("before"), _before(F.col("n"), "_file").alias("before_in_file"), files_before.alias("headers"))
    inside = F.sum(first).over(W.partitionBy(*SPLIT).orderBy("_at"))
    numbered = pieces.withColumn("seen", inside).join(counts, list(SPLIT)).withColumn("_n", F.col("seen") + F.col("before") - F.col("headers"))
    numbered = numbered.where(F.col("seen") + F.col("before_in_file") > 1)  # the first record is the header
    records = _assembled(numbered, F.col("b") | F.col("e"), "\n")
    return records.select(F.col("_n").alias("_row"), "value"), open_quote


# --- JSON documents ---------------------------------------------------------------------

_ESCAPED = re.compile(r"\\.", re.S)
_LIST = re.compile(r'"records"\s*:\s*\[')


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _scan_braces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add, for a split that begins outside a string: whether each piece begins (``s``) and ends (``e``) inside one; for splits of
    both kinds the depth, counted from the split's begin, before the piece (``t``) and before its closing brace (``u``); and
    where a list named "records" begins (``lists``)."""
    split, inside, depth = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh, split = _new_splits(batch, split)
        starts = set(fresh.tolist())
        s, e = np.zeros(n, bool), np.zeros(n, bool)
        t, u = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        lists: list[list[dict] | None] = [None] * n
        for i, text in enumerate(batch["value"].to_pylist()):
            if i in starts:
                inside, depth = 0, [0, 0]
            bare = _ESCAPED.sub("..", text) if "\\" in text else text
            parts = bare.split('"')
            changes = _depth("".join(parts[0::2])), _depth("".join(parts[1::2]))
            s[i], t[:, i] = inside, depth
            if '"records"' in bare:
                lists[i] = []
                for found in _LIST.finditer(bare):
                    ahead = bare[: found.start()].split('"')
                    state = inside ^ (len(ahead) - 1) % 2
                    own = [depth[k] + _depth("".join(ahead[inside ^ k :: 2])) for k in (0, 1)]
                    lists[i].append({"end": found.end(), "s": bool(state), "d0": own[0], "d1": own[1]})
            for k in (0, 1):
                depth[k] += changes[inside ^ k]
            u[:, i] = depth
            inside ^= (len(parts) - 1) % 2
            e[i] = inside
            depth[inside] -= 1  # the brace closes something where it is outside a string
        columns = {c: batch[c] for c in ("_file", "_start", "_at", "value")}
        kinds = pa.list_(pa.struct([("end", pa.int32()), ("s", pa.bool_()), ("d0", pa.int64()), ("d1", pa.int64())]))
        yield pa.RecordBatch.from_pydict({**columns, "size": batch["size"], "s": s, "e": e, "t0": t[0], "t1": t[1], "u0": u[0], "u1": u[1], "lists": pa.array(lists, kinds)})


def json_elements(spark: SparkSession, path: str) -> tuple[DataFrame | None, bool]:
    """The objects of JSON documents, ``[...]`` or ``{"records": [...]}``, as ``_row, value``, in file order; and whether
    strings and brackets of all documents close.

    Null where a document is not plainly of such a form: other values in the list, or text between the objects or around
    the list that is not JSON; and where no document has an object. A document with an empty list adds none to those of the others.
    What stands outside the list is put together as one value; the list never is.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", *position(), F.col("_metadata.file_size").alias("size"))
    kinds = "array<struct<end: int, s: boolean, d0: bigint, d1: bigint>>"
    scanned = pieces.mapInArrow(_scan_braces, f"{_PLACE}, size long, s boolean, e boolean, t0 long, t1 long, u0 long, u1 long, lists {kinds}")
    landed = write_through(scanned, "json-pieces")
    ends = F.struct("e", (F.col("u0") - F.when(F.col("e"), 0).otherwise(1)).alias("d0"), (F.col("u1") - F.when(F.col("e"), 1).otherwise(0)).alias("d1"))
    splits = landed.groupBy(*SPLIT).agg(F.max_by(ends, "_at").alias("ends"))
    splits = splits.select(*SPLIT, "ends", (_before(F.col("ends.e").cast("long"), "_file") % 2 == 1).alias("inside"))
    here = F.when(F.col("inside"), F.col("ends.d1")).otherwise(F.col("ends.d0"))
    splits = write_through(splits.select(*SPLIT, "inside", _before(here, "_file").alias("base")), "json-splits")

    def real(name: str) -> Column:
        return F.col("base") + F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    where = F.struct("_start", "_at")
    known = landed.join(splits, list(SPLIT)).select(
        "_file", "_start", "_at", "value", "size", where.alias("place"),
        (F.col("s") != F.col("inside")).alias("s"), (F.col("e") != F.col("inside")).alias("e"), real("t").alias("t"), real("u").alias("u"),
        F.filter("lists", lambda x: (x["s"] == F.col("inside")) & (F.col("base") + F.when(F.col("inside"), x["d1"]).otherwise(x["d0"]) == 1)).alias("lists"),
    )
    known = write_through(known.withColumn("after", F.col("u") - F.when(F.col("e"), 0).otherwise(1)), "json-depths")
    # A row per document: its form, where the list begins, where the text ends.
    listed = F.when(F.size("lists") > 0, F.col("place"))
    docs = known.groupBy("_file").agg(
        F.min("place").alias("first"),
        F.substring(F.ltrim(F.min_by("value", "place"), F.lit(" \t\n\r﻿")), 1, 1).alias("form"),
        F.min(listed).alias("named"),
        F.min_by(F.col("lists")[0]["end"], listed).alias("offset"),
        F.max("place").alias("last"),
        F.max_by(F.struct("e", "u", "after"), "place").alias("final"),
        # The last piece has its brace if the lengths say so.
        (F.sum(F.octet_length("value")) + F.count("*") == F.first("size")).alias("closed"),
    )
    docs = docs.select(
        "_file", "form", "last", F.when(F.col("form") == "[", 1).otherwise(2).alias("level"),
        F.when(F.col("form") == "[", F.col("first")).otherwise(F.col("named")).alias("opens"), F.coalesce("offset", F.lit(0)).alias("offset"),
        "closed", (~F.col("final.e") & (F.when(F.col("closed"), F.col("final.after")).otherwise(F.col("final.u")) == 0)).alias("balanced"),
    )
    docs = write_through(docs, "json-documents")
    other, open_ones, every = docs.agg(
        F.count(F.when(F.col("opens").isNull() | ~F.col("form").isin("[", "{"), 1)), F.count(F.when(~F.col("balanced"), 1)), F.count("*")
    ).first()
    if other or open_ones or not every:
        return None, not open_ones
    inner = known.join(docs, "_file")
    opening, after_opening = F.col("place") == F.col("opens"), F.col("place") > F.col("opens")
    at_list = ~F.col("s") & (F.col("t") == F.col("level")) & after_opening
    # In the piece where the list begins, what comes up to its bracket belongs to the text around it.
    bracket = F.when(F.col("form") == "[", F.instr("value", "[")).otherwise(F.col("offset"))
    inner = inner.withColumn("ahead", F.when(opening, bracket).otherwise(0))
    inner = inner.withColumn("rest", F.when(opening, F.expr("substr(value, ahead + 1)")).otherwise(F.col("value")))
    # A list without elements closes in the piece where it begins.
    closing = F.when((opening | at_list) & F.startswith(F.ltrim("rest", F.lit(" \t\n\r")), F.lit("]")), F.col("place"))
    marks = inner.select("_file", "opens", closing.alias("closes"))
    docs = write_through(marks.groupBy("_file").agg(F.min("closes").alias("closes"), (F.min("closes") > F.first("opens")).alias("filled")), "json-lists")
    unclosed, filled = docs.agg(F.count(F.when(F.col("closes").isNull(), 1)), F.bool_or("filled")).first()
    if unclosed or not filled:
        return None, True
    inner = inner.join(docs.drop("filled"), "_file").withColumn("brace", F.instr("rest", "{"))
    before_list, after_list = F.col("place") < F.col("opens"), F.col("place") >= F.col("closes")
    begins = (opening | at_list) & ~after_list
    gap = F.trim(F.expr("substr(rest, 1, brace - 1)"), F.lit(" \t\n\r"))
    wrong = begins & ((F.col("brace") == 0) | (gap != F.when(opening, F.lit("")).otherwise(F.lit(","))))
    brace = F.when((F.col("place") == F.col("last")) & ~F.col("closed"), F.lit("")).otherwise(F.lit("}"))
    around = F.when(before_list | after_list, F.concat("value", brace)).when(opening, F.expr("substr(value, 1, ahead)"))
    skeletons = inner.groupBy("_file").agg(
        F.bool_or(wrong).alias("wrong"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(around.isNotNull(), F.struct("place", around.alias("text"))))), lambda x: x["text"]), "").alias("skeleton"),
    )
    document = F.try_parse_json(F.ltrim("skeleton", F.lit("﻿")))
    rows = F.expr("try_cast(coalesce(try_variant_get(document, '$.records', 'variant'), document) as array<variant>)")
    bad = skeletons.withColumn("document", document).where(F.col("wrong") | F.col("document").isNull() | F.coalesce(F.size(rows) != 0, F.lit(True)))
    if not bad.isEmpty():
        return None, True

    elements = inner.where(~before_list & ~after_list)
    ends_here = ~F.col("e") & (F.col("after") == F.col("level"))
    text = F.concat(F.when(begins, F.expr("substr(rest, brace)")).otherwise(F.col("rest")), F.lit("}"))
    elements = elements.select("_file", "_start", "_at", text.alias("value"), ends_here.cast("long").alias("ends"), (~(begins & ends_here)).alias("several"))
    counts = elements.groupBy(*SPLIT).agg(F.sum("ends").alias("n")).select(*SPLIT, _before(F.col("n")).alias("before"))
    ended = F.coalesce(F.sum("ends").over(W.partitionBy(*SPLIT).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = elements.withColumn("seen", ended).join(counts, list(SPLIT)).withColumn("_n", F.col("seen") + F.col("before") + 1)
    return _assembled(numbered, F.col("several"), "").select(F.col("_n").alias("_row"), "value"), True
