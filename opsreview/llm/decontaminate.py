"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers and units after numbers become typed placeholders, and in a second template of each
window capitalised words, too, so an item whose numbers or names were swapped keeps a template. Windows of template tokens are
hash-joined; where names are typed they must be consistent: along one alignment of document
and item, equal item names stand for equal document names and unequal ones for unequal ones.
Numbers are free. A document is contaminated if such windows cover enough of an item.

Windows of too few words besides placeholders, and whole items of a few tokens, are looked up by their
values instead. Only the distinct hashes of the benchmark's windows go to all tasks, and only while
their count is below a stated bound; beyond it the same join shuffles.

Each searched window has an anchor that a text must hold to hold the window: four, two or one words of
letters in a row that no placeholder changes, or numerals in a row where values are searched. One
plain split of every whole text finds the texts with some anchor, and only these are made into
templates, once for all window sizes, and looked up window by window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.llm.tables import text_of
from opsreview.session import write_through

# Placeholders are letters, so that splitting keeps them; U+01C0 to U+01C3 are not used in prose.
NAME, NUMBER, UNIT = "ǀa", "ǀn", "ǀu"
# Wherever it stands, so that what precedes an item changes nothing.
_CAPITALISED = r"(?<![\p{L}\p{N}])\p{Lu}(?=\p{L}*\p{Ll})\p{L}+"
UNITS = (
    "kg mg g lb lbs oz km cm mm m mi mile miles ft feet inch inches yd ml l liter liters litre litres "
    "s sec seconds min mins minutes h hour hours day days week weeks month months year years "
    "usd eur dollar dollars euro euros cent cents percent kmh mph kwh w kw v hz degrees"
).split()

_TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
_MULTIPLES = "hundred|thousand|million|billion"
_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    f"{_TENS}|{_MULTIPLES}|dozen"
)
_DIGITS = r"ǃ?\p{Nd}+(?:[ǁǂ]\p{Nd}+)*ǃ?"


@dataclass(frozen=True)
class DecontaminationSettings:
    """``coverage``: share of an item's windows that must be found; ``least_tokens``: shorter items
    say too little for a template and are looked for, by their values, with ``short_items`` only;
    ``least_literals``: words a window must have besides placeholders, others are looked up by their values;
    ``broadcast_hashes``: up to so many distinct window hashes (8 bytes each) go to every task."""

    window: int = 8
    coverage: float = 0.5
    least_tokens: int = 5
    least_literals: int = 4
    broadcast_hashes: int = 2_000_000
    short_items: bool = False


def _spaced(text: Column) -> Column:
    """Numerals, of digits or words, as single tokens: signs, points, fractions and percent signs become letters, thousands separators go."""
    out = F.regexp_replace(text, r",(?=\p{Nd}{3}(?!\p{Nd}))(?<=\p{Nd},)", "")
    out = F.regexp_replace(out, r"[.](?=\p{Nd})(?<=\p{Nd}[.])", "ǁ")
    out = F.regexp_replace(out, r"/(?=\p{Nd})(?<=\p{Nd}/)", "ǂ")
    out = F.regexp_replace(out, r" ?%(?<=\p{Nd} ?%)", "ǃ")
    out = F.regexp_replace(out, r"[-\u2212](?=\p{Nd})(?<![^\s(=,\[].)", "ǃ")
    out = F.regexp_replace(out, _DIGITS, " $0 ")
    joined = rf"(?i)(?: and |[ -])(?:(?=(?:{_WORDS})\b)(?<=\b(?:{_TENS}|{_MULTIPLES})[ -]|(?:hundred|thousand) and )|(?=(?:{_MULTIPLES})\b)(?<=\b(?:{_WORDS})[ -]))"
    return F.regexp_replace(F.when(F.col("text").rlike(r"\p{Nd}"), out).otherwise(text), joined, "ǂ")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _templated(spaced: Column) -> Column:
    out = F.regexp_replace(spaced, _DIGITS, NUMBER)
    out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_WORDS})(?:ǂ(?:{_WORDS}))*(?![\p{{L}}\p{{N}}])", NUMBER)
    return F.regexp_replace(out, rf"(?i)({NUMBER}[ -]+)(?:{'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$2")


def _tokens(df: DataFrame) -> DataFrame:
    """Adds token arrays of equal length: ``values``, ``template`` (numbers and units typed) and ``named`` (names, too)."""
    rows = df.withColumn("spaced", _spaced(F.col("text")))
    rows = rows.withColumn("templated", _templated(F.col("spaced")))
    named = F.regexp_replace("templated", _CAPITALISED, NAME)
    return rows.withColumns({"values": _split(F.col("spaced")), "template": _split(F.col("templated")), "named": _split(named)}).drop("spaced", "templated")


# Ways to look a window up: by its template with the names as they are in lower case, with capitalised words
# typed as names, or by its values where the template says too little.
TEMPLATE, NAMES, EXACT = 0, 1, 2
_STREAM = {TEMPLATE: "template", NAMES: "named", EXACT: "values"}


def _low_windows(df: DataFrame, size: int, settings: DecontaminationSettings) -> DataFrame:
    """Adds ``low``, the starts (from 1) of the windows with too few literals: a window has too many
    placeholders where it holds some placeholder and the one ``need - 1`` places on in their order."""
    n = F.size("template") - (size - 1)
    need = size - settings.least_literals + 1
    if need <= 0 or size < settings.least_tokens:
        return df.withColumn("low", F.sequence(F.lit(1), n))
    df = df.withColumn("typed", F.filter(F.transform("template", lambda x, i: F.when(x.startswith("ǀ"), i + 1)), lambda x: x.isNotNull()))
    ends = F.zip_with("typed", F.slice("typed", F.lit(need), F.greatest(F.size("typed"), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    ends = F.filter(ends, lambda r: r["last"].isNotNull())
    ranges = F.transform(ends, lambda r: F.struct(F.greatest(F.lit(1), r["last"] - (size - 1)).alias("low"), F.least(r["first"], n).alias("high")))
    ranges = F.filter(ranges, lambda r: r["low"] <= r["high"])
    return df.withColumn("low", F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["low"], r["high"]))))).drop("typed")


def _windows(df: DataFrame, size: int, settings: DecontaminationSettings) -> DataFrame:
    """One row per window of ``size`` tokens and way to look it up: ``at`` (from 0), ``way`` and ``hash``."""
    rows = _low_windows(df.filter(F.size("template") >= size), size, settings)
    starts = {EXACT: F.col("low")}
    if size >= settings.least_tokens:
        every = F.sequence(F.lit(1), F.size("template") - (size - 1))
        starts[TEMPLATE] = every
        starts[NAMES] = F.when(F.array_contains("named", NAME), every).otherwise(F.array().cast("array<int>"))

    def hashed(way: int) -> Column:
        one = lambda i: F.struct((i - 1).alias("at"), F.lit(way).alias("way"), F.xxhash64(F.lit(way), F.slice(_STREAM[way], i, F.lit(size))).alias("hash"))
        return F.transform(starts[way], one)

    # Outer: Spark would evaluate the array of an inner one twice, to keep rows without windows out.
    return rows.select("doc_id", "text_hash", F.inline_outer(F.concat(*map(hashed, starts))))


def _of_way(template: Column, named: Column, values: Column) -> Column:
    return F.when(F.col("way") == EXACT, values).when(F.col("way") == NAMES, named).otherwise(template)


# What anchors are made of, and the marks that stand in words which no anchor covers.
_BETWEEN_LETTERS = r"[\P{L}ǀ-ǃ]+"
_ONLY_LETTERS = rf"^(?:[\p{{L}}&&[^ǀ-ǃ]]+|{NAME})$"
_IS_NAME = r"^\p{Lu}(?=\p{L}*\p{Ll})\p{L}+$"
_MARKS = r"[\p{Nl}\p{No}ǀ-ǃ]"
LETTERS, NUMERALS, MARK = 0, 1, 2


def _numerals(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, r",(?=\p{Nd}{3}(?!\p{Nd}))(?<=\p{Nd},)", ""), F.lit(r"\p{Nd}+"), F.lit(0))


def _one(kind: int, word: Column) -> Column:
    return F.xxhash64(F.lit(kind), word)


def _paired(hashes: Column, step: int) -> Column:
    """The hash of each entry and the one ``step`` places on; null where one of them is."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), pair)


def _grams(df: DataFrame, ones: Column, name: str = "of") -> DataFrame:
    """Adds ``of1``, the hashes of single entries, and ``of2`` and ``of4``, those of two and four in a row."""
    df = df.withColumn(f"{name}1", ones)
    return df.withColumn(f"{name}2", _paired(F.col(f"{name}1"), 1)).withColumn(f"{name}4", _paired(F.col(f"{name}2"), 2))


def _anchored(windows: DataFrame) -> DataFrame:
    """Adds each window's ``anchor``, its ``kind`` and how many words or numerals it has in a row (``in_row``).
    Typed names are words of such a row, as each of them is one word of letters in any text."""
    literal = F.filter("item_template", lambda x: ~x.startswith("ǀ"))
    parts = F.filter(F.flatten(F.transform(literal, lambda x: F.split(x, _BETWEEN_LETTERS))), lambda x: x != "")
    longest = F.array_min(F.transform(parts, lambda x: F.struct((-F.length(x)).alias("less"), x.alias("word"))))["word"]

    def found(hash_: Column, kind: int, in_row: int) -> Column:
        return F.when(hash_.isNotNull(), F.struct(hash_.alias("anchor"), F.lit(kind).alias("kind"), F.lit(in_row).alias("in_row")))

    def fewest_names(n: int) -> Column:
        names = lambda i: F.size(F.filter(F.slice("item_template", i + 1, F.lit(n)), lambda x: x == NAME))
        return F.array_min(F.transform(f"of{n}", lambda h, i: F.when(h.isNotNull() & (names(i) < n), F.struct(names(i).alias("names"), h.alias("hash")))))["hash"]

    rows = _grams(windows, F.transform("item_template", lambda x: F.when(x.rlike(_ONLY_LETTERS), _one(LETTERS, x))))
    alone = F.when(longest.isNotNull(), _one(LETTERS, longest))
    rows = rows.withColumns({f"letters{n}": found(fewest_names(n) if n > 1 else alone, LETTERS, n) for n in (1, 2, 4)})
    rows = _grams(rows, F.transform(_numerals(F.array_join("item_values", " ")), lambda x: _one(NUMERALS, x)))
    rows = rows.withColumns({f"numerals{n}": F.when(F.col("way") == EXACT, found(F.array_min(f"of{n}"), NUMERALS, n)) for n in (1, 2, 4)})
    order = [f"{x}{n}" for n in (4, 2, 1) for x in ("letters", "numerals")]
    best = F.coalesce(*order, found(_one(MARK, F.lit("")), MARK, 1))
    return rows.withColumn("best", best).select(*windows.columns, "best.*")


def _with_anchors(documents: DataFrame, windows: DataFrame, settings: DecontaminationSettings) -> DataFrame:
    """The rows of ``doc_id, text`` whose texts hold some window's anchor, with ``text_hash``. Texts with a letter whose
    lower case depends on what follows, or is two characters, are always among them."""
    anchors = windows.select("kind", "in_row", "anchor").distinct()
    counts = {(r["kind"], r["in_row"]): r["n"] for r in anchors.groupBy("kind", "in_row").agg(F.count("*").alias("n")).collect()}  # at most seven rows
    text, none = F.col("text"), F.array().cast("array<bigint>")
    always = text.contains("İ") | (text.contains("Σ") & text.rlike(r"\p{L}Σ(?!\p{L})"))
    always = always | text.rlike(_MARKS) if (MARK, 1) in counts else always
    rows = documents.select(F.xxhash64("text").alias("text_hash"), "text", F.when(always, F.array(_one(MARK, F.lit("")))).otherwise(none).alias("grams"))
    of_letters, of_numerals = ([n for n in (1, 2, 4) if (kind, n) in counts] for kind in (LETTERS, NUMERALS))
    if of_letters:
        lower = rows.withColumn("words", F.split("text", _BETWEEN_LETTERS)).withColumn("lower", F.transform("words", F.lower))
        named = lambda x, y: F.when((x != y) & x.rlike(_IS_NAME), F.lit(NAME)).otherwise(y)
        rows = _grams(lower, F.transform("lower", lambda x: _one(LETTERS, x)))
        rows = _grams(rows, F.transform(F.zip_with("words", "lower", named), lambda x: _one(LETTERS, x)), "name")
        # Of rows with typed names only those that hold one are new.
        new = [F.filter(F.zip_with(f"of{n}", f"name{n}", lambda a, b: F.when(a != b, b)), lambda x: x.isNotNull()) for n in of_letters if n > 1]
        rows = rows.select("text_hash", "text", F.concat("grams", *[f"of{n}" for n in of_letters], *new).alias("grams"))
    if of_numerals:
        rows = _grams(rows, F.transform(_numerals(text), lambda x: _one(NUMERALS, x)))
        rows = rows.withColumn("grams", F.concat("grams", *[f"of{n}" for n in of_numerals]))
    rows = rows.select("text_hash", F.explode_outer("grams").alias("anchor"))  # outer: as in _windows
    anchors = anchors.select("anchor").union(anchors.sparkSession.range(1).select(_one(MARK, F.lit("")))).distinct()
    small = sum(counts.values()) <= settings.broadcast_hashes
    rows = rows.join(F.broadcast(anchors) if small else anchors.hint("merge"), "anchor", "left_semi")
    held = write_through(rows.select(F.col("text_hash").alias("held")).distinct(), "anchored-texts")
    hashed = documents.withColumn("text_hash", F.xxhash64("text"))
    return hashed.join(held, F.col("text_hash") == F.col("held"), "left_semi")


def _benchmark_windows(benchmark: DataFrame, settings: DecontaminationSettings) -> DataFrame:
    """The items' windows. An item shorter than a window is one window of its own length.

    ``typed``: the template says enough to be searched; other windows are searched by their values.
    ``free``: it does with names typed as well. ``typed_windows`` and ``free_windows`` count those, ``item_windows`` all.
    """
    least = 1 if settings.short_items else settings.least_tokens
    items = _tokens(benchmark.select("item_id", text_of().alias("text")).distinct()).filter(F.size("template") >= least)
    size = F.least(F.size("template"), F.lit(settings.window))
    items = items.select("item_id", "values", "template", "named", size.alias("size"), (F.size("template") - size + 1).alias("item_windows"))

    def cut(column: str, at: Column) -> Column:
        return F.slice(column, at + 1, F.col("size"))

    def typed(column: str, at: Column) -> Column:
        literals = F.size(F.filter(cut(column, at), lambda x: ~x.startswith("ǀ")))
        return (literals >= settings.least_literals) & (F.col("size") >= settings.least_tokens)

    places = F.sequence(F.lit(0), F.col("item_windows") - 1)
    items = items.withColumns({f"{x}_windows": F.size(F.filter(places, lambda at: typed(c, at))) for x, c in (("typed", "template"), ("free", "named"))})
    at = items.select("*", F.explode(places).alias("item_at"))
    at = at.withColumns({"typed": typed("template", F.col("item_at")), "free": typed("named", F.col("item_at"))})
    by_name = F.col("free") & F.array_contains(cut("named", F.col("item_at")), NAME)
    ways = F.array_compact(F.array(F.when(F.col("typed"), TEMPLATE).otherwise(EXACT), F.when(by_name, NAMES)))
    at = at.withColumn("way", F.explode(ways))
    rows = at.select(
        "item_id",
        "item_windows",
        "typed_windows",
        "free_windows",
        "item_at",
        "size",
        "typed",
        "free",
        "way",
        _of_way(*[cut(c, F.col("item_at")) for c in ("template", "named", "values")]).alias("item_template"),
        cut("values", F.col("item_at")).alias("item_values"),
    )
    return rows.withColumn("hash", F.xxhash64("way", "item_template"))


def _found(tokens: DataFrame, windows: DataFrame, settings: DecontaminationSettings) -> DataFrame:
    """Document windows whose hash is one of the benchmark's. Windows are looked up without the texts they
    stand in; those found, as many as a text has windows at most, meet their text's tokens again."""
    wanted = windows.select("size", "hash").distinct()
    counts = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}
    out = None
    for size in sorted(counts) or [settings.window]:
        hashes = wanted.filter(F.col("size") == size).select("hash")
        small = counts.get(size, 0) <= settings.broadcast_hashes
        rows = _windows(tokens, size, settings).join(F.broadcast(hashes) if small else hashes.hint("merge"), "hash", "left_semi")
        rows = rows.select("doc_id", "text_hash", F.struct("hash", "way", "at", F.lit(size).alias("size")).alias("place"))
        out = rows if out is None else out.unionByName(rows)
    out = out.groupBy(F.col("doc_id").alias("in_id"), F.col("text_hash").alias("in_hash")).agg(F.collect_set("place").alias("places"))
    out = tokens.join(out, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("text_hash") == F.col("in_hash")))

    def cut(x: Column) -> Column:
        template, named, values = (F.slice(c, x["at"] + 1, x["size"]) for c in ("template", "named", "values"))
        text = F.when(x["way"] == EXACT, values).when(x["way"] == NAMES, named).otherwise(template)
        return F.struct(x["hash"].alias("hash"), x["way"].alias("way"), x["at"].alias("at"), text.alias("doc_template"), values.alias("doc_values"))

    return out.select("doc_id", "text_hash", F.inline(F.transform("places", cut)))


def matches(documents: DataFrame, benchmark: DataFrame, settings: DecontaminationSettings | None = None) -> DataFrame:
    """``doc_id, text_hash, item_id, matched_windows, item_windows, same_values`` of each contaminated
    document and item. Rows that repeat id and text count once. Null texts count as empty, null
    item ids and null doc ids are kept as they are.

    Coverages are over all windows, over those with searched templates and over those whose templates are searched
    with typed names as well. The largest counts, and both counts of windows are its own."""
    settings = settings or DecontaminationSettings()
    windows = write_through(_anchored(_benchmark_windows(benchmark, settings)), "benchmark-windows")
    texts = _with_anchors(documents.select("doc_id", text_of().alias("text")), windows, settings)
    tokens = write_through(_tokens(texts).select("doc_id", "text_hash", "values", "template", "named"), "anchored-tokens")
    met = _found(tokens, windows, settings).join(windows, ["hash", "way"]).filter(F.col("doc_template") == F.col("item_template"))
    slots = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.col("size")),
            lambda i: F.when(
                F.element_at("item_template", i).startswith("ǀ"),
                F.struct(
                    F.element_at("item_template", i).alias("kind"),
                    F.element_at("item_values", i).alias("was"),
                    F.element_at("doc_values", i).alias("now"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    item = ["doc_id", "text_hash", "item_id", "item_windows", "typed_windows", "free_windows"]
    place = F.struct("item_at", "typed", "free")
    # An alignment has at most as many windows and slots as the item, so these sets are small.
    aligned = met.groupBy(*item, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.when(F.col("way") != NAMES, place)).alias("places"),
        F.collect_set(F.when(F.col("way") == NAMES, place)).alias("by_name"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"),
    )
    # Names keep who is who; numbers may become equal or different by chance, so they are free.
    names = F.filter("slots", lambda x: x["kind"] == NAME)
    one_way, other_way = (F.size(F.array_distinct(F.transform(names, f))) for f in (lambda x: x["was"], lambda x: x["now"]))
    aligned = aligned.withColumn("one_to_one", (one_way == F.size(names)) & (other_way == F.size(names)))
    used = F.when(F.col("one_to_one"), F.concat("places", "by_name")).otherwise(F.col("places"))
    covered = (
        aligned.withColumn("places", used)
        .filter(F.size("places") > 0)
        .groupBy(*item)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.bool_or(F.forall("slots", lambda x: x["was"] == x["now"])).alias("same_values"),
        )
    )

    def way(matched: Column, of: str) -> Column:
        n = F.size(matched).cast("long")
        return F.struct(F.coalesce(F.try_divide(n, F.col(of)), F.lit(0.0)).alias("share"), n.alias("matched"), F.col(of).alias("of"))

    typed, free = F.filter("places", lambda x: x["typed"]), F.filter("places", lambda x: x["free"])
    best = F.greatest(way(F.col("places"), "item_windows"), way(typed, "typed_windows"), way(free, "free_windows"))
    return (
        covered.withColumn("best", best)
        .filter(F.col("best.matched") >= F.lit(settings.coverage) * F.col("best.of"))
        .select("doc_id", "text_hash", "item_id", F.col("best.matched").alias("matched_windows"), F.col("best.of").alias("item_windows"), "same_values")
    )


def judged(documents: DataFrame, benchmark: DataFrame, settings: DecontaminationSettings | None = None) -> DataFrame:
    """One row for each row of ``documents``, repeated ones too: ``doc_id, contaminated, items`` (how
    many items it contains), and of the item it covers best (the smallest id of several)
    ``item_id, coverage, same_values``; these are null for clean documents."""
    share = F.col("matched_windows") / F.col("item_windows")
    best = F.struct((-share).alias("less"), F.col("item_id").isNull().alias("last"), "item_id", share.alias("coverage"), "same_values")
    worst = write_through(
        matches(documents, benchmark, settings)
        .groupBy("doc_id", "text_hash")
        .agg(F.count("*").alias("items"), F.min(best).alias("best"))
        .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), "items", "best.item_id", "best.coverage", "best.same_values"),
        "contaminated",
    )
    rows = documents.select("doc_id", F.xxhash64(text_of()).alias("text_hash"))
    met = rows.join(worst, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_hash") == F.col("bad_hash")), "left")
    return met.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit(0)).cast("long").alias("items"),
        "item_id",
        "coverage",
        "same_values",
    )


def clean(documents: DataFrame, benchmark: DataFrame, settings: DecontaminationSettings | None = None) -> DataFrame:
    """The rows of ``documents`` without a benchmark item, all columns."""
    bad = matches(documents, benchmark, settings).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = write_through(bad, "contaminated")
    rows = documents.select(F.struct("*").alias("row"))  # own columns of any name stay apart
    own_hash = F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (own_hash == F.col("bad_hash")), "left_anti").select("row.*")
