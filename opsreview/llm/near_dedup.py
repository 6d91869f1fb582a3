"""Near-duplicate groups from an inverted join of MinHash signature coordinates.

1. Every whole text becomes its set of hashed word shingles and a signature of K least
   hashes. Documents with equal sets form a class; from here on classes are joined.
2. Classes are posted under (coordinate, value) pairs. A pair of classes at the wanted
   similarity agrees in at least T of K coordinates (up to a miss chance below one in a
   million), so it meets in one of each class's first K - T + 1 posts, whatever the common
   order of the posts. Long lists come last in that order: they are skipped when pairs are
   generated and only count in the comparison of whole signatures.
3. No list is expanded into all its pairs. Its most central class leads, and every
   member is compared with the leader: first by collisions, then on the full sets.
   Members that end up in the leader's component need no further comparison with each other.
4. The others are compared, on the full sets, with all members that share the leader. There a
   set is written as its difference from the leader's, which is short for near
   copies and makes a tile of a few hundred members one matrix product. Pairs that are
   already connected are skipped.

Confirmed links give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.llm.components import components
from opsreview.llm.tables import releasing, remembered, stretches, text_of
from opsreview.session import write_through


@dataclass(frozen=True)
class NearSettings:
    """``percent``: least Jaccard similarity of shingle sets in percent; ``miss``: chance that a pair at
    that similarity collides too seldom; ``tile_rows``/``tile_items``: size of a tile; ``broadcast_rows`` and
    ``broadcast_lists``: up to so many rows of hashes (24 or 40 bytes each) go to every task."""

    shingle: int = 5
    percent: int = 80
    coordinates: int = 64
    miss: float = 1e-6
    tile_rows: int = 512
    tile_items: int = 1_000_000
    broadcast_rows: int = 400_000
    broadcast_lists: int = 3_000_000
    cache_words: int = 300_000
    seed: int = 3


def least_collisions(settings: NearSettings) -> int:
    """The largest T with P(fewer than T of K coordinates agree) <= miss at the wanted similarity."""
    k, p = settings.coordinates, settings.percent / 100
    below, t = 0.0, 0
    while t < k:
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > settings.miss:
            break
        t += 1
    return max(1, t)


def shingle_hashes(text: str, width: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ``words`` remembers word hashes."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    for w in set(parts):
        if w not in words:
            words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _least(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's hash over a set; long sets piece by piece."""
    low = (hashes >> np.uint64(16)).astype(np.uint64) ^ hashes
    least = None
    for i in range(0, len(low), 4096):
        mixed = low[i : i + 4096, None] * factors + offsets
        own = (mixed >> np.uint64(33)).min(0)
        least = own if least is None else np.minimum(least, own)
    return least.astype(np.int32)


def _remember(words: dict, most: int) -> None:
    if len(words) > most:
        words.clear()


def _signing(settings: NearSettings):
    draws = np.random.default_rng(settings.seed)
    factors = draws.integers(1, 1 << 63, settings.coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = draws.integers(0, 1 << 63, settings.coordinates, np.uint64)

    @releasing
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words: dict[bytes, int] = remembered("word-hashes", 0, dict)
        for batch in batches:
            for start, stop in stretches(batch["text"].tolist()):
                part = batch.iloc[start:stop]
                sizes, prints, signs = [], [], []
                for text in part["text"]:
                    _remember(words, settings.cache_words)
                    hashes = shingle_hashes(text, settings.shingle, words)
                    sizes.append(len(hashes))
                    prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    signs.append(_least(hashes, factors, offsets) if len(hashes) else None)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "known": part["known"].array, "row_hash": part["row_hash"].array, "n": sizes, "fp": prints, "sig": signs})

    return sign


def _set_making(settings: NearSettings):
    @releasing
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words: dict[bytes, int] = {}
        for batch in batches:
            for start, stop in stretches(batch["text"].tolist()):
                part = batch.iloc[start:stop]
                out = []
                for text, fp in zip(part["text"], part["fp"], strict=True):
                    _remember(words, settings.cache_words)
                    hashes = shingle_hashes(text, settings.shingle, words).tobytes()
                    if xxhash.xxh3_128_digest(hashes) == bytes(fp):
                        out.append((bytes(fp), hashes))
                yield pd.DataFrame(out, columns=["fp", "items"])

    return make


def _hashed(documents: DataFrame) -> DataFrame:
    known = F.col("doc_id").isNotNull().alias("known")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), known, text_of().alias("text"))
    return rows.withColumn("row_hash", F.xxhash64("doc_id", "known", "text"))


def _small(written: DataFrame, bound: int) -> DataFrame:
    """For a join: sent to every task while it has no more rows than the bound."""
    return F.broadcast(written) if written.count() <= bound else written


def _posts(classes: DataFrame, settings: NearSettings) -> DataFrame:
    """``token, fp, weight``: each class under those of its first K - T + 1 coordinate values, in order of
    list length, that it shares with others; a list of one gives no pair. ``weight`` is how long the
    class's lists are altogether."""
    prefix = settings.coordinates - least_collisions(settings) + 1
    spread = classes.repartition("fp").select("fp", F.posexplode("sig").alias("at", "value"))
    tokens = spread.select("fp", F.xxhash64("at", "value").alias("token"))
    shared = write_through(tokens.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1"), "shared-lists")
    ordered = tokens.join(_small(shared, settings.broadcast_lists), "token", "left").groupBy("fp").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("length", F.lit(0)).alias("length"), "token"))), 1, prefix).alias("posts"),
        F.sum("length").alias("weight"),
    )
    posts = ordered.filter("weight is not null").select("fp", "weight", F.explode("posts").alias("post"))
    return posts.filter("post.length > 1").select("fp", "weight", "post.token")


def _stars(classes: DataFrame, settings: NearSettings) -> DataFrame:
    """``leader, fp, crowd``: members of posting lists with their list's leader. ``crowd`` says whether a
    third class shares the list; pairs of lists of two stay only if they collide often enough."""
    posts = write_through(_posts(classes, settings), "posts")
    lead = posts.groupBy("token").agg(F.count("*").alias("length"), F.min(F.struct((-F.col("weight")).alias("less"), "fp")).alias("first")).filter("length > 1")
    pairs = posts.join(lead.select("token", "length", F.col("first.fp").alias("leader")), "token").filter("fp <> leader")
    pairs = write_through(pairs.groupBy("leader", "fp").agg(F.bool_or(F.col("length") > 2).alias("crowd")), "stars")
    signs = classes.select("fp", "sig")
    met = pairs.filter("not crowd").join(signs, "fp").join(signs.select(F.col("fp").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
    collisions = F.aggregate(F.zip_with("sig", "leader_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    near = met.filter(collisions >= least_collisions(settings)).select("leader", "fp", "crowd")
    return write_through(near.unionByName(pairs.filter("crowd")), "star-pairs")


def _sets(documents: DataFrame, rows: DataFrame, wanted: DataFrame, settings: NearSettings) -> DataFrame:
    """``fp, items`` of the wanted classes, from one text of each."""
    one = write_through(rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("row_hash").alias("row_hash")), "set-rows")
    texts = _hashed(documents).join(_small(one, settings.broadcast_rows), "row_hash").select("row_hash", "fp", "text")
    if not rows.groupBy("row_hash").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        texts = texts.dropDuplicates(["row_hash"])
    return write_through(texts.mapInPandas(_set_making(settings), "fp binary, items binary"), "sets")


def _comparing(percent: int):
    @releasing
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by leader and place, each leader before its members."""
        lead, items = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = np.frombuffer(row.items, np.uint64)
                if row.leads:
                    lead, items = bytes(row.leader), own
                    continue
                assert lead == bytes(row.leader)
                at = np.minimum(np.searchsorted(items, own), len(items) - 1)
                shared = items[at] == own
                both = int(shared.sum())
                linked = 100 * both >= percent * (len(own) + len(items) - both)
                missing = np.ones(len(items), bool)
                missing[at[shared]] = False
                # The difference from the leader: what it lacks, as a mark on the leader's place, and what it adds.
                differs = np.concatenate([np.flatnonzero(missing).astype(np.uint64), own[~shared] | np.uint64(1 << 63)])
                out.append((lead, bytes(row.fp), len(items), len(own), int(missing.sum()), bool(linked), differs.tobytes() if row.crowd else b""))
            yield pd.DataFrame(out, columns=["leader", "fp", "n_leader", "n", "missing", "linked", "differs"])

    return compare


def _compared(stars: DataFrame, sets: DataFrame, settings: NearSettings) -> DataFrame:
    """Every star pair on the full sets. A leader with many members is compared in several places."""
    stars = _small(stars, settings.broadcast_rows)
    members = stars.join(sets, "fp")
    load = stars.join(sets.select("fp", (F.length("items") / 8).alias("size")), "fp").groupBy("leader").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    places = F.ceil(F.greatest(F.col("size") / settings.tile_items, F.col("n") / settings.tile_rows)).cast("int")
    load = write_through(load.select("leader", F.greatest(places, F.lit(1)).alias("places")), "star-loads")
    load = _small(load, settings.broadcast_rows)
    placed = members.join(load, "leader").withColumn("place", F.pmod(F.xxhash64("fp"), F.col("places")))
    leaders = load.join(sets.withColumnRenamed("fp", "leader"), "leader").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    columns = ["leader", "place", "leads", "fp", "crowd", "items"]
    every = placed.withColumn("leads", F.lit(False)).select(columns).unionByName(
        leaders.withColumns({"place": F.col("place").cast("long"), "leads": F.lit(True), "fp": F.col("leader"), "crowd": F.lit(False)}).select(columns)
    )
    ranged = every.repartition("leader", "place").sortWithinPartitions("leader", "place", F.col("leads").desc())
    schema = "leader binary, fp binary, n_leader long, n long, missing long, linked boolean, differs binary"
    return write_through(ranged.mapInPandas(_comparing(settings.percent), schema), "compared")


def _links_of_tile(rows: list, percent: int, slab: int = 4096) -> list[tuple[bytes, bytes]]:
    """Links between members of different components: at most as many as components are joined."""
    n = len(rows)
    found = [np.frombuffer(r.differs, np.uint64) for r in rows]
    owner = np.repeat(np.arange(n), [len(x) for x in found])
    flat = np.concatenate(found) if n else np.zeros(0, np.uint64)
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(counts > 1) - 1  # only what two members have in common counts
    keep = counts[at] > 1
    at, owner = common[at[keep]], owner[keep]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = int(at[-1]) + 1 if len(at) else 0
    for start in range(0, width, slab):
        lo, hi = np.searchsorted(at, [start, start + slab])
        dense = np.zeros((n, slab), np.float32)
        dense[owner[lo:hi], at[lo:hi] - start] = 1
        shared += dense @ dense.T
    size = np.array([r.n for r in rows], np.int64)
    missing = np.array([r.missing for r in rows], np.int64)
    both = rows[0].n_leader - missing[:, None] - missing[None, :] + shared.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = root(bytes(rows[a].component)), root(bytes(rows[b].component))
        if x != y:
            group[x] = y
            out.append((bytes(rows[a].fp), bytes(rows[b].fp)))
    return out


def _tiling(percent: int):
    @releasing
    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = (bytes(row.leader), row.left, row.right)
                if own != key:
                    if len(held) > 1:
                        out += _links_of_tile(held, percent)
                    key, held = own, []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"])
        if len(held) > 1:
            yield pd.DataFrame(_links_of_tile(held, percent), columns=["a", "b"])

    return tiles


def _left_over(compared: DataFrame, groups: DataFrame, settings: NearSettings) -> DataFrame:
    """Links between members of one leader that the leader does not connect.

    Members outside the leader's component (``out``) meet each other and the members inside it;
    members inside it do not meet each other. Both kinds are dealt into chunks, and a pair of
    chunks is a tile.
    """
    named = groups.withColumnsRenamed({"node": "fp"})
    rows = compared.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lead = groups.select(F.col("node").alias("leader"), F.col("component").alias("lead_component"))
    rows = rows.filter(F.length("differs") > 0).join(lead, "leader", "left")
    rows = write_through(rows.withColumn("out", F.col("component") != F.coalesce("lead_component", "leader")), "tile-rows")

    def chunks(side):
        items, n = F.sum(F.when(side, F.length("differs") / 8)), F.count_if(side)
        return F.greatest(F.ceil(items / settings.tile_items), F.ceil(n / settings.tile_rows), F.lit(1)).cast("int")

    load = rows.groupBy("leader").agg(F.count_if("out").alias("n_out"), F.count("*").alias("n"), chunks(F.col("out")).alias("outs"), chunks(~F.col("out")).alias("ins"))
    load = write_through(load.filter("n_out > 0 and n > 1").select("leader", "outs", "ins"), "tile-loads")
    met = rows.join(load, "leader")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    met = met.withColumn("own", own)
    # A tile is (chunk of out, other chunk): chunks of out are numbered from 0, the others from -1 down.
    sides = F.sequence(F.lit(0), F.col("outs") - 1)
    inside = F.transform(sides, lambda i: F.struct(i.alias("left"), (-F.col("own") - 1).alias("right")))
    outside = F.concat(
        F.transform(sides, lambda i: F.struct(F.least(i, F.col("own")).alias("left"), F.greatest(i, F.col("own")).alias("right"))),
        F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda i: F.struct(F.col("own").alias("left"), (-i - 1).alias("right"))),
    )
    tiled = met.withColumn("tile", F.explode(F.when(F.col("out"), outside).otherwise(inside))).select("leader", "tile.left", "tile.right", "fp", "component", "n_leader", "n", "missing", "differs")
    ranged = tiled.repartition("leader", "left", "right").sortWithinPartitions("leader", "left", "right", "fp")
    return write_through(ranged.mapInPandas(_tiling(settings.percent), "a binary, b binary"), "tile-links")


def grouped(documents: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``documents``, repeated ones too.

    A text without words, or null, has an empty set and is linked with nothing. ``component_id`` is the
    smallest id that is reachable; rows without an id can be members but do not give it, and a group
    that has no id at all has a null one and keeps all its rows.
    """
    return _grouped(documents, settings or NearSettings()).drop("row_hash")


def _grouped(documents: DataFrame, settings: NearSettings) -> DataFrame:
    schema = "doc_id long, known boolean, row_hash long, n long, fp binary, sig array<int>"
    signed = write_through(_hashed(documents).mapInPandas(_signing(settings), schema), "signatures")
    classes = write_through(signed.filter("n > 0").groupBy("fp").agg(F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    rows = signed.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "row_hash", "n", "fp")
    stars = _stars(classes, settings)
    wanted = stars.select("fp").union(stars.select("leader")).distinct()
    sets = _sets(documents, rows.filter("n > 0"), wanted, settings)
    compared = _compared(stars, sets, settings)
    links = compared.filter("linked").select(F.col("leader").alias("a"), F.col("fp").alias("b"))
    groups = components(links)
    more = _left_over(compared, groups, settings)
    if not more.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(more))
    least = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    least = write_through(least.withColumn("component", F.coalesce("component", "fp")), "class-ids")
    joined = least.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    by_class = write_through(least.join(joined, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "class-components")
    out = rows.join(by_class, "fp", "left").select(
        "row_hash", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(documents: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """One row of each group, with all columns: that of the smallest id. Of rows that repeat an id one stays;
    rows without an id stay if their group has none."""
    kept = _grouped(documents, settings or NearSettings()).filter("kept").select("row_hash", "doc_id").distinct()
    kept = write_through(kept, "near-kept")
    rows = documents.select(F.struct("*").alias("row"))  # own columns of any name stay apart
    known = F.col("row.doc_id").isNotNull()
    own_hash = F.xxhash64(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)), known, F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    stay = rows.withColumn("row_hash", own_hash).join(kept.select("row_hash"), "row_hash", "left_semi")
    named = stay.filter(known).withColumn("id", F.col("row.doc_id"))
    if not documents.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        named = named.dropDuplicates(["id"])
    return named.select("row.*").unionByName(stay.filter(~known).select("row.*"))
