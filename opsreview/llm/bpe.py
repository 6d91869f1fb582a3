"""Byte-level BPE in recursive DuckDB queries, one small database for each partition.

Texts are cut into the matches of the split pattern. A Python worker keeps the pieces it has met; pieces that
are new become rows of token positions, starting from single bytes. A recursive query joins
neighbouring positions with the merge table and contracts the leftmost pair of the least rank of each
piece, until no piece has a pair left. A text's ids are those of its pieces in order. Decoding joins ids
with the vocabulary and puts their bytes together by an ordered aggregation.

Long pieces are first cut where no entry of the vocabulary occurs across; no merge can cross there. What
remains long contracts all pairs of the least rank in one step where that is the same as one after
the other: where no token made with the new one has a lesser rank.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.llm.tables import remembered, text_of


@dataclass(frozen=True)
class BpeSettings:
    """``ranks``: path of a rank file, read on the driver (null: the public one for many languages); ``pattern``:
    what a text is split by; ``characters``, ``ids``: how much is encoded or decoded at once; ``pieces``: how
    many a Python worker remembers; ``long_piece``: bytes above which a piece is cut, at most 200; ``memory``: of a task's database."""

    ranks: str | None = None
    pattern: str | None = None
    characters: int = 3_000_000
    ids: int = 1_000_000
    pieces: int = 500_000
    long_piece: int = 64
    memory: str = "600MB"


@dataclass(frozen=True)
class Merges:
    """Tokens by id, and the merge table: ids of the left and right part, the id of the whole (its rank), and
    whether pairs of that rank must be contracted one at a time. ``adapted``: see ``adapted_pattern``."""

    tokens: dict[bytes, int]
    pattern: str
    adapted: tuple[str, str]
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    single: np.ndarray

    @property
    def key(self) -> int:
        return zlib.crc32(b"".join(self.tokens), zlib.crc32(self.pattern.encode() + self.rank.tobytes()))


def merges(settings: BpeSettings) -> Merges:
    path, pattern = settings.ranks, settings.pattern
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        tokens = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    rows, single = [], set()
    for token, rank in tokens.items():
        for k in range(1, len(token)):
            a, b = tokens.get(token[:k]), tokens.get(token[k:])
            single.update(part for part in (a, b) if part is not None and part > rank)
            if a is not None and b is not None:
                rows.append((a, b, rank))
    left, right, rank = np.array(rows, np.int64).reshape(-1, 3).T
    return Merges(tokens, pattern, adapted_pattern(pattern), left, right, rank, np.isin(rank, list(single)))


#: Token rows of pieces as ``k``, piece number and position in it, and ``id``. Each round joins a row with the next position and with
#: the merge table, finds the leftmost pair of the least rank of each piece and contracts it; later positions move up.
_SHORT = """
WITH RECURSIVE t(k, id, done) AS (
  SELECT w::BIGINT << 8 | pos, id, false FROM fresh
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT a.k, a.id, m.whole
     FROM (SELECT k, id FROM t WHERE NOT done) a
     LEFT JOIN (SELECT k - 1 AS k, id FROM t WHERE NOT done) b ON b.k = a.k
     LEFT JOIN merges m ON m.pair = a.id::BIGINT << 32 | b.id)
   SELECT CASE WHEN k & 255 > best THEN k - 1 ELSE k END, CASE WHEN k & 255 = best THEN whole ELSE id END, best IS NULL
   FROM (
     SELECT p.*, b.best & 255 AS best FROM pairs p
     LEFT JOIN (SELECT k >> 8 AS w, min(whole::BIGINT << 8 | (k & 255)) AS best FROM pairs WHERE whole IS NOT NULL GROUP BY ALL) b ON b.w = p.k >> 8)
   WHERE NOT coalesce(k & 255 = best + 1, false)))
SELECT (k >> 8)::INT AS w, (k & 255)::INT AS pos, id FROM t WHERE done ORDER BY k"""

#: The same for long pieces: rows are replaced in place (-1: gone), pieces at rest are left alone, and
#: of neighbouring pairs of the least rank every other one is contracted.
_LONG = """
WITH RECURSIVE t(w, pos, id) USING KEY (w, pos) AS (
  SELECT w, pos, id FROM fresh
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN whole ELSE -1 END FROM (
    SELECT w, pos, whole, hit, lag(hit) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT w, pos, whole, coalesce(least_ AND CASE WHEN single THEN place = min(CASE WHEN least_ THEN place END) OVER (PARTITION BY w)
        ELSE (place - min(place) OVER (PARTITION BY w, least_, island)) % 2 = 0 END, false) AS hit
      FROM (
        SELECT *, place - row_number() OVER (PARTITION BY w, least_ ORDER BY pos) AS island FROM (
          SELECT p.w, p.pos, p.place, m.whole, m.single, coalesce(m.whole = min(m.whole) OVER (PARTITION BY p.w), false) AS least_
          FROM (SELECT w, pos, id, lead(id) OVER o AS following, row_number() OVER o AS place
                FROM recurring.t WHERE id >= 0 AND w IN (SELECT w FROM t) WINDOW o AS (PARTITION BY w ORDER BY pos)) p
          LEFT JOIN merges m ON m.pair = p.id::BIGINT << 32 | p.following))))
  WHERE hit OR coalesce(gone, false))
SELECT w, pos, id FROM t WHERE id >= 0 ORDER BY w, pos"""


def _characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _in_class(name: str) -> set[str]:
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(bytes(single.encode_ordinary(_characters())).decode())


def _ranges(characters: set[str]) -> str:
    codes = np.array(sorted(map(ord, characters)), np.int64)
    starts = codes[np.diff(codes, prepend=-2) > 1]
    ends = codes[np.diff(codes, append=1 << 30) > 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def adapted_pattern(pattern: str) -> tuple[str, str]:
    """The pattern for ``regex`` with letters, digits and blanks as tiktoken knows them, and the characters on which the
    two differ: their tables may be of different Unicode versions."""
    import regex

    differing: set[str] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        if name in pattern:
            theirs, ours = _in_class(name), set(regex.findall(name, _characters()))
            if theirs != ours:
                differing |= theirs ^ ours
                out = _ranges(ours - theirs)
                pattern = pattern.replace(name, "[" + (f"[{name}--[{out}]]" if out else name) + _ranges(theirs - ours) + "]")
    return pattern, f"[{_ranges(differing)}]" if differing else ""


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Matches of the pattern as tiktoken finds them; only texts with characters of which the tables differ need the adapted one."""

    def __init__(self, table: Merges):
        import regex

        adapted, differing = table.adapted
        self.plain, self.adapted = regex.compile(table.pattern), regex.compile(adapted, regex.V1)
        self.differing = regex.compile(differing) if differing else None
        self.beyond_latin = not (self.differing and self.differing.search("".join(map(chr, range(256)))))

    def pieces(self, text: str) -> list[str]:
        if self.differing is None or text.isascii() or (self.beyond_latin and _is_latin(text)):
            return self.plain.findall(text)
        return (self.adapted if self.differing.search(text) else self.plain).findall(text)


class Encoder:
    """The database of one task: the merge table, the vocabulary, and the pieces met so far."""

    def __init__(self, table: Merges, settings: BpeSettings):
        import duckdb

        self.table, self.settings = table, settings
        self.splitter = Splitter(table)
        self.known: dict[str, int] = {}
        #: Ids of the pieces met so far, and where each piece's begin.
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.automaton = None
        self.bytes = np.array([table.tokens.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": settings.memory, "temp_directory": ""})
        self._create("merges", pair=table.left << 32 | table.right, whole=table.rank.astype(np.int32), single=table.single)
        ids = np.array(list(table.tokens.values()), np.int32)
        self._create("vocabulary", id=ids, token=pa.array(list(table.tokens), pa.binary()))

    def close(self) -> None:
        self.db.close()

    def _create(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, sql: str, **columns) -> pa.Table:
        self.db.register("fresh", pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister("fresh")
        return out

    def _contracted(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, byte offset and id of the tokens of each word."""
        lengths = np.array(list(map(len, words)), np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.int32)
        ids = self.bytes[data]
        if len(ids) and ids.min() < 0:
            raise ValueError("the rank file lacks single bytes that the texts have")
        rows = self._rows(sql, w=w, pos=pos, id=ids)
        return tuple(rows[c].to_numpy() for c in ("w", "pos", "id"))

    def uncrossed(self, piece: bytes) -> list[int]:
        """Offsets inside ``piece`` across which no entry of the vocabulary occurs."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token in self.table.tokens:
                if len(token) > 1:
                    self.automaton.add_word(token.decode("latin-1"), len(token))
            self.automaton.make_automaton()
        change = np.zeros(len(piece) + 1, np.int64)
        for end, length in self.automaton.iter(piece.decode("latin-1")):  # crosses end - length + 2 to end
            change[end - length + 2] += 1
            change[end + 1] -= 1
        return (np.flatnonzero(np.cumsum(change[:-1])[1:] == 0) + 1).tolist()

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        data = [p.encode() for p in pieces]
        ranks = list(map(self.table.tokens.get, data))
        whole = [(w, rank) for w, rank in enumerate(ranks) if rank is not None]
        longest = self.settings.long_piece
        short = [w for w, rank in enumerate(ranks) if rank is None and len(data[w]) <= longest]
        words: dict[str, tuple[list[bytes], list[int], list[int]]] = {_SHORT: ([data[w] for w in short], short, [0] * len(short)), _LONG: ([], [], [])}
        for w, rank in enumerate(ranks):
            if rank is None and len(data[w]) > longest:
                cuts = [0, *self.uncrossed(data[w]), len(data[w])]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own, ws, at = words[_LONG if b - a > longest else _SHORT]
                    own.append(data[w][a:b])
                    ws.append(w)
                    at.append(a)
        for sql, (own, ws, at) in words.items():
            if own:
                w, pos, ids = self._contracted(own, sql)
                found.append((np.array(ws, np.int64)[w], pos + np.array(at, np.int64)[w], ids))
        w, ids = np.array(whole, np.int64).reshape(-1, 2).T
        found.append((w, np.zeros(len(w), np.int64), ids.astype(np.int32)))
        w, pos, ids = map(np.concatenate, zip(*found, strict=True))
        ids = ids[np.lexsort((pos, w))]
        ends = self.starts[-1] + np.cumsum(np.bincount(w, minlength=len(pieces)))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, ends])

    def _forget_all_but(self, pieces: list[str]) -> None:
        """Keep what is known of these pieces only: common ones are among those just met."""
        kept = [p for p in pieces if p in self.known]
        old = np.array([self.known[p] for p in kept], np.int64)
        lengths = np.diff(self.starts)[old]
        self.ids = self.ids[_spread(self.starts[old], lengths)]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.known = dict(zip(kept, range(len(kept)), strict=True))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        found = [self.splitter.pieces(t) for t in texts]
        counts = np.array(list(map(len, found)), np.int64)
        coded = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        del found
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > self.settings.pieces:
            self._forget_all_but(distinct)
        if new:
            self._learn(new)
        pieces = np.array([self.known[p] for p in distinct], np.int64)[coded.indices.to_numpy()]
        lengths = np.diff(self.starts)[pieces]
        ids = self.ids[_spread(self.starts[pieces], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        ends = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        row = self._rows(
            "SELECT list(token ORDER BY place) AS tokens, count(token) AS n FROM fresh LEFT JOIN vocabulary USING (id)",
            place=np.arange(len(values), dtype=np.int32),
            id=values,
        )
        if row["n"][0].as_py() != len(values):
            raise ValueError("ids that the vocabulary does not have")
        tokens = row["tokens"].combine_chunks().flatten().cast(pa.large_binary())
        # All bytes lie one after the other in the list's buffer; a text ends where its last token does.
        _, offsets, data = tokens.buffers() if len(tokens) else (None, pa.py_buffer(np.zeros(1, np.int64)), pa.py_buffer(b""))
        at = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at[ends]), data])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as the length says."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows that come to about ``most`` together; a larger row is a stretch of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(documents: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, one row for each row of ``documents``.

    A null or empty text has no ids; repeated rows and null doc_ids come back as they are, and other columns are
    left out. Text that looks like a special token is ordinary text.
    """
    settings = settings or BpeSettings()
    table = merges(settings)
    shared, key = documents.sparkSession.sparkContext.broadcast(table), table.key  # as large as the rank file: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = remembered("bpe", (key, settings), lambda: Encoder(shared.value, settings))
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
            for start, stop in _stretches(sizes, settings.characters):
                part = batch.slice(start, stop - start)
                ids = encoder.encode(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for. A null or empty list gives no bytes; an id
    that the vocabulary lacks, or a null among the ids, is an error."""
    settings = settings or BpeSettings()
    table = merges(settings)
    shared, key = tokens.sparkSession.sparkContext.broadcast(table), table.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = remembered("bpe", (key, settings), lambda: Encoder(shared.value, settings))
        for batch in batches:
            sizes = pc.list_value_length(batch["ids"]).to_numpy(zero_copy_only=False)
            for start, stop in _stretches(sizes, settings.ids):
                part = batch.slice(start, stop - start)
                ids = part["ids"]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[start:stop])]), pa.int32()), ids.flatten())
                if ids.flatten().null_count:
                    raise ValueError("nulls among ids")
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], encoder.decode(ids).cast(pa.binary())], ["doc_id", "ids", "decoded"])

    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(documents: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids (decimal, joined by commas) and of
    the bytes decoded from them."""
    found = decoded(encoded(documents, settings), settings)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
