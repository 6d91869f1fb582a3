"""Stored datasets: a snapshot names all files of all datasets, and imports become visible together with it.

An import writes its rows, the Bloom filters of their keys and its row of the import log to folders of
their own, and then publishes the next snapshot, which names them. Publishing is refused if another writer has
taken the number; the import is then checked again against the newer state. So two appends of the same key
cannot both pass, several datasets loaded together appear together or not at all, and a failed or rejected import
changes nothing but the log.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsreview.operators import keyfilter
from opsreview.operators.keyfilter import KeyFilter
from opsreview.operators.validate import Validation, validate
from opsreview.schemas import DATASETS, Dataset
from opsreview.sources.files import read_batch
from opsreview.sources.snapshots import Snapshots, SnapshotTaken
from opsreview.sources.tables import Tables

LOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("import_id", "dataset_type", "mode", "status")]
    + [T.StructField(n, T.TimestampType()) for n in ("received_at", "completed_at")]
    + [T.StructField(n, T.LongType()) for n in ("row_count", "accepted_count", "rejected_count", "error_count")]
    + [T.StructField(n, T.StringType()) for n in ("summary", "path")]
)


def dataset_types(spark: SparkSession) -> DataFrame:
    """The accepted dataset types with their required and optional columns."""
    rows = [(d.name, d.required_columns, d.optional_columns) for d in DATASETS.values()]
    return spark.createDataFrame(rows, "dataset_type string, required_columns array<string>, optional_columns array<string>")


_FILTER = T.StructType([T.StructField(n, T.LongType()) for n in ("blocks", "block")] + [T.StructField(w, T.LongType()) for w in keyfilter.WORDS])


def _keys(dataset: Dataset) -> tuple[str, ...]:
    """Columns whose stored values are looked up."""
    return (dataset.key, *dataset.unique)


class State:
    """One snapshot as tables. Its manifest names, for each dataset, parts of ``path``, ``rows``, ``filters`` (column
    to path) and their ``blocks``, and the parts of the import log."""

    def __init__(self, spark: SparkSession, manifest: dict) -> None:
        self.spark = spark
        self.manifest = manifest

    def parts(self, dataset_type: str) -> list[dict]:
        return self.manifest["datasets"].get(dataset_type, [])

    def rows(self, dataset_type: str) -> int:
        return sum(p["rows"] for p in self.parts(dataset_type))

    def log(self) -> DataFrame:
        paths = self.manifest["imports"]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def table(self, dataset_type: str) -> DataFrame:
        struct = DATASETS[dataset_type].struct
        paths = [p["path"] for p in self.parts(dataset_type)]
        return self.spark.read.schema(struct).parquet(*paths) if paths else self.spark.createDataFrame([], struct)

    def references(self, dataset_type: str) -> dict[str, DataFrame]:
        return {f.references: self.table(f.references) for f in DATASETS[dataset_type].fields if f.references}

    def filters(self, dataset_type: str) -> dict[tuple[str, str], KeyFilter]:
        """The filters that checking rows of a dataset can use: its own keys and those it refers to."""
        found = {}
        for name in (dataset_type, *(f.references for f in DATASETS[dataset_type].fields if f.references)):
            columns = _keys(DATASETS[name]) if name == dataset_type else (DATASETS[name].key,)
            for column in columns:
                paths = [p["filters"][column] for p in self.parts(name)]
                if paths:
                    sizes = tuple(sorted({p["blocks"] for p in self.parts(name)}))
                    found[name, column] = KeyFilter(self.spark.read.schema(_FILTER).parquet(*paths), sizes)
        return found


class Store:
    """Datasets and import log below one folder that all executors can reach.

    ``most_parts``: a dataset of more parts has its small ones joined; ``small_rows``: what a small part is;
    ``file_rows``: rows of a file after joining; ``bits_per_key``: of the Bloom filters; ``attempts``: how often an import is
    checked anew when other writers come first.
    """

    def __init__(
        self, spark: SparkSession, folder: str, most_parts: int = 16, small_rows: int = 1_000_000,
        file_rows: int = 5_000_000, bits_per_key: float = 12.0, attempts: int = 5,
    ) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.most_parts, self.small_rows, self.file_rows = most_parts, small_rows, file_rows
        self.bits_per_key, self.attempts = bits_per_key, attempts
        self.snapshots = Snapshots(spark, self.folder)

    # --- Reading ------------------------------------------------------------------------

    def state(self, number: int | None = None) -> State:
        """A snapshot, by default the newest. It stays as it is while others write, until it is expired."""
        number = self.snapshots.newest() if number is None else number
        return State(self.spark, self.snapshots.read(number) if number else {"datasets": {}, "imports": []})

    def log(self) -> DataFrame:
        return self.state().log()

    def import_of(self, import_id: str) -> DataFrame:
        return self.log().where(F.col("import_id") == import_id)

    def table(self, dataset_type: str) -> DataFrame:
        """The current rows of a dataset."""
        return self.state().table(dataset_type)

    def tables(self) -> Tables:
        """All datasets of one snapshot."""
        state = self.state()
        return Tables(**{name: state.table(name) for name in DATASETS})

    def references(self, dataset_type: str) -> dict[str, DataFrame]:
        return self.state().references(dataset_type)

    # --- Writing ------------------------------------------------------------------------

    def _checked(self, state: State, dataset_type: str, path: str, mode: str, assume_utc: bool) -> Validation:
        batch = read_batch(self.spark, dataset_type, path)
        if dataset_type not in DATASETS:
            return validate(self.spark, batch, mode=mode)
        return validate(
            self.spark, batch, state.references(dataset_type), state.table(dataset_type), mode, assume_utc, state.filters(dataset_type)
        )

    def check(self, dataset_type: str, path: str, mode: str = "APPEND", assume_utc: bool = False) -> Validation:
        """Validate a file against the stored data without writing anything to it."""
        return self._checked(self.state(), dataset_type, path, mode, assume_utc)

    def load(
        self,
        dataset_type: str,
        path: str,
        mode: str = "APPEND",
        assume_utc: bool = False,
        import_id: str | None = None,
        received_at: datetime | None = None,
    ) -> tuple[str, Validation]:
        """Import a file: all of its rows or none. Returns the status and the checks.

        The status is COMPLETED, REJECTED (a check failed) or ROLLED_BACK (a REPLACE
        would leave other records without what they refer to, writing failed, or other writers came first every time).
        """
        ids = {dataset_type: import_id or f"IMP-{uuid.uuid4().hex[:12]}"}
        statuses, checks = self._transaction({dataset_type: path}, ids, mode, assume_utc, received_at)
        return statuses[dataset_type], checks[dataset_type]

    def load_all(
        self, files: Mapping[str, str], mode: str = "APPEND", assume_utc: bool = False, received_at: datetime | None = None
    ) -> dict[str, str]:
        """Import several files, parents first, as one transaction. Returns the status per dataset.

        Later files are checked against earlier ones. If one does not pass, none is imported: it is REJECTED (or
        ROLLED_BACK), the others are ROLLED_BACK.
        """
        known = {name: files[name] for name in (*DATASETS, *(n for n in files if n not in DATASETS)) if name in files}
        ids = {name: f"IMP-{uuid.uuid4().hex[:12]}" for name in known}
        return self._transaction(known, ids, mode, assume_utc, received_at)[0]

    def _transaction(
        self, files: Mapping[str, str], ids: Mapping[str, str], mode: str, assume_utc: bool, received_at: datetime | None
    ) -> tuple[dict[str, str], dict[str, Validation]]:
        received_at = received_at or datetime.now(timezone.utc)
        for attempt in range(1, self.attempts + 1):
            number = self.snapshots.newest()
            before = self.state(number)
            staged = State(self.spark, copy.deepcopy(before.manifest))
            statuses: dict[str, str] = {}
            checks: dict[str, Validation] = {}
            for name, path in files.items():
                checks[name] = self._checked(staged, name, path, mode, assume_utc)
                statuses[name] = self._stage(staged, name, checks[name], mode, f"{ids[name]}-{attempt}") if checks[name].is_valid else "REJECTED"
            if mode == "REPLACE":  # seen together: a parent and its children may be replaced at once
                for name in [n for n, status in statuses.items() if status == "COMPLETED"]:
                    statuses[name] = "ROLLED_BACK" if self._orphans(staged, name) else "COMPLETED"
            if set(statuses.values()) != {"COMPLETED"}:
                statuses = {name: "ROLLED_BACK" if status == "COMPLETED" else status for name, status in statuses.items()}
                staged = before
            rows = [self._log_row(ids[name], checks[name], mode, statuses[name], received_at, staged) for name in files]
            try:
                self._publish(number, staged, rows)
            except SnapshotTaken:
                continue
            if staged is not before:
                for name in files:
                    self.compact(name)
            return statuses, checks
        statuses = {name: "ROLLED_BACK" if status == "COMPLETED" else status for name, status in statuses.items()}
        self._log_only([self._log_row(ids[name], checks[name], mode, statuses[name], received_at, before) for name in files])
        return statuses, checks

    def _publish(self, number: int, staged: State, rows: list[tuple]) -> None:
        """Write the log rows and publish the state that follows ``number``."""
        logs = staged.manifest["imports"]
        target = f"{self.folder}/imports/{uuid.uuid4().hex}"
        new = self.spark.createDataFrame(rows, LOG)
        if len(logs) >= self.most_parts:  # one row per import: joined whole
            new, logs = staged.log().unionByName(new), []
        new.coalesce(1).write.parquet(target)
        staged.manifest["imports"] = [*logs, target]
        self.snapshots.publish(number + 1, staged.manifest)

    def _log_only(self, rows: list[tuple]) -> None:
        while True:
            number = self.snapshots.newest()
            try:
                return self._publish(number, State(self.spark, self.state(number).manifest), rows)
            except SnapshotTaken:
                continue

    def _stage(self, staged: State, dataset_type: str, checked: Validation, mode: str, name: str) -> str:
        """Write the rows and their filters, and enter them into the staged manifest."""
        try:
            part = self._write(dataset_type, checked.accepted, checked.accepted_count, name)
            old = [] if mode == "REPLACE" else staged.parts(dataset_type)
            staged.manifest["datasets"][dataset_type] = [*old, part]
        except Exception:  # noqa: BLE001 - any failed write leaves the data as it was
            return "ROLLED_BACK"
        return "COMPLETED"

    def _write(self, dataset_type: str, rows: DataFrame, count: int, name: str) -> dict:
        dataset = DATASETS[dataset_type]
        blocks = keyfilter.blocks_for(count, self.bits_per_key)
        target = f"{self.folder}/data/{dataset_type}/{name}"
        rows.write.mode("errorifexists").parquet(target)
        stored = self.spark.read.schema(dataset.struct).parquet(target)
        filters = {}
        for column in _keys(dataset):
            filters[column] = f"{self.folder}/keys/{dataset_type}/{name}/{column}"
            keyfilter.build(stored, column, blocks).write.mode("errorifexists").parquet(filters[column])
        return {"path": target, "rows": count, "filters": filters, "blocks": blocks}

    def _orphans(self, staged: State, dataset_type: str) -> bool:
        key = DATASETS[dataset_type].key
        replacement = staged.table(dataset_type).select(key)
        for child in DATASETS.values():
            for f in child.fields:
                if f.references == dataset_type:
                    used = staged.table(child.name).where(F.col(f.name).isNotNull()).select(F.col(f.name).alias(key)).distinct()
                    if not used.join(replacement, key, "left_anti").isEmpty():
                        return True
        return False

    def _log_row(self, import_id: str, checked: Validation, mode: str, status: str, received_at: datetime, staged: State) -> tuple:
        done = status == "COMPLETED"
        summary = {
            "COMPLETED": f"{checked.row_count} rows added to {checked.dataset} ({mode.lower()}).",
            "REJECTED": f"{checked.dataset} not imported: {checked.error_count} problems.",
            "ROLLED_BACK": f"{checked.dataset} not imported: the data are as before.",
        }[status]
        return (
            import_id, checked.dataset, mode, status, received_at, datetime.now(timezone.utc), checked.row_count,
            checked.accepted_count if done else 0, 0 if done else checked.row_count, checked.error_count, summary,
            staged.parts(checked.dataset)[-1]["path"] if done else None,
        )

    # --- Upkeep -------------------------------------------------------------------------

    def compact(self, dataset_type: str) -> bool:
        """Join the small parts of a dataset of more than ``most_parts`` parts, or all of them if there are as many
        large ones. Rows stay the same. Another writer who comes first wins; the next import tries again."""
        number = self.snapshots.newest()
        staged = self.state(number)
        parts = staged.parts(dataset_type)
        if len(parts) <= self.most_parts:
            return False
        small = [p for p in parts if p["rows"] < self.small_rows]
        joined = parts if len(parts) - len(small) >= self.most_parts else small
        count = sum(p["rows"] for p in joined)
        rows = self.spark.read.schema(DATASETS[dataset_type].struct).parquet(*[p["path"] for p in joined])
        rows = rows.repartition(max(1, -(-count // self.file_rows)), DATASETS[dataset_type].key)
        part = self._write(dataset_type, rows, count, f"joined-{uuid.uuid4().hex[:12]}")
        staged.manifest["datasets"][dataset_type] = [*[p for p in parts if p not in joined], part]
        try:
            self.snapshots.publish(number + 1, staged.manifest)
        except SnapshotTaken:
            self.snapshots.drop([], [part["path"], *part["filters"].values()])
            return False
        return True

    def expire(self, keep: int = 10) -> int:
        """Delete all but the newest snapshots, and the folders that only the deleted ones name. Returns how many went."""
        numbers = self.snapshots.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        used, unused = (set().union(*(self._folders(self.snapshots.read(n)) for n in some)) for some in (kept, gone))
        self.snapshots.drop(gone, sorted(unused - used))
        return len(gone)

    @staticmethod
    def _folders(manifest: dict) -> set[str]:
        parts = [p for entry in manifest["datasets"].values() for p in entry]
        return {*manifest["imports"], *(p["path"] for p in parts), *(f for p in parts for f in p["filters"].values())}
