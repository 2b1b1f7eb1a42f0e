"""Versioned keyed tables: immutable snapshots of Parquet files behind a HEAD.

    _commits/<tx>.json        {tx_id, prev_id, ts_us, tables: {name: entry}, marks}
    _next/<tx>                id of the commit that follows; written once
    HEAD                      a commit to look on from, usually the current one
    _manifests/<name>/<id>/   one row per data file: path, rows, key bounds, digest
    data/<name>/<id>/         Parquet, range-partitioned and sorted by the key

Data files and manifests are never changed. A commit carries all other tables
on and names its predecessor, so any commit is a whole-catalog snapshot. Writing
``_next`` is what commits: of two writers on one predecessor the second fails.
The manifest is a Parquet table, written by the executors and filtered by Spark;
a read takes the paths that are left from it to the scan, within the JVM.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .errors import CommitConflict, DuplicateKey, InvalidArgs, NoSuchTable, NoSuchTransaction, NullKey, checked_rows, failing
from .functions.encoding import text_digest
from .model import ROW_ID, KeyedSchema
from .operators.keyed import KeyedReads, any_null, constrained

#: Rows per data file that a load aims at.
ROWS_PER_FILE = 4_000_000
#: Places of 32 bits of a SHA-256 that are summed over rows.
LANES = 4


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``row_id``: 0, 1, ... in scan order, and the number of rows.
    Rows are counted per partition, and each partition's numbers shifted by the
    counts before; the shifts are one row per partition. Partitions that turn out
    longer when they are read again are an error."""
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    shifts, total = [], 0
    for p, n in counts:
        shifts.append((p, total, n))
        total += n
    table = df.sparkSession.createDataFrame(shifts, "__p long, __shift long, __n long")
    rows = marked.withColumn("__p", part).join(F.broadcast(table), "__p", "left")
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    known = F.coalesce(place < F.col("__n"), F.lit(False))
    row_id = F.when(known, F.col("__shift") + place).otherwise(failing(InvalidArgs, F.lit("the rows changed between two reads")).cast("long"))
    return rows.withColumn(ROW_ID, row_id).drop("__at", "__p", "__shift", "__n"), total


def with_row_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``row_id``: 0, 1, ... in scan order; see ``numbered``."""
    return numbered(df)[0]


@dataclass(frozen=True)
class TableVersion:
    """One table of one snapshot."""

    name: str
    table_id: str
    schema: KeyedSchema
    rows: int
    manifests: tuple[str, ...] = field(default=())

    def to_json(self) -> dict:
        return {"table_id": self.table_id, "schema": self.schema.to_json(), "rows": self.rows, "manifests": list(self.manifests)}

    @classmethod
    def from_json(cls, name: str, value: dict) -> TableVersion:
        return cls(name, value["table_id"], KeyedSchema.from_json(value["schema"]), value["rows"], tuple(value["manifests"]))


@dataclass(frozen=True)
class Commit:
    tx_id: str
    prev_id: str | None
    ts_us: int
    tables: dict[str, TableVersion]
    #: Last batch applied of each change stream.
    marks: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        tables = {n: t.to_json() for n, t in sorted(self.tables.items())}
        return json.dumps({"tx_id": self.tx_id, "prev_id": self.prev_id, "ts_us": self.ts_us, "tables": tables, "marks": self.marks})

    @classmethod
    def from_text(cls, text: str) -> Commit:
        v = json.loads(text)
        return cls(v["tx_id"], v["prev_id"], v["ts_us"], {n: TableVersion.from_json(n, t) for n, t in v["tables"].items()}, v.get("marks", {}))


class Store:
    """A folder of versioned tables. Of writers at the same time one succeeds, the
    others get a CommitConflict."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    # -- commits ---------------------------------------------------------

    def head(self) -> str | None:
        """Id of the current commit; None for a store without one."""
        path = f"{self.root}/HEAD"
        at = files.read_text(self.spark, path).strip() if files.exists(self.spark, path) else None
        while files.exists(self.spark, after := self._after(at)):
            at = files.read_text(self.spark, after).strip()
        return at

    def _after(self, tx_id: str | None) -> str:
        return f"{self.root}/_next/{tx_id or 'none'}"

    def commit(self, tx_id: str | None = None) -> Commit:
        """A commit by id, the current one by default."""
        tx_id = tx_id or self.head()
        if tx_id is None:
            raise NoSuchTransaction(f"no commit in {self.root}")
        path = f"{self.root}/_commits/{tx_id}.json"
        if not files.exists(self.spark, path):
            raise NoSuchTransaction(tx_id)
        return Commit.from_text(files.read_text(self.spark, path))

    def table(self, name: str, tx_id: str | None = None) -> TableVersion:
        tables = self.commit(tx_id).tables if tx_id or self.head() else {}
        if name not in tables:
            raise NoSuchTable(name)
        return tables[name]

    def history(self) -> DataFrame:
        """tx_id, prev_id, ts_us, tables of the current commit and all before it."""
        rows, at = [], self.head()
        while at:
            commit = self.commit(at)
            rows.append((commit.tx_id, commit.prev_id, commit.ts_us, sorted(commit.tables)))
            at = commit.prev_id
        return self.spark.createDataFrame(rows, "tx_id string, prev_id string, ts_us long, tables array<string>")

    def publish(self, version: TableVersion, based_on: str | None, mark: tuple[str, int] | None = None) -> str:
        """Commit a table version on top of ``based_on``, and with it the batch
        of a change stream that made it."""
        if self.head() != based_on:
            raise CommitConflict(f"HEAD is {self.head()}, not {based_on}")
        before = self.commit(based_on) if based_on else Commit("", None, 0, {})
        ts = time.time_ns() // 1000
        digest = hashlib.sha256(f"{based_on}|{ts}|{version.name}|{version.table_id}|{uuid.uuid4().hex}".encode())
        marks = before.marks | ({mark[0]: mark[1]} if mark else {})
        commit = Commit(digest.hexdigest().upper(), based_on, ts, before.tables | {version.name: version}, marks)
        path = f"{self.root}/_commits/{commit.tx_id}.json"
        files.write_text(self.spark, path, commit.to_json())
        try:
            files.write_text(self.spark, self._after(based_on), commit.tx_id)
        except FileExistsError:
            files.delete(self.spark, path)
            raise CommitConflict(f"another commit follows {based_on}") from None
        files.write_text(self.spark, f"{self.root}/HEAD", commit.tx_id, replace=True)
        return commit.tx_id

    # -- writing ---------------------------------------------------------

    def write_files(self, name: str, schema: KeyedSchema, rows: DataFrame, partitions: int | None = None, unique: bool = False) -> str:
        """Write rows (with row_id) as sorted key ranges and their manifest, whose
        path is returned. One shuffle: the range partitioning, in which equal
        keys meet, also serves the check that keys don't repeat; ``unique`` says
        that they can't. A null in a key fails as well."""
        batch = uuid.uuid4().hex
        path, manifest = f"{self.root}/data/{name}/{batch}", f"{self.root}/_manifests/{name}/{batch}"
        keys = [F.col(f"`{k}`") for k in schema.keys]
        stored = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.stored.fields])
        ranged = stored.repartitionByRange(partitions, *keys) if partitions else stored.repartitionByRange(*keys)
        ranged = ranged.sortWithinPartitions(*keys, ROW_ID)
        # Range partitioning by the key is what the window wants, and the sort its
        # order, so numbering the rows of a key costs neither.
        nth = F.lit(1) if unique else F.row_number().over(W.partitionBy(*keys).orderBy(ROW_ID))
        lead, numbered_ = schema.keys[0], ranged.withColumn("__nth", nth)
        guards = {
            lead: F.when(any_null(schema.keys), failing(NullKey, F.lit(f"null in {list(schema.keys)}")).cast(schema.row[lead].dataType)).otherwise(F.col(f"`{lead}`")),
            ROW_ID: F.when(F.col("__nth") > 1, failing(DuplicateKey, F.to_json(F.struct(*keys))).cast("long")).otherwise(F.col(ROW_ID)),
        }
        guarded = numbered_.select(*[guards.get(c, F.col(f"`{c}`")).alias(c) for c in schema.stored.names])
        try:
            with checked_rows():
                guarded.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
            self._describe(path, schema).write.parquet(manifest)
        except Exception:
            self.discard(manifest)
            raise
        return manifest

    def _describe(self, path: str, schema: KeyedSchema) -> DataFrame:
        """path, rows, min_key, max_key, digest of the files in a folder. A file's
        digest is of its bounds and of the sums, place by place, of the SHA-256
        of its rows, so it is one aggregation without a shuffle
        of rows. Sums catch any accident; they are no guard against a forger."""
        written = self.spark.read.schema(schema.stored).parquet(path)
        key = F.struct(*[F.col(f"`{k}`") for k in schema.keys])
        own = written.select(F.col("_metadata.file_path").alias("path"), key.alias("key"), text_digest(schema.stored, [*schema.columns, ROW_ID]).alias("sha"))
        lanes = [F.sum(F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"lane{k}") for k in range(LANES)]
        entries = own.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), *lanes)
        leaf = F.sha2(F.concat_ws("|", F.lit("file"), "rows", F.to_json("min_key"), F.to_json("max_key"), *[f"lane{k}" for k in range(LANES)]), 256)
        return entries.select("path", "rows", "min_key", "max_key", F.upper(leaf).alias("digest"))

    def discard(self, manifest: str) -> None:
        """Remove what ``write_files`` wrote, when it isn't committed."""
        files.delete(self.spark, manifest.replace("/_manifests/", "/data/"))
        files.delete(self.spark, manifest)

    def version(self, name: str, schema: KeyedSchema, manifests: Sequence[str]) -> TableVersion:
        """The table that the manifests list. Its id is a digest over the name,
        the schema and the digests of all files: these are folded by their first
        three digits on the executors, and the at most 4096 folds on the driver."""
        folds: list = []
        if manifests:
            rows = self.manifest_rows(manifests, schema).groupBy(F.substring("digest", 1, 3).alias("at"))
            folded = rows.agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ","), 256).alias("fold"))
            folds = sorted(folded.collect(), key=lambda r: r["at"])
        text = json.dumps(["table", name, schema.to_json(), [r["fold"] for r in folds]])
        total = sum(r["rows"] for r in folds)
        return TableVersion(name, hashlib.sha256(text.encode()).hexdigest().upper(), schema, total, tuple(manifests) if total else ())

    def write_table(self, name: str, df: DataFrame, keys: Sequence[str], mode: str = "replace", partitions: int | None = None) -> str:
        """Load a table from rows with unique, non-null keys and commit it.

        ``replace`` takes the place of a table of that name, ``create`` wants
        none; other tables and the history stay. A ``row_id`` column numbers
        the rows; without one they are numbered in scan order. An empty input
        is InvalidArgs, a repeated key DuplicateKey.
        """
        if mode not in ("replace", "create"):
            raise InvalidArgs(f"mode {mode!r}")
        schema = KeyedSchema.of(df.schema, keys)
        based_on = self.head()
        if mode == "create" and based_on and name in self.commit(based_on).tables:
            raise InvalidArgs(f"table {name!r} exists")
        rows, expected = (df, None) if ROW_ID in df.columns else numbered(df)
        manifest = self.write_files(name, schema, rows, partitions)
        try:
            version = self.version(name, schema, [manifest])
            if not version.rows:
                raise InvalidArgs("no rows")
            if expected not in (None, version.rows):
                raise InvalidArgs(f"the rows changed between two reads: {expected} and {version.rows}")
            return self.publish(version, based_on)
        except Exception:
            self.discard(manifest)
            raise

    # -- reading ---------------------------------------------------------

    def manifest_rows(self, manifests: Sequence[str], schema: KeyedSchema) -> DataFrame:
        """path, rows, min_key, max_key, digest per data file."""
        key = T.StructType([schema.stored[k] for k in schema.keys])
        fields = [("path", T.StringType()), ("rows", T.LongType()), ("min_key", key), ("max_key", key), ("digest", T.StringType())]
        form = T.StructType([T.StructField(n, t) for n, t in fields])
        return self.spark.read.schema(form).parquet(*manifests) if manifests else self.spark.createDataFrame([], form)

    def manifest_files(self, manifests: Sequence[str], schema: KeyedSchema, where: Column | None = None) -> DataFrame:
        """The rows of the files that the manifests list, of those under ``where``
        (on min_key and max_key) if given."""
        if not manifests:
            return self.spark.createDataFrame([], schema.stored)
        listed = self.manifest_rows(manifests, schema)
        return files.read_parquet(self.spark, (listed if where is None else listed.where(where)).select("path"), schema.stored)

    def snapshot(self, name: str, tx_id: str | None = None) -> Snapshot:
        """A table as of a commit, the current one by default; pinned from then on."""
        return Snapshot(self, self.table(name, tx_id), tx_id or self.head())


@dataclass(frozen=True)
class Snapshot(KeyedReads):
    """One table version, read only."""

    store: Store
    version: TableVersion
    tx_id: str

    @property
    def schema(self) -> KeyedSchema:
        return self.version.schema

    def row_count(self) -> int:
        """From the commit; nothing is scanned."""
        return self.version.rows

    def manifest(self) -> DataFrame:
        """path, rows, min_key, max_key, digest per data file."""
        return self.store.manifest_rows(self.version.manifests, self.schema)

    def stored(self, constraints: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        """Rows with row_id under all constraints. Files whose bounds of the
        leading key column rule them out aren't read; the predicates go to the
        Parquet scan as well and are checked on every row."""
        lead = self.schema.keys[0]
        where = None
        for column, op, value in constraints:
            if column != lead or value is None:
                continue
            low, high = F.col("min_key")[lead], F.col("max_key")[lead]
            test = {"=": (low <= F.lit(value)) & (high >= F.lit(value)), "<": low < F.lit(value), "<=": low <= F.lit(value), ">": high > F.lit(value), ">=": high >= F.lit(value)}.get(op)
            if test is not None:
                where = test if where is None else where & test
        rows = self.store.manifest_files(self.version.manifests, self.schema, where)
        return constrained(rows, self.schema, constraints)
