"""Keyed tables over parquet folders, named ``catalog.schema.table``.

A table is a folder with three parts: ``meta`` (schema, key, settings; a line per change), ``data``
(one sub-folder per write, never changed afterwards) and ``log`` (one row per commit that says, as JSON,
which sub-folder holds which key bucket). A reader takes the newest row of the log, so a write
becomes visible in one step, when its log row does, and old versions stay readable. A version's log row
is made by one writer only: of several appends at once all are kept, one after the other; of several
other writes at once one is, and the rest raise :class:`Conflict`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.changes import change_feed
from tablemill.operators.quality import require_unique
from tablemill.session import materialize, one_row
from tablemill.sources.publish import publish

BUCKET = "__bucket"
LOG_SCHEMA = "version bigint, operation string, writer string, batch_id bigint, parts string"


class Conflict(RuntimeError):
    """Another writer changed the table since it was read; nothing was written, start again."""


@dataclass(frozen=True)
class Commit:
    """A version and the data folder of each of its buckets."""

    version: int
    parts: dict[int, str]


@dataclass(frozen=True)
class Lake:
    """Tables below ``root``; use a path every executor can reach."""

    spark: SparkSession
    root: str
    catalog: str = "main"
    schema: str = "default"
    _metas: dict = field(default_factory=dict, repr=False, compare=False)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{self.catalog}/{self.schema}/{name}"

    # -- definition ---------------------------------------------------------------------------

    def create_if_absent(
        self,
        name: str,
        schema: T.StructType,
        keys: Sequence[str] = (),
        buckets: int = 1,
        partition_by: Sequence[str] = (),
        comment: str = "",
        properties: Mapping[str, str] | None = None,
        stream: bool = False,
    ) -> bool:
        """Create an empty table; False when it exists already.

        With ``buckets`` above 1 the rows are laid out by key hash, and an upsert rewrites only the
        buckets its keys fall into. ``partition_by`` adds folders (a day, say) for pruning. A
        ``stream`` table is filled by a streaming query at :meth:`stream_path`, whose checkpoint
        keeps its commits, and has no versions here.
        """
        if self.exists(name):
            return False
        if buckets > 1 and not keys:
            raise ValueError("buckets need a key")
        meta = {
            "schema": schema.jsonValue(),
            "keys": list(keys),
            "buckets": buckets,
            "partition_by": list(partition_by),
            "comment": comment,
            "stream": stream,
            "properties": dict(properties or {}),
            "revision": 1,
        }
        one_row(self.spark, value=json.dumps(meta)).write.mode("errorifexists").text(
            self.path(name) + "/meta"
        )
        one_row(self.spark, table=name, comment=comment).write.mode("append").parquet(
            self.path("tables.list")
        )
        return True

    def widen(self, name: str, schema: T.StructType) -> bool:
        """Give a stream table further columns, null in the rows it holds; False when it has them all."""
        meta = self.meta(name)
        if not meta["stream"]:
            raise ValueError(f"{name} is no stream table")
        have = set(T.StructType.fromJson(meta["schema"]).fieldNames())
        if have >= set(schema.fieldNames()):
            return False
        if not have <= set(schema.fieldNames()):
            raise ValueError(f"columns missing: {sorted(have - set(schema.fieldNames()))}")
        wider = {**meta, "schema": schema.jsonValue(), "revision": meta.get("revision", 1) + 1}
        one_row(self.spark, value=json.dumps(wider)).write.mode("append").text(self.path(name) + "/meta")
        self._metas.pop(name, None)
        return True

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.schema("value string").text(self.path(name) + "/meta")
        except AnalysisException:
            return False
        return True

    def meta(self, name: str) -> dict:
        # only a stream table's columns ever change, by widen
        if name not in self._metas:
            self._metas[name] = self._read_meta(name)
        return self._metas[name]

    def _read_meta(self, name: str) -> dict:
        lines = self.spark.read.schema("value string").text(self.path(name) + "/meta")
        newest = lines.orderBy(F.get_json_object("value", "$.revision").cast("int").desc_nulls_last())
        return json.loads(newest.take(1)[0][0])

    def tables(self) -> DataFrame:
        """``(table, comment)`` of every table created below this schema."""
        return self.spark.read.schema("table string, comment string").parquet(
            self.path("tables.list")
        )

    def history(self, name: str) -> DataFrame:
        """The commit log; empty before the first write."""
        try:
            log = self.spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True)
            return log.parquet(self.path(name) + "/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_SCHEMA)

    # -- reading ------------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the given one."""
        if self.meta(name)["stream"]:
            schema = T.StructType.fromJson(self.meta(name)["schema"])
            return self.spark.read.schema(schema).parquet(self.stream_path(name))
        commit = self._commit(name, version)
        return self._read_parts(name, self.meta(name), commit.parts if commit else {})

    def stream_path(self, name: str) -> str:
        """Where a streaming query appends to the table."""
        return f"{self.path(name)}/stream"

    def checkpoint_path(self, name: str) -> str:
        """Where the query that fills the table keeps its progress."""
        return f"{self.path(name)}/checkpoint"

    def current_version(self, name: str) -> int:
        """0 before the first write."""
        commit = self._commit(name, None)
        return commit.version if commit else 0

    def register_view(self, name: str, view: str | None = None) -> None:
        """Make the newest version visible to ``spark.sql`` / ``spark.table``."""
        self.read(name).createOrReplaceTempView(view or name)

    def changes(self, name: str, start: int, end: int | None = None) -> DataFrame:
        """Change feed from version ``start`` to ``end`` (default: newest), with ``_commit_version``.

        Only buckets that were rewritten in between are read.
        """
        meta = self.meta(name)
        if not meta["keys"] or meta["stream"]:
            raise ValueError(f"{name} has no key and so no change feed")
        first, last = self._commit(name, start), self._commit(name, end)
        old, new = (first.parts if first else {}), (last.parts if last else {})
        moved = {b for b in {*old, *new} if old.get(b) != new.get(b)}
        before = self._read_parts(name, meta, {b: p for b, p in old.items() if b in moved})
        after = self._read_parts(name, meta, {b: p for b, p in new.items() if b in moved})
        feed = change_feed(before, after, meta["keys"])
        return feed.withColumn(
            "_commit_version", F.lit(last.version if last else 0).cast("bigint")
        )

    # -- writing ------------------------------------------------------------------------------

    def overwrite(
        self, name: str, df: DataFrame, writer: str = "batch", batch_id: int | None = None
    ) -> int:
        """Replace all rows; returns the version."""
        meta, commit = self.meta(name), self._commit(name, None)
        if self._seen(name, writer, batch_id):
            return commit.version
        folder, parts = self._write(name, meta, self._with_bucket(meta, self._shaped(meta, df)))
        if meta["keys"]:
            require_unique(self._read_parts(name, meta, parts), meta["keys"])
        return self._log(name, commit, "overwrite", writer, batch_id, parts)

    def append(
        self, name: str, df: DataFrame, writer: str = "batch", batch_id: int | None = None
    ) -> int:
        """Add rows to a table without a key."""
        meta = self.meta(name)
        if meta["keys"]:
            raise ValueError("a keyed table takes upserts, not appends")
        if self._seen(name, writer, batch_id):
            return self.current_version(name)
        folder, _ = self._write(name, meta, self._shaped(meta, df))
        while True:
            commit = self._commit(name, None)
            kept = dict(commit.parts) if commit else {}
            kept[len(kept)] = folder
            try:
                return self._log(name, commit, "append", writer, batch_id, kept)
            except Conflict:
                if self._seen(name, writer, batch_id):
                    return self.current_version(name)

    def upsert(
        self, name: str, df: DataFrame, writer: str = "batch", batch_id: int | None = None
    ) -> int:
        """Matched keys are replaced, new keys inserted, all others kept.

        A null or repeated key in ``df`` is an error and leaves the table as it was. A ``batch_id``
        that this ``writer`` has committed before is skipped, which makes a replayed micro-batch
        harmless.
        """
        meta, commit = self.meta(name), self._commit(name, None)
        if not meta["keys"]:
            raise ValueError(f"{name} has no key")
        if self._seen(name, writer, batch_id):
            return commit.version
        keys = meta["keys"]
        # written once: it is checked, its buckets are listed, and it is joined and unioned
        update = materialize(self._with_bucket(meta, self._shaped(meta, df)), "update")
        require_unique(update, keys)
        kept = dict(commit.parts) if commit else {}
        touched = sorted(kept)
        if meta["buckets"] > 1:
            touched = [r[0] for r in update.select(BUCKET).distinct().collect()]
        base = self._read_parts(name, meta, {b: kept[b] for b in touched if b in kept})
        staying = self._with_bucket(meta, base).join(update.select(*keys), keys, "left_anti")
        _, parts = self._write(name, meta, staying.unionByName(update))
        kept = {b: p for b, p in kept.items() if b not in touched}
        return self._log(name, commit, "merge", writer, batch_id, {**kept, **parts})

    # -- inside -------------------------------------------------------------------------------

    def _commit(self, name: str, version: int | None) -> Commit | None:
        log = self.history(name)
        if version is not None:
            log = log.filter(F.col("version") == version)
        newest = log.orderBy(F.desc("version")).take(1)
        if version and not newest:
            raise ValueError(f"{name} has no version {version}")
        if not newest:
            return None
        parts = {int(b): folder for b, folder in json.loads(newest[0].parts).items()}
        return Commit(newest[0].version, parts)

    def _seen(self, name: str, writer: str, batch_id: int | None) -> bool:
        if batch_id is None:
            return False
        same = self.history(name).filter(
            (F.col("writer") == writer) & (F.col("batch_id") >= batch_id)
        )
        return not same.isEmpty()

    def _shaped(self, meta: dict, df: DataFrame) -> DataFrame:
        fields = T.StructType.fromJson(meta["schema"]).fields
        unknown = set(df.columns) ^ {f.name for f in fields}
        if unknown:
            raise ValueError(f"columns differ from the table's: {sorted(unknown)}")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])

    def _with_bucket(self, meta: dict, df: DataFrame) -> DataFrame:
        if meta["buckets"] == 1:
            return df
        hashed = F.xxhash64(*[F.col(k) for k in meta["keys"]])
        return df.withColumn(BUCKET, F.pmod(hashed, F.lit(meta["buckets"])).cast("int"))

    def _write(self, name: str, meta: dict, df: DataFrame) -> tuple[str, dict[int, str]]:
        folder = uuid.uuid4().hex
        path = f"{self.path(name)}/data/{folder}"
        layout = ([BUCKET] if meta["buckets"] > 1 else []) + meta["partition_by"]
        if layout:
            # rebalance keeps a bucket in few files and splits a large one over several tasks
            df.hint("rebalance", *layout).write.partitionBy(*layout).parquet(path)
        else:
            df.write.parquet(path)
        if meta["buckets"] == 1:
            return folder, {0: folder}
        stored = self.spark.read.schema(f"{BUCKET} int").parquet(path)
        return folder, {r[0]: folder for r in stored.select(BUCKET).distinct().collect()}

    def _read_parts(self, name: str, meta: dict, parts: Mapping[int, str]) -> DataFrame:
        schema = T.StructType.fromJson(meta["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        columns = schema.fieldNames()
        buckets = {}
        for bucket, folder in parts.items():
            buckets.setdefault(folder, []).append(bucket)
        if meta["buckets"] == 1 and not meta["partition_by"]:
            paths = [f"{self.path(name)}/data/{folder}" for folder in sorted(buckets)]
            return self.spark.read.schema(schema).parquet(*paths)
        pieces = []
        for folder, held in sorted(buckets.items()):
            path = f"{self.path(name)}/data/{folder}"
            if meta["buckets"] == 1:
                pieces.append(self.spark.read.schema(schema).parquet(path))
                continue
            typed = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
            # a partition filter: folders of buckets that live elsewhere are never opened
            pieces.append(
                self.spark.read.schema(typed).parquet(path).filter(F.col(BUCKET).isin(held))
            )
        whole = pieces[0]
        for piece in pieces[1:]:
            whole = whole.unionByName(piece)
        return whole.select(*columns)

    def _log(self, name, commit, operation, writer, batch_id, parts) -> int:
        version = (commit.version if commit else 0) + 1
        row = one_row(
            self.spark,
            version=F.lit(version).cast("bigint"),
            operation=operation,
            writer=writer,
            batch_id=F.lit(batch_id).cast("bigint"),
            parts=json.dumps(parts),
        )
        if not publish(row, f"{self.path(name)}/log/{version}"):
            raise Conflict(f"{name} has got version {version} from another writer")
        return version
