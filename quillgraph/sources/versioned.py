"""Tables of documents under one folder: immutable runs of rows, deletion vectors beside them, and versions.

A change writes only its own rows.  What it replaces stays where it is and is hidden by a deletion vector, the ids of the
documents that the change is about; a change of a few columns writes these columns alone.  Readers merge by document_id
and version.  ``compact`` merges the newer runs while they are small beside the older ones, so a row is rewritten a
number of times that grows with the logarithm of the table, and reads meet few runs.

Rows of a run lie in ranges of a hash of document_id, sorted within files, whose statistics let a read of some documents
skip the rest; files have the size that the session's adaptive execution advises, however many rows there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A hidden column: the hash by which rows lie.
HASH = "_hash"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to publish; nothing of this change counts."""


class VersionedTables:
    """Named tables whose rows belong to documents, all under ``path``.

    Every change publishes one version of all tables together, as one small file of its own name, which is put only if it
    isn't there: of two writers that started from the same version one gets a :class:`Conflict` and may try again.  (The
    file comes by a rename that refuses to overwrite.  HDFS does that in one step; a local file system looks first.)
    A failed write leaves what was there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions

    def _file_system(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        _, folder, fs = self._file_system()
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def _load(self, number: int) -> dict:
        jvm, folder, fs = self._file_system()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{number:020d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        """The last version: its number, the schema of each table, and its runs, deletion vectors and column changes."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"version": 0, "schemas": {}, "entries": []}

    def _publish(self, state: dict) -> None:
        jvm, folder, fs = self._file_system()
        fs.mkdirs(folder)
        part = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{state['version']:020d}.json")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, options)
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {state['version']} is there already") from e
            raise

    # Writing

    def _write(self, table: str, kind: str, rows: DataFrame, version: int) -> dict:
        """An immutable folder of rows, in ranges of the hash."""
        folder = f"{table}/{uuid.uuid4().hex}"
        laid = rows.withColumn(HASH, F.xxhash64("document_id")).withColumn("_range", F.shiftrightunsigned(HASH, 52))
        laid.hint("rebalance", F.col("_range")).sortWithinPartitions(HASH).drop("_range").write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        return {"table": table, "kind": kind, "folder": folder, "version": version, "schema": rows.schema.jsonValue(), "rows": n}

    def change(self, documents: DataFrame | None = None, rows: dict[str, DataFrame] | None = None, columns: dict[str, DataFrame] | None = None, base: dict | None = None) -> int:
        """One version: in the tables of ``rows`` these take the place of all rows of the ``documents``, also of those that
        have none any more; in the tables of ``columns`` the given columns change in the documents' rows and nothing else.
        ``base`` is the state that the change was made from, the last one by default.  Returns the version."""
        state = self.state() if base is None else base
        version = state["version"] + 1
        entries, schemas = list(state["entries"]), dict(state["schemas"])
        if documents is not None:
            entry = self._write("gone", "gone", documents.select("document_id").distinct(), version)
            entries.append(entry | {"tables": sorted(rows or {})})
        for table, new in (rows or {}).items():
            schemas.setdefault(table, new.schema.jsonValue())
            entries.append(self._write(table, "rows", new, version))
        for table, new in (columns or {}).items():
            if table not in schemas:
                raise ValueError(f"there is no table {table!r} to change columns of")
            entries.append(self._write(table, "columns", new, version))
        self._publish({"version": version, "schemas": schemas, "entries": [e for e in entries if e["rows"]]})
        return version

    def replace(self, documents: DataFrame, /, **rows: DataFrame) -> int:
        return self.change(documents, rows)

    def update(self, table: str, rows: DataFrame) -> int:
        """Change the columns of ``rows`` (beside document_id) in the table; of a document's row the last change counts."""
        return self.change(columns={table: rows})

    def delete(self, documents: DataFrame, base: dict | None = None) -> int:
        """Hide all rows of the documents, in all tables; no row is written."""
        state = self.state() if base is None else base
        entry = self._write("gone", "gone", documents.select("document_id").distinct(), state["version"] + 1)
        self._publish({"version": state["version"] + 1, "schemas": state["schemas"], "entries": [*state["entries"], *([entry | {"tables": sorted(state["schemas"])}] if entry["rows"] else [])]})
        return state["version"] + 1

    def clear(self) -> None:
        state = self.state()
        self._publish({"version": state["version"] + 1, "schemas": state["schemas"], "entries": []})

    # Reading

    def _frame(self, e: dict, documents: Iterable[int] | None) -> DataFrame:
        kind = T.StructType([*T.StructType.fromJson(e["schema"]).fields, T.StructField(HASH, T.LongType())])
        df = self.spark.read.schema(kind).parquet(f"{self.path}/{e['folder']}")
        if documents is not None:
            ids = list(documents)
            hashes = [F.xxhash64(F.lit(d).cast(kind["document_id"].dataType)) for d in ids]
            df = df.where(F.col(HASH).isin(hashes) & F.col("document_id").isin(ids)) if ids else df.limit(0)
        return df.drop(HASH).withColumn("_version", F.lit(e["version"]))

    def read(self, table: str, documents: Iterable[int] | None = None, state: dict | None = None) -> DataFrame:
        """The table's rows, or those of some documents, for which only their places in each run are read."""
        state = self.state() if state is None else state
        if table not in state["schemas"]:
            raise ValueError(f"the store has no table {table!r}")
        names = [f["name"] for f in state["schemas"][table]["fields"]]
        return self._merged(table, state["entries"], documents, state["schemas"][table]).select(*names)

    def _merged(self, table: str, entries: list[dict], documents: Iterable[int] | None, schema: dict) -> DataFrame:
        own = [e for e in entries if e["table"] == table and e["kind"] == "rows"]
        out = None
        for e in own:
            rows = self._frame(e, documents)
            later = [g for g in entries if g["kind"] == "gone" and table in g["tables"] and g["version"] > e["version"]]
            if later:
                gone = None
                for g in later:
                    ids = self._frame(g, documents).select(F.col("document_id").alias("_gone"))
                    gone = ids if gone is None else gone.union(ids)
                rows = rows.join(gone, F.col("document_id") == F.col("_gone"), "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            return self.spark.createDataFrame([], T.StructType.fromJson(schema)).withColumn("_version", F.lit(0))
        groups: dict[tuple, list[dict]] = {}
        for e in entries:
            if e["table"] == table and e["kind"] == "columns":
                groups.setdefault(tuple(f["name"] for f in e["schema"]["fields"] if f["name"] != "document_id"), []).append(e)
        changes: dict[str, list] = {}
        for k, (columns, parts) in enumerate(sorted(groups.items())):
            new = None
            for e in parts:
                frame = self._frame(e, documents)
                new = frame if new is None else new.unionByName(frame)
            last = new.groupBy(F.col("document_id").alias("_id")).agg(F.max_by(F.struct("_version", *columns), "_version").alias(f"_new{k}"))
            out = out.join(last, F.col("document_id") == F.col("_id"), "left").drop("_id")
            for c in columns:
                changes.setdefault(c, []).append(F.struct(F.col(f"_new{k}._version").alias("v"), F.col(f"_new{k}").getField(c).alias("x")))
        # of the changes of a column the last counts, if the row isn't newer
        last_of = {}
        for c, found in changes.items():
            best = F.array_max(F.transform(F.array(*[f["v"] for f in found]), lambda v: F.coalesce(v, F.lit(-1))))
            value = F.col(c) if c in out.columns else F.lit(None)
            for f in found:
                value = F.when((f["v"] == best) & (best > F.col("_version")), f["x"]).otherwise(value)
            last_of[c] = value
        return out.withColumns(last_of) if last_of else out

    # Keeping

    def compact(self, times: int = 2) -> None:
        """Merge each table's newest runs as long as the next older one has at most ``times`` their rows.  Where that takes
        in all of them, deletion vectors and column changes go, too."""
        state = self.state()
        version = state["version"] + 1
        entries = list(state["entries"])
        for table, schema in state["schemas"].items():
            own = sorted((e for e in entries if e["table"] == table and e["kind"] == "rows"), key=lambda e: -e["version"])
            taken, total = [], 0
            for e in own:
                if taken and e["rows"] > times * total:
                    break
                taken.append(e)
                total += e["rows"]
            touched = any(e["kind"] != "rows" and (table == e["table"] or table in e.get("tables", ())) for e in entries)
            if len(taken) < 2 and not (touched and len(taken) == len(own)):
                continue
            names = [f["name"] for f in schema["fields"]]
            others_ = [e for e in entries if e["kind"] != "rows" or e["table"] != table]
            merged = self._merged(table, [*others_, *taken], None, schema).select(*names)
            fresh = self._write(table, "rows", merged, state["version"])
            entries = [e for e in entries if e not in taken] + [fresh]
            if len(taken) == len(own):
                entries = [e for e in entries if not (e["kind"] == "columns" and e["table"] == table)]
                entries = [e | {"tables": [t for t in e["tables"] if t != table]} if e["kind"] == "gone" else e for e in entries]
        entries = [e for e in entries if e["rows"] and (e["kind"] != "gone" or e["tables"])]
        self._publish({"version": version, "schemas": state["schemas"], "entries": entries})

    def vacuum(self) -> None:
        """Delete earlier versions and the folders that only they name.  No reader of an earlier version may be at work."""
        jvm, folder, fs = self._file_system()
        *old, last = self._numbers() or [0]
        if not old:
            return
        named = {e["folder"] for e in self._load(last)["entries"]}
        for number in old:
            for e in self._load(number)["entries"]:
                if e["folder"] not in named:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{e['folder']}"), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{number:020d}.json"), False)

