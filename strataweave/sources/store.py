"""The store: Parquet deltas under one root, made visible by one manifest.

Every write goes to a new folder; a commit writes the next numbered manifest under a temporary name and renames it, so readers see all tables of a
commit or none, and of two writers with the same base one fails. Nothing is changed in place: tables are appended to, and keyed
tables give the row with the greatest sequence for each key. Only Hadoop's file API is used, so the root can be on any store that Spark reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.operators.artifacts import latest_per_key

FORMAT = 1
SPAN = "struct<source_id:string,unit_id:string,start:int,end:int,text:string>"
TABLES = {
    "source_artifact": "source_id string, source_version string, content_hash string, uri string, media_type string, labels array<string>, metadata string",
    "document_unit": "source_id string, source_version string, parse_version string, unit_id string, kind string, section string, text string, ordinal int, doc_start long, labels array<string>",
    "field_artifact": f"artifact_id string, record_id string, field_id string, entity string, status string, value_json string, reason string, value_hash string, evidence array<{SPAN}>, unlocated int, hashes map<string,string>, recipe_ref string, accepted boolean, actor string, schema_ref string, migration_id string, step_id string, execution_id string, lineage string, notes string, created_at string",
    "record_entity": "record_id string, entity string, collection_path string, local_id string, position int, parent string, version_id string",
    "record_version": "version_id string, record_id string, schema_ref string, state string, parent string, execution_id string, created_at string",
    "version_artifact": "version_id string, record_id string, artifact_id string",
    "record_index": "record_id string, schema_ref string, source_id string, source_version string, parse_version string, state string, version_id string, updated_at string, seq long",
    "execution": "execution_id string, plan_id string, target string, status string, metrics string, registry_hash string, created_at string, seq long",
    "execution_step": "execution_id string, step_key string, record_id string, migration_id string, step_id string, disposition string, state string, code string, message string, seq long",
    "attempt": "execution_id string, step_key string, level int, kind string, adapter string, attempt int, outcome string, message string",
    "answer_cache": "cache_key string, recipe_ref string, output string, cells array<struct<field_id:string,status:string,value_json:string,reason:string,quotes:array<string>>>, wants_more boolean, fingerprint string, created_at string",
    "review_item": "item_id string, record_id string, field_id string, entity string, reason string, old_value string, proposed_value string, state string, execution_id string, created_at string, seq long",
    "review_event": "event_id string, item_id string, record_id string, decision string, rationale string, edited_value string, created_at string",
    "plan": "plan_id string, target string, registry_hash string, summary string, created_at string",
}
#: Tables in which the greatest seq of a key stands for it.
KEYED = {"record_index": ["record_id"], "execution": ["execution_id"], "execution_step": ["execution_id", "step_key"], "review_item": ["item_id"]}
#: Tables whose rows are named by what they hold, so that a repeated row changes nothing.
UNIQUE = {"field_artifact": ["artifact_id"], "answer_cache": ["cache_key"], "review_event": ["event_id"], "source_artifact": ["source_id", "source_version"]}


class Transaction:
    def __init__(self, store: Store):
        self.store, self.base, self.added, self.documents, self.replaced = store, store.manifest(), {}, {}, {}

    @property
    def seq(self) -> int:
        """A number above that of every earlier commit; rows of keyed tables carry it."""
        return self.base["seq"] + 1

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows now (seen after the commit) and give them back as read from there. Columns are matched by name; missing ones are null."""
        schema = self.store.schema(name)
        have = set(df.columns)
        path = f"{self.store.root}/{name}/{uuid.uuid4().hex}"
        df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields)).write.parquet(path)
        self.added.setdefault(name, []).append(path.rsplit("/", 1)[-1])
        return self.store.spark.read.schema(schema).parquet(path)

    def append_new(self, name: str, df: DataFrame) -> DataFrame:
        """Append the rows whose key isn't stored yet, once each."""
        keys = UNIQUE[name]
        return self.append(name, df.dropDuplicates(keys).join(self.store.read(name).select(*keys), keys, "left_anti"))

    def document(self, name: str, value) -> None:
        self.documents[name] = value

    def replace(self, name: str, df: DataFrame) -> None:
        self.append(name, df)
        self.replaced[name] = True

    def commit(self) -> int:
        tables = {k: list(v) for k, v in self.base["tables"].items()}
        for name, dirs in self.added.items():
            tables[name] = dirs if self.replaced.get(name) else tables.get(name, []) + dirs
        self.store._put({"format": FORMAT, "seq": self.seq, "tables": tables, "documents": self.base["documents"] | self.documents})
        return self.seq


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._schemas: dict = {}
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self) -> dict:
        folder = self._path("_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json")]
        if not numbers:
            return {"format": FORMAT, "seq": 0, "tables": {}, "documents": {}}
        found = json.loads(self._text(self._path(f"_manifest/{max(numbers):012d}.json")))
        if found["format"] != FORMAT:
            raise EngineError("store_format", f"the store has format {found['format']}, this code reads {FORMAT}")
        return found

    def _put(self, manifest: dict) -> None:
        temporary, final = self._path(f"_manifest/{uuid.uuid4().hex}.tmp"), self._path(f"_manifest/{manifest['seq']:012d}.json")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode("utf-8")))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise EngineError("store_format", "another writer has committed meanwhile")

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Commits where the block ends well; else what it wrote stays unseen."""
        t = Transaction(self)
        yield t
        t.commit()

    def schema(self, name: str):
        if name not in self._schemas:
            self._schemas[name] = self.spark.createDataFrame([], TABLES[name]).schema
        return self._schemas[name]

    def raw(self, name: str) -> DataFrame:
        """All rows ever appended."""
        dirs = self.manifest()["tables"].get(name, [])
        schema = self.schema(name)
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{d}" for d in dirs))

    def read(self, name: str) -> DataFrame:
        rows = self.raw(name)
        return latest_per_key(rows, KEYED[name], ["seq"]) if name in KEYED else rows

    def document(self, name: str):
        return self.manifest()["documents"].get(name)

    def save_document(self, name: str, value) -> None:
        with self.transaction() as t:
            t.document(name, value)

    def latest_cells(self, records: DataFrame | None = None) -> DataFrame:
        """The newest cell of every slot (ties: the greatest artifact id), of these records."""
        rows = self.raw("field_artifact")
        if records is not None:
            rows = rows.join(records.select("record_id"), "record_id", "left_semi")
        return latest_per_key(rows, ["record_id", "field_id", "entity"], ["created_at", "artifact_id"])

    def current(self) -> DataFrame:
        """The index rows of records that have a published version."""
        return self.read("record_index").where("version_id IS NOT NULL")

    def version_cells(self, versions: DataFrame | None = None) -> DataFrame:
        """Cells of current (or given) versions."""
        versions = (self.current() if versions is None else versions).select("version_id")
        ids = self.raw("version_artifact").join(versions, "version_id", "left_semi").select("version_id", "artifact_id")
        return self.raw("field_artifact").join(ids, "artifact_id")

    def compact(self, name: str) -> None:
        """One folder in place of many; superseded rows of keyed tables go."""
        rows = self.read(name)
        with self.transaction() as t:
            t.replace(name, rows.dropDuplicates(UNIQUE[name]) if name in UNIQUE else rows)
