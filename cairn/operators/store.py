"""Content-addressed materialisation, publication, retention and schemas of persisted tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.fingerprint import fingerprints
from cairn.session import drop_path

READABLE, CURRENT = range(5, 12), 11


def check_version(version: int) -> None:
    if version not in READABLE:
        raise ValueError(f"schema version {version} is outside {READABLE.start} to {READABLE.stop - 1}")


def input_hash(files: DataFrame) -> DataFrame:
    """project, hash: one hash over the (path, content hash) of each project's inputs."""
    return fingerprints(files, ["project"], F.concat_ws("|", "path", "content_hash"), "hash")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it is there; of two writers one gets False. Stores without atomic creation need a lock beside this."""
    fs, p = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # the file system's own kind of "exists already"
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def materialise(spark: SparkSession, root: str, name: str, key: str, make) -> tuple[DataFrame, bool]:
    """The table of a content key below root/name; made and written if no one has. Second value: cache hit.

    Every maker writes a folder of its own and then puts the key's entry, which names the folder. The entry is put once: a
    maker that comes second reads the first one's folder and drops its own, so no reader ever loses files.
    """
    entry = f"{root}/{name}/key={key}.json"
    hit = _exists(spark, entry)
    if not hit:
        folder = f"{root}/{name}/made-{uuid.uuid4().hex}"
        make().write.parquet(folder)
        if not put_if_absent(spark, entry, json.dumps({"folder": folder})):
            drop_path(spark, folder)
    return spark.read.parquet(json.loads(_text(spark, entry))["folder"]), hit


class Lost(Exception):
    """Another writer published first; nothing of this one is left."""


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Manifests of a published table, oldest first."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().startswith("manifest-")) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: number, slices (slice -> folder); number 0 where nothing is published."""
    found = _manifests(spark, path)
    return json.loads(_text(spark, found[-1])) if found else {"number": 0, "slices": {}}


def _put_manifest(spark: SparkSession, path: str, number: int, slices: dict[str, str], made: list[str]) -> None:
    if not put_if_absent(spark, f"{path}/manifest-{number:09d}.json", json.dumps({"number": number, "slices": slices})):
        for folder in made:
            drop_path(spark, folder)
        raise Lost(f"{path} has a publication {number} already")


def publish(df: DataFrame, path: str, version: int = CURRENT, replace: bool = False, by: list[str] | None = None, seen: int | None = None) -> int:
    """Write a snapshot with its schema version and put its manifest; refuses to replace unless told to. Returns its number.

    The data are a folder of their own; the manifest is put if absent under the number after `seen` (the newest, if not
    given), so of two writers that saw the same state one loses cleanly. Readers follow a manifest and so see the old
    snapshot or the new one. Old folders stay until retire().
    """
    check_version(version)
    spark = df.sparkSession
    old = manifest(spark, path)
    if old["number"] and not replace:
        raise FileExistsError(f"{path} is published already")
    folder = f"{path}/data-{uuid.uuid4().hex}"
    df.withColumn("schema_version", F.lit(version)).write.partitionBy(*(by or [])).parquet(folder)
    number = (old["number"] if seen is None else seen) + 1
    _put_manifest(spark, path, number, {"": folder}, [folder])
    return number


def publish_slices(df: DataFrame, path: str, by: str, version: int = CURRENT, gone: list[str] | None = None, seen: int | None = None) -> int:
    """Publish the slices (values of column `by`) that df has, below one manifest; all others keep their folders and files.

    gone: slices to leave out from now on. All changed slices are written by one job into one folder, a partition each.
    """
    check_version(version)
    spark = df.sparkSession
    old = manifest(spark, path)
    folder = f"{path}/data-{uuid.uuid4().hex}"
    named = df.withColumn("schema_version", F.lit(version)).withColumn("__slice", F.sha2(F.col(by).cast("string"), 256))
    named.write.partitionBy("__slice").parquet(folder)
    changed = [r[0] for r in df.select(F.col(by).cast("string")).distinct().collect()]  # one name for each slice
    slices = {k: v for k, v in old["slices"].items() if k not in (gone or [])}
    slices |= {k: f"{folder}/__slice={hashlib.sha256(k.encode()).hexdigest()}" for k in changed}
    number = (old["number"] if seen is None else seen) + 1
    _put_manifest(spark, path, number, slices, [folder])
    return number


def retire(spark: SparkSession, path: str, grace_seconds: float) -> list[str]:
    """Delete data folders that the newest manifest does not name and that have not been changed for the grace period.

    A reader may hold an older snapshot for as long as the grace period; a writer must put its manifest within it.
    """
    fs, p = _path(spark, path)
    now = manifest(spark, path)
    used = {v.split("/data-")[1].split("/")[0] for v in now["slices"].values()}
    old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("data-") and x.getPath().getName()[5:] not in used and x.getModificationTime() < (time.time() - grace_seconds) * 1000]
    for folder in old:
        drop_path(spark, folder.toString())
    return sorted(x.toString() for x in old)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published snapshot; versions outside the window are an error, raised where the rows are read."""
    slices = manifest(spark, path)["slices"]
    if not slices:
        raise FileNotFoundError(f"nothing is published at {path}")
    df = spark.read.parquet(*sorted(set(slices.values())))
    bad = F.raise_error(F.lit("unreadable schema version")).cast("boolean")
    return df.where(F.when(F.col("schema_version").between(READABLE.start, READABLE.stop - 1), F.lit(True)).otherwise(bad))


def reset(spark: SparkSession, root: str, keep: list[str]) -> list[str]:
    """Delete generated state below root but for the names to keep (configuration); what was deleted, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName() not in keep) if fs.exists(p) else []
    for name in gone:
        drop_path(spark, f"{root}/{name}")
    return gone


def keep_newest(reports: DataFrame, n: int) -> DataFrame:
    """The reports (path, modified) beyond the n newest of each folder, to be deleted."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy(F.desc("modified"), F.desc("path"))
    return reports.withColumn("n", F.row_number().over(w)).where(F.col("n") > n).drop("n")


def json_schema(schema: T.StructType, name: str) -> str:
    """A draft 2020-12 JSON schema of a table's rows: all fields required, none besides, in order of name."""

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return {"type": "object", "properties": {f.name: (of(f.dataType) if not f.nullable else {"anyOf": [of(f.dataType), {"type": "null"}]}) for f in fields}, "required": [f.name for f in fields], "additionalProperties": False}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, T.MapType):
            return {"type": "object", "additionalProperties": of(kind.valueType)}
        if isinstance(kind, T.TimestampType):
            return {"type": "string", "format": "date-time"}
        if isinstance(kind, T.BooleanType):
            return {"type": "boolean"}
        if isinstance(kind, T.IntegralType):
            return {"type": "integer"}
        return {"type": "number"} if isinstance(kind, T.NumericType) else {"type": "string"}

    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, **of(schema)}, indent=2)
