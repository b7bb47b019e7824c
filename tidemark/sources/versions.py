"""Tables of Parquet files that are changed part by part, each change published as a whole.

Rows lie in parts by a hash of their key. A version of a table is a manifest, which lists the files of each
part; readers open the newest one and never see half of a change. A change writes new files for the
parts that its keys touch only, then publishes a manifest that names them in the place of the old
ones; files of other parts keep their names. Manifests are numbered, and one is put in place by a rename that
fails where that number is taken: of two changes at a time one comes first. The other one looks again: if
the first has touched other parts it is published on top, else it is worked out anew, up to TRIES
times, after waits that double (25 ms, 200 ms at most, with a random part).

What attempts leave behind is named by no manifest and is never read; ``clean`` deletes it. The rename is
as atomic as the store's own (HDFS, a local disk).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries of a change, and its waits in seconds (fixed values).
TRIES, FIRST_WAIT, LONGEST_WAIT = 6, 0.025, 0.2


class Conflict(Exception):
    """A change that others overtook at every try."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its number, key, number of parts, schema, and the files of each part."""

    number: int
    key: str
    parts: int
    schema: str
    files: dict[int, list[str]]


def _place(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _place(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place = _place(spark, path)
    store = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def latest(spark: SparkSession, path: str) -> Version:
    """The newest version of a table."""
    number = max(int(n[1:-5]) for n in _names(spark, f"{path}/versions") if n.startswith("v") and n.endswith(".json"))
    (row,) = spark.read.text(f"{path}/versions/v{number}.json", wholetext=True).collect()
    held = json.loads(row[0])
    return Version(number, held["key"], held["parts"], held["schema"], {int(p): f for p, f in held["files"].items()})


def _publish(spark: SparkSession, path: str, version: Version) -> bool:
    """Put a manifest in place unless its number is taken."""
    draft, final = f"{path}/versions/draft-{uuid.uuid4().hex}", f"{path}/versions/v{version.number}.json"
    out = _store(spark, path).create(_place(spark, draft))
    body = {"key": version.key, "parts": version.parts, "schema": version.schema, "files": version.files}
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_place(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_place(spark, draft), _place(spark, final), options)
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        _store(spark, path).delete(_place(spark, draft), False)
        return False


def part_of(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _written(rows: DataFrame, path: str, key: str, parts: int) -> dict[int, list[str]]:
    """Files of rows by part, in a folder of their own."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn("_part", part_of(key, parts)).repartition("_part")
    dealt.write.partitionBy("_part").parquet(f"{path}/{folder}")
    out: dict[int, list[str]] = {}
    for name in _names(spark, f"{path}/{folder}"):
        if name.startswith("_part="):
            files = [f for f in _names(spark, f"{path}/{folder}/{name}") if f.endswith(".parquet")]
            out[int(name.removeprefix("_part="))] = [f"{folder}/{name}/{f}" for f in sorted(files)]
    return out


def create(rows: DataFrame, path: str, key: str, parts: int = 64) -> Version:
    """A table of rows, whose key is never null; its first version."""
    first = Version(1, key, parts, rows.schema.json(), _written(rows, path, key, parts))
    if not _publish(rows.sparkSession, path, first):
        raise Conflict(f"a table is at {path} already")
    return first


def read(spark: SparkSession, path: str, version: Version | None = None, parts: list[int] | None = None) -> DataFrame:
    """The rows of a version (the newest if none is given), of some parts only where they are given."""
    from pyspark.sql.types import StructType

    version = version or latest(spark, path)
    files = [f"{path}/{f}" for p, held in sorted(version.files.items()) if parts is None or p in parts for f in held]
    schema = StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def change(spark: SparkSession, path: str, touched: Callable[[Version], list[int]], made: Callable[[DataFrame], DataFrame]) -> Version:
    """Publish ``made(old rows)`` in the place of the rows of the parts that ``touched`` names.

    ``made`` must keep rows in their parts, so it may not change keys to others of parts that aren't touched.
    """
    for attempt in range(TRIES):
        base = latest(spark, path)
        parts = touched(base)
        if not parts:
            return base
        files = _written(made(read(spark, path, base, parts)), path, base.key, base.parts)
        if not set(files) <= set(parts):
            raise ValueError("rows of parts that aren't touched")
        newest = base
        while all(newest.files.get(p) == base.files.get(p) for p in parts):
            held = {p: f for p, f in newest.files.items() if p not in parts} | files
            after = Version(newest.number + 1, base.key, base.parts, base.schema, held)
            if _publish(spark, path, after):
                return after
            newest = latest(spark, path)
        time.sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) * (1 + random.random()))
    raise Conflict(f"overtaken {TRIES} times")


def _parts_of(rows: DataFrame, version: Version) -> list[int]:
    found = rows.select(part_of(version.key, version.parts).alias("p")).distinct().collect()  # parts at most
    return sorted(r["p"] for r in found)


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> Version:
    """Put rows in, in the place of those with their keys. Keys of rows don't repeat."""
    key = latest(spark, path).key
    return change(
        spark, path, lambda v: _parts_of(rows, v),
        lambda old: old.join(rows.select(key), key, "left_anti").unionByName(rows.select(*old.columns)),
    )


def insert_new(spark: SparkSession, path: str, rows: DataFrame) -> Version:
    """Put in the rows whose keys aren't there yet."""
    key = latest(spark, path).key
    return change(
        spark, path, lambda v: _parts_of(rows, v),
        lambda old: old.unionByName(rows.join(old.select(key), key, "left_anti").select(*old.columns)),
    )


def delete_where(spark: SparkSession, path: str, condition: Column) -> Version:
    """Take out the rows for which a condition is true; only the parts that have such rows are written."""
    return change(
        spark, path, lambda v: _parts_of(read(spark, path, v).where(condition), v),
        lambda old: old.where(~F.coalesce(condition, F.lit(False))),
    )


def delete_keys(spark: SparkSession, path: str, keys: DataFrame) -> Version:
    """Take out the rows with some keys, as a cascade from another table does."""
    key = latest(spark, path).key
    return change(spark, path, lambda v: _parts_of(keys, v), lambda old: old.join(keys.select(key), key, "left_anti"))


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete folders of data that none of the last ``keep`` versions names; how many they were. Not while changes run."""
    numbers = sorted(int(n[1:-5]) for n in _names(spark, f"{path}/versions") if n.startswith("v"))
    used = set()
    for n in numbers[-keep:]:
        held = json.loads(spark.read.text(f"{path}/versions/v{n}.json", wholetext=True).first()[0])
        used |= {f.split("/")[1] for files in held["files"].values() for f in files}
    gone = [d for d in _names(spark, f"{path}/data") if d not in used]
    for d in gone:
        _store(spark, path).delete(_place(spark, f"{path}/data/{d}"), True)
    for n in numbers[:-keep]:
        _store(spark, path).delete(_place(spark, f"{path}/versions/v{n}.json"), False)
    return len(gone)
