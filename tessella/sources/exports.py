"""Exports of one file a key with commit and rollback, and single files written whole or not at all.

`spark.dataSource.register(KeyedFiles)` makes the format `keyed_files`: tasks
stage one JSON file for each (folder, name) beside the target, the driver's
commit moves the changed ones to their places and writes the manifest last. A
task or job that fails leaves the former export as it was; files whose content
has not changed are not written. Paths are folders that the driver and all tasks
see (a shared mount).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


def write_whole(path: Path, data: bytes) -> None:
    """The file has either its old or its new content at any time: written under another name, forced to disk, renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        with beside.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        beside.replace(path)
    finally:
        beside.unlink(missing_ok=True)


def safe_name(part: str) -> bool:
    """One step of a path, not hidden, that stays inside its folder."""
    return bool(part) and part[0] != "." and not any(c in part for c in '/\\\0\n')


@dataclass
class Staged(WriterCommitMessage):
    """What one task leaves for the commit: counts, and a list of its files in its staging folder."""

    listing: str = ""
    staged: int = 0
    unchanged: int = 0


def sweep(staging: Path) -> None:
    """Removes a staging folder, as far as no task that is about to be stopped still writes there."""
    for folder, _, names in os.walk(staging, topdown=False):
        for name in names:
            Path(folder, name).unlink(missing_ok=True)
        with contextlib.suppress(OSError):
            os.rmdir(folder)


class KeyedWriter(DataSourceWriter):
    """Rows (folder, name, content): content goes to <path>/<folder>/<name>.json."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def _staging(self) -> Path:
        return Path(self.root) / f".staging-{self.run}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        task = self._staging() / uuid.uuid4().hex
        task.mkdir(parents=True)
        done = Staged(str(task / "listing"))
        with open(done.listing, "w") as listing:
            for k, row in enumerate(rows):
                if not (safe_name(row["folder"]) and safe_name(row["name"])):
                    raise ValueError(f"no place in the export: {row['folder']!r}, {row['name']!r}")
                data = row["content"].encode()
                digest = hashlib.sha256(data).hexdigest()
                target = Path(self.root) / row["folder"] / f"{row['name']}.json"
                same = target.exists() and hashlib.sha256(target.read_bytes()).hexdigest() == digest
                if same:
                    done.unchanged += 1
                else:
                    (task / str(k)).write_bytes(data)
                    done.staged += 1
                listing.write(json.dumps([row["folder"], row["name"], digest, "" if same else str(task / str(k))]) + "\n")
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves what was staged, file by file, from listings on disk; a journal there leads back if a move fails."""
        listings = [m.listing for m in messages if m]
        journal = self._staging() / "journal"
        manifest: dict[str, list[int]] = {}
        self._staging().mkdir(parents=True, exist_ok=True)
        try:
            with journal.open("w") as log:
                for k, (folder, name, digest, staged) in enumerate(self._entries(listings)):
                    total = manifest.setdefault(folder, [0, 0])
                    total[0] += 1
                    total[1] = (total[1] + int(digest[:16], 16)) % 2**64  # needs no order
                    if staged:
                        target, kept = Path(self.root) / folder / f"{name}.json", self._staging() / f"old-{k}"
                        target.parent.mkdir(parents=True, exist_ok=True)
                        if target.exists():
                            os.link(target, kept)
                        log.write(json.dumps([str(target), str(kept)]) + "\n")
                        log.flush()
                        os.replace(staged, target)
            data = json.dumps({k: {"files": n, "digest": f"{d:016x}"} for k, (n, d) in sorted(manifest.items())}, indent=1).encode()
            place = Path(self.root) / MANIFEST
            if not place.exists() or place.read_bytes() != data:
                write_whole(place, data)
        except BaseException:
            for target, kept in self._entries([str(journal)]):
                if os.path.exists(kept):
                    os.replace(kept, target)
                else:
                    Path(target).unlink(missing_ok=True)
            self.abort(messages)
            raise
        self.abort(messages)  # nothing but the emptied staging folder is left

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        sweep(self._staging())

    @staticmethod
    def _entries(listings: list[str]) -> Iterator[list[str]]:
        for listing in listings:
            with open(listing) as lines:
                yield from map(json.loads, lines)


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "folder string, name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return KeyedWriter(self.options["path"], self.options.get("run", uuid.uuid4().hex))


def export_keyed(rows: DataFrame, folder: str, name: str, path: str) -> DataFrame:
    """Writes each row as JSON (nulls too) to <path>/<folder>/<name>.json; returns folder, files and digest of the new manifest.

    Files of former exports whose key is gone stay. A second run with equal rows
    writes nothing. A key that occurs twice stops the export before anything is
    staged.
    """
    spark = rows.sparkSession
    if twice := rows.groupBy(folder, name).count().filter("count > 1").select(folder, name).head(1):
        raise ValueError(f"more than one row for {twice[0][0]}/{twice[0][1]}")
    spark.dataSource.register(KeyedFiles)
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    staged = rows.select(F.col(folder).alias("folder"), F.col(name).alias("name"), content.alias("content"))
    run = uuid.uuid4().hex
    try:
        staged.write.format("keyed_files").option("run", run).mode("append").save(path)
    except BaseException:
        # tasks of a failed job run on for a moment and may stage more after the abort
        gone = 0
        for _ in range(100):
            sweep(Path(path) / f".staging-{run}")
            gone = 0 if (Path(path) / f".staging-{run}").exists() else gone + 1
            if gone == 5:
                break
            time.sleep(0.1)
        raise
    body = json.loads((Path(path) / MANIFEST).read_bytes())
    return spark.createDataFrame([(k, v["files"], v["digest"]) for k, v in body.items()], "folder string, files long, digest string")


def upload_plan(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """key, write: whether a body goes to the store. objects (key, body binary, master_md5), stored (key, etag, master_md5).

    An object whose stored master digest is known is skipped if it is equal; one
    stored before such digests were kept is skipped if its entity tag is the
    body's MD5. Everything else is written.
    """
    known = stored.select("key", F.regexp_replace("etag", '^"+|"+$', "").alias("__etag"), F.coalesce("master_md5", F.lit("")).alias("__master"), F.lit(True).alias("__there"))
    master = F.coalesce("master_md5", F.lit(""))
    same = F.when((F.col("__master") != "") & (master != ""), F.col("__master") == master).when(F.col("__master") == "", F.col("__etag") == F.md5("body")).otherwise(False)
    return objects.join(known, "key", "left").select("key", (~(F.coalesce("__there", F.lit(False)) & F.coalesce(same, F.lit(False)))).alias("write"))


def json_safe(rows: DataFrame) -> DataFrame:
    """json: each row as JSON text. Binary is read as UTF-8 (each invalid byte as U+FFFD), numbers that JSON lacks become null, all other types have their JSON form or their text."""

    def plain(c: str, kind: str):
        value = F.col(f"`{c}`")
        if kind == "binary":
            return F.decode(value, "UTF-8").alias(c)
        if kind in ("float", "double"):
            return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias(c)
        if kind.startswith(("interval", "void")):
            return value.cast("string").alias(c)
        return value

    return rows.select(F.to_json(F.struct(*(plain(c, kind) for c, kind in rows.dtypes)), {"ignoreNullFields": "false"}).alias("json"))
