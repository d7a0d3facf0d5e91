"""Readers: JSON documents of several schemas, nested taxonomies, corpora, listings, paged services."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, doc (variant): one row per readable JSON file below path; corrupt files are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc")).filter("doc is not null")


def listed_documents(spark: SparkSession, path: str, patterns: tuple[str, ...], left_out: tuple[str, ...] = ()) -> DataFrame:
    """path, name, doc of the readable JSON files below path whose name fits one of the patterns (`*`, `?`) and none of those left out, by name, then path."""
    found = json_documents(spark, path, "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    for pattern in left_out:
        found = found.filter(~F.col("name").rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"))
    return found.select("path", "name", "doc").orderBy("name", "path")


def first_source(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read: a table, else a file. If none can, the last error is raised."""
    for k, source in enumerate(sources):
        try:
            found = source()
            found.schema  # noqa: B018 (a missing table or path shows here)
            return found
        except AnalysisException:
            if k == len(sources) - 1:
                raise
    raise ValueError("no source given")


def index_entries(documents: DataFrame) -> DataFrame:
    """path, filename, entry of index documents in any of their schemas.

    `subjects` or `items` lists of objects with a filename; `results` maps whose
    keys are file names or ids of objects that hold one.
    """
    text = documents.select("path", F.to_json("doc").alias("j"))
    lists = F.concat(*(F.coalesce(F.from_json(F.get_json_object("j", f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("subjects", "items")))
    from_lists = text.select("path", F.explode(lists).alias("entry")).select("path", F.get_json_object("entry", "$.filename").alias("filename"), "entry")
    maps = F.from_json(F.get_json_object("j", "$.results"), "map<string,string>")
    from_maps = text.select("path", F.explode(maps).alias("key", "entry")).select("path", F.coalesce(F.get_json_object("entry", "$.filename"), "key").alias("filename"), "entry")
    return from_lists.unionByName(from_maps).filter("filename is not null and filename <> ''")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """id, parent, name, weight of a nested three-level JSON taxonomy; nodes without id go with all below them."""
    node = "id:string,name_fr:string,weight:int"
    schema = f"children array<struct<{node},children:array<struct<{node},children:array<struct<{node}>>>>>>"
    nodes = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("children").alias("i", "n")).select(F.lit(None).cast("string").alias("parent"), "i", "n")
    levels = []
    for depth in range(3):
        nodes = nodes.filter("n.id is not null and trim(n.id) <> ''")
        levels.append(nodes.select("n.id", "parent", F.col("n.name_fr").alias("name"), F.coalesce("n.weight", "i").alias("weight")))
        if depth < 2:
            nodes = nodes.select(F.col("n.id").alias("parent"), F.posexplode("n.children").alias("i", "n"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def corpus(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value of a CSV file with a header; blank rows go."""
    rows = spark.read.csv(path, header=True).select(F.trim(key).alias("key"), F.trim(value).alias("value"))
    return rows.filter("key <> '' and value <> ''")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file (`#` comments), a JSON array or the keys of a JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = whole.filter("startswith(v, '[')").select(F.explode(F.from_json("v", "array<string>")).alias("id"))
    keyed = whole.filter("startswith(v, '{')").select(F.explode(F.map_keys(F.from_json("v", "map<string,string>"))).alias("id"))
    lines = whole.filter("not v rlike '^[\\\\[{]'").select(F.explode(F.split("v", "\n")).alias("id")).select(F.trim(F.regexp_replace("id", "#.*$", "")).alias("id"))
    return listed.unionByName(keyed).unionByName(lines).filter("id <> ''").distinct()


def not_done(rows: DataFrame, id: str, done: DataFrame) -> DataFrame:
    """Rows whose id a checkpoint list doesn't name yet."""
    return rows.join(done.select(F.col("id").alias(id)), id, "left_anti")


def directories(spark: SparkSession, path: str, suffix: str = ".png") -> DataFrame:
    """directory, files, modified of each directory with files of a suffix, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "modificationTime")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(folder.alias("directory")).agg(F.count("*").alias("files"), F.max("modificationTime").alias("modified")).orderBy(F.desc("modified"), "directory")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path, fields map<string, string>, body of Markdown files with a `---` header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), "^[\"']|[\"']$", ""))
    return files.select("path", F.map_from_entries(F.transform(lines, pair)).alias("fields"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("body"))


class PagedSource(DataSource):
    """Rows of a paged service: `fetch(offset, limit)` until a short page; each lane reads every lanes-th page.

    Options: limit, lanes. The fetch function and schema are given by `paged`.
    """

    fetch: Callable[[int, int], list[tuple]]
    ddl: str

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return type(self).ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("limit", "100")), int(self.options.get("lanes", "1")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[tuple]], limit: int, lanes: int):
        self.fetch, self.limit, self.lanes = fetch, limit, lanes

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value
        while True:
            rows = self.fetch(page * self.limit, self.limit)
            yield from rows
            if len(rows) < self.limit:
                return
            page += self.lanes


def paged(spark: SparkSession, fetch: Callable[[int, int], list[tuple]], schema: str, limit: int = 100, lanes: int = 1) -> DataFrame:
    source = type("Paged", (PagedSource,), {"fetch": staticmethod(fetch), "ddl": schema})
    spark.dataSource.register(source)
    return spark.read.format("paged").option("limit", limit).option("lanes", lanes).load()
