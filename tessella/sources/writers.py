"""Writers: exports with manifests, unchanged content left alone, table dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.changes import changed_content


def export_posts(posts: DataFrame, path: str) -> DataFrame:
    """Writes posts as JSON by locale; returns the manifest (locale, posts, sha256 of the sorted content)."""
    posts.write.mode("overwrite").partitionBy("locale").json(path)
    rows = posts.select("locale", F.sha2(F.encode(F.to_json(F.struct(*[c for c in posts.columns if c != "locale"])), "UTF-8"), 256).alias("h"))
    # a sum of row digests needs no order and no row list per locale
    part = F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("locale").agg(F.count("*").alias("posts"), F.hex(F.sum(part).cast("long")).alias("digest"))


def write_changed(rows: DataFrame, key: str, content: str, manifest: DataFrame, path: str) -> DataFrame:
    """Appends only rows whose content differs from the manifest; returns (key, sha256, write) of all rows."""
    judged = changed_content(rows, key, content, manifest)
    judged.filter("write").drop("write").write.mode("append").parquet(path)
    return judged.select(key, "sha256", "write")


def dump(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """Every non-empty table of the catalog as JSON below path; returns (table, rows)."""
    names = tables or [t.name for t in spark.catalog.listTables()]
    counts = []
    for name in names:
        n = spark.table(name).count()
        counts.append((name, n))
        if n:
            spark.table(name).write.mode("overwrite").json(f"{path}/{name}")
    return spark.createDataFrame(counts, "table string, rows long")


def append_done(ids: DataFrame, path: str) -> None:
    """Adds ids to a checkpoint list of text lines."""
    ids.select(F.col("id").cast("string")).write.mode("append").text(path)
