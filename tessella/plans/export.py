"""The export flow: eligible leaves, best image each, unique slugs, one post a locale, a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import rules, tables

ACCEPTED = ("ok", "soft_caps_violated")


def best_images(annotations: DataFrame, leaves: DataFrame, least: int = 1) -> DataFrame:
    """leaf_id, target_id, score: per leaf the publishable image of the best score, the latest of equals.

    A file belongs to the leaf whose id is its longest token prefix.
    """
    named = annotations.filter((F.col("target_id") != "") & (F.coalesce("score", F.lit(0)) >= least)).withColumn("name", text.stem(F.col("target_id")))
    matched = tables.longest_prefix(named, "name", leaves, "leaf_id").filter("match is not null")
    best = tables.best(matched, ["match"], F.desc_nulls_last("score"), F.desc_nulls_last("updated_at"), F.col("target_id"))
    return best.select(F.col("match").alias("leaf_id"), "target_id", "score")


def decide(leaves: DataFrame, images: DataFrame, locales: tuple[str, ...] = rules.LOCALES) -> DataFrame:
    """Each leaf with its r2 slug, posts array<struct<locale, slug>> and outcome (kept or why not)."""
    fields = {f"{kind}_{loc}": F.col(f"{kind}_{loc}") for kind in ("title", "description") for loc in locales}
    posts = F.array(*(F.struct(F.lit(loc).alias("locale"), text.post_slug(F.col(f"name_{loc}"), F.lit(loc))["slug"].alias("slug")) for loc in locales))
    known = leaves.join(images, "leaf_id", "left").withColumn("r2", text.r2_slug(F.col("name_en"))["slug"]).withColumn("posts", posts)
    why = (
        F.when(~F.coalesce(F.col("status").isin(*ACCEPTED), F.lit(False)), "status")
        .when(F.size(rules.hard_violations(fields)) > 0, "hard_caps")
        .when(F.col("target_id").isNull(), "no_image")
        .when(F.col("r2").isNull() | F.exists("posts", lambda p: p["slug"].isNull()), "slug")
    )
    judged = known.withColumn("why", why)
    kept = tables.unique_slugs(judged.filter("why is null").drop("why"), "leaf_id", "r2", "posts")
    return kept.unionByName(judged.filter("why is not null").withColumnRenamed("why", "outcome"))


def posts(decided: DataFrame, date: str) -> DataFrame:
    """One row per kept leaf and locale, as the export writes it."""
    each = decided.filter("outcome = 'kept'").withColumn("p", F.explode("posts"))
    pick = lambda kind: F.coalesce(*(F.when(F.col("p.locale") == loc, F.col(f"{kind}_{loc}")) for loc in rules.LOCALES))
    return each.select(
        F.col("p.locale").alias("locale"),
        F.col("p.slug").alias("slug"),
        F.col("r2").alias("r2_slug"),
        pick("title").alias("title"),
        F.substring(pick("title"), 1, 40).alias("title_card"),
        pick("description").alias("description"),
        text.category(F.col("leaf_id")).alias("categoryId"),
        F.lit(4).alias("ageMin"),
        F.lit(10).alias("ageMax"),
        F.lit("easy").alias("niveauDifficulte"),
        F.lit("approved").alias("status"),
        F.lit(date).alias("datePublication"),
        F.lit(False).alias("featured"),
        F.col("target_id").alias("image"),
        "leaf_id",
    )


def outcomes(decided: DataFrame) -> DataFrame:
    return decided.groupBy("outcome").agg(F.count("*").alias("n"))
