"""Quality and publication rules as column expressions and grouped gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import has_latin, intrinsic_color
from tessella.functions.values import half_even, is_blank

LOCALES = ("fr", "en", "ar")
# Lengths of titles and descriptions.
HARD = {"title": (5, 100), "description": (20, 200)}
SOFT = {"title": {"fr": (40, 60), "en": (40, 60), "ar": (25, 55)}, "description": {"fr": (80, 130), "en": (80, 130), "ar": (40, 115)}}
# Thresholds of the image checks.
COLOR_RESIDUAL, LOW_CONTRAST, FEW_EDGES, BLACK = 0.001, 30.0, 500, 0.50


def _length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def hard_violations(fields: dict[str, Column]) -> Column:
    """array<string> of fields (`title_fr`, ...) whose length is out of the hard bounds."""
    tests = []
    for name, c in fields.items():
        low, high = HARD[name.split("_")[0]]
        tests.append(F.when(~_length(c).between(low, high), F.concat(F.lit(f"{name} len="), _length(c), F.lit(f" [{low},{high}]"))))
    return F.array_compact(F.array(*tests))


def soft_violations(fields: dict[str, Column]) -> Column:
    """array<struct<field, length, kind>>: too_short or too_long by the soft bounds."""
    tests = []
    for name, c in fields.items():
        kind, locale = name.split("_")
        low, high = SOFT[kind][locale]
        what = F.when(_length(c) < low, "too_short").when(_length(c) > high, "too_long")
        tests.append(F.when(what.isNotNull(), F.struct(F.lit(name).alias("field"), _length(c).alias("length"), what.alias("kind"))))
    return F.array_compact(F.array(*tests))


def qc_tags(readable: Column, color_ratio: Column, contrast: Column, edges: Column, black_ratio: Column, leaf: Column) -> Column:
    """Tags of an image's metrics; `qc_ok` when no real defect is found."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    defects = [
        (zero(color_ratio) > COLOR_RESIDUAL, "qc_color_residual"),
        (intrinsic_color(leaf), "qc_color_intrinsic"),
        (zero(contrast) < LOW_CONTRAST, "qc_low_contrast"),
        (zero(edges) < FEW_EDGES, "qc_low_complexity"),
        (zero(black_ratio) > BLACK, "qc_oversaturated"),
    ]
    tags = F.array_compact(F.array(*(F.when(test, F.lit(tag)) for test, tag in defects)))
    clean = F.size(F.array_remove(tags, "qc_color_intrinsic")) == 0
    return F.when(~F.coalesce(readable, F.lit(False)), F.array(F.lit("qc_unreadable"))).when(clean, F.array_append(tags, F.lit("qc_ok"))).otherwise(tags)


def severities(color: Column, white: Column, ink: Column, spread: Column, edge_ink: Column, core_ink: Column) -> Column:
    """array<struct<id, severity>> of the six technical checks."""
    level = lambda fail, warn: F.when(fail, "fail").when(warn, "warn").otherwise("pass")
    checks = {
        "color_presence": level(color > 0.08, color > 0.025),
        "background_whiteness": level(white < 0.12, white < 0.22),
        "ink_density": F.when(ink < 0.0015, "fail").when(ink < 0.004, "warn").when(ink > 0.55, "fail").when(ink > 0.48, "warn").otherwise("pass"),
        "contrast": level(spread < 0.08, spread < 0.12),
        "empty_or_near_empty": level(ink < 0.0008, ink < 0.002),
        "border_clipping": F.when((edge_ink > 0.22) & (edge_ink > F.greatest(core_ink, F.lit(1e-5)) * 2.2), "warn").otherwise("pass"),
    }
    return F.array(*(F.struct(F.lit(k).alias("id"), v.alias("severity")) for k, v in checks.items()))


def technical_score(checks: Column) -> Column:
    """0 to 100: mean of 1, 0.65 and 0 for pass, warn and fail."""
    points = F.aggregate(checks, F.lit(0.0), lambda acc, x: acc + F.when(x["severity"] == "pass", 1.0).when(x["severity"] == "warn", 0.65).otherwise(0.0))
    return half_even(100 * points / F.size(checks)).cast("int")


def technical_status(checks: Column) -> Column:
    has = lambda s: F.exists(checks, lambda x: x["severity"] == s)
    return F.when(has("fail"), "fail").when(has("warn"), "warning").otherwise("pass")


def publish_gate(rows: DataFrame, key: str, locale: str, fields: list[str], status: str, valid: tuple[str, ...], locales: tuple[str, ...] = LOCALES) -> DataFrame:
    """Per key: missing and unexpected locales, rows with blank fields or a wrong status, and whether it is ready."""
    blank = F.lit(False)
    for f in fields:
        blank = blank | is_blank(F.col(f))
    want = F.array(*(F.lit(x) for x in locales))
    sums = rows.groupBy(key).agg(F.collect_set(locale).alias("have"), F.count_if(blank).alias("n_blank"), F.count_if(~F.coalesce(F.col(status).isin(*valid), F.lit(False))).alias("n_status"), F.count("*").alias("n_rows"))
    out = sums.select(key, F.array_sort(F.array_except(want, "have")).alias("missing"), F.array_sort(F.array_except("have", want)).alias("extra"), "n_blank", "n_status", "n_rows")
    ready = (F.size("missing") == 0) & (F.size("extra") == 0) & (F.col("n_blank") == 0) & (F.col("n_status") == 0) & (F.col("n_rows") == len(locales))
    return out.withColumn("ready", ready)


def missing_variants(items: DataFrame, key: str, variants: list[str], existing: DataFrame) -> DataFrame:
    """Pairs (key, variant) that do not exist yet; the variants are a fixed list, so each item gives that many rows."""
    wanted = items.select(key, F.explode(F.array(*(F.lit(v) for v in variants))).alias("variant"))
    return wanted.join(existing.select(key, "variant").distinct(), [key, "variant"], "left_anti")


def sync_action(blocked: Column, remote_hash: Column, hash: Column, add_only: bool = False) -> Column:
    """What to do with a post: blocked, add, skip (same content, or add-only), update."""
    return F.when(blocked, "blocked").when(remote_hash.isNull(), "add").when((remote_hash == hash) | F.lit(add_only), "skip").otherwise("update")


# Lengths of texts by language, and how many keywords there are.
CONTENT = {"en": {"title": (40, 60), "card": 30, "description": (80, 130)}, "fr": {"title": (40, 60), "card": 30, "description": (80, 130)}, "ar": {"title": (25, 55), "card": 25, "description": (40, 115)}}
KEYWORDS = 5


def content_violations(locale: str, title: Column, card: Column, description: Column, keywords: Column) -> Column:
    """array<string>: lengths out of the locale's bounds, and a number of keywords that is not KEYWORDS; for Arabic also Latin letters."""
    bounds = CONTENT[locale]
    (t0, t1), (d0, d1) = bounds["title"], bounds["description"]
    count = F.coalesce(F.size(keywords), F.lit(0))
    tests = [
        F.when(~_length(title).between(t0, t1), F.concat(F.lit("title_len="), _length(title))),
        F.when(_length(card) > bounds["card"], F.concat(F.lit("title_card_len="), _length(card))),
        F.when(~_length(description).between(d0, d1), F.concat(F.lit("description_len="), _length(description))),
        F.when(count != KEYWORDS, F.concat(F.lit("keywords_count="), count)),
    ]
    if locale == "ar":
        tests.append(F.when(has_latin(F.concat_ws(" ", title, card, description, keywords)), F.lit("latin_chars_in_ar")))
    return F.array_compact(F.array(*tests))


def review_flags(arabic_hard: Column, arabic_anchor: Column, others: dict[str, Column]) -> Column:
    """array<string>: what a person should look at after generation."""
    return F.array_compact(
        F.array(
            F.when(F.size(arabic_hard) > 0, F.lit("ar_invalid")),
            F.when(~F.coalesce(arabic_anchor, F.lit(False)), F.lit("ar_anchor_missing")),
            *(F.when(F.size(v) > 0, F.lit(f"{locale}_bounds")) for locale, v in others.items()),
        )
    )


def _given(config: Column, key: str) -> Column:
    return F.coalesce(F.trim(F.get_json_object(config, f"$.{key}")), F.lit("")) != ""


def _filled_list(config: Column, key: str, most: int | None = None) -> Column:
    n = F.coalesce(F.json_array_length(F.get_json_object(config, f"$.{key}")), F.lit(0))
    return (n > 0) & (n <= most) if most else n > 0


def _count_within(config: Column, most: int) -> Column:
    raw = F.get_json_object(config, "$.count")
    return raw.isNull() | F.coalesce(raw.rlike(r"^-?\d+$") & raw.try_cast("int").between(1, most), F.lit(False))


def enqueue_error(job_type: Column, config: Column) -> Column:
    """Why a job of a type may not be queued with a config (JSON text): the missing or bad key; null if it may."""
    has, both = (lambda k: _given(config, k)), (lambda *keys: [(_given(config, k), f"{k} required") for k in keys])
    # What each type of job needs.
    needs: dict[str, list[tuple[Column, str]]] = {
        "text_enrichment": both("prompt"),
        "taxonomy_enrich_term": both("vocabulary_id", "term_id"),
        "taxonomy_enrich_terms_batch": [(_filled_list(config, "term_ids"), "term_ids required"), *both("vocabulary_id")],
        "taxonomy_enrich_keywords": both("vocabulary_id", "term_id"),
        "taxonomy_suggest_children": both("vocabulary_id", "term_id"),
        "taxonomy_generate_vocabulary": [*both("theme"), (has("target_vocabulary_id") | has("vocabulary_id"), "target_vocabulary_id required")],
        "image_prompt_create": [*both("image_id"), (has("keywords") | has("title"), "keywords or title required")],
        "image_prompt_improve": both("image_id"),
        "image_prompt_validate": both("image_id", "prompt"),
        "image_generate_concepts": [*both("theme"), (_count_within(config, 15), "count not in [1,15]")],
        "image_generate_prompts": [(_filled_list(config, "concepts") | (has("term_id") & has("vocabulary_id")), "concepts or term required"), (_count_within(config, 10), "count not in [1,10]")],
        "image_prompt_suggest": [(has("image_id") | has("title"), "image_id or title required"), (_count_within(config, 5), "count not in [1,5]")],
        "image_prompts_bulk": [(_filled_list(config, "items"), "items required"), (_filled_list(config, "items", 10), "items over 10")],
    }
    is_object = F.coalesce(F.startswith(F.ltrim(config), F.lit("{")) & F.try_parse_json(config).isNotNull(), F.lit(False))
    error = F.when(~is_object, "config not an object")
    for kind, tests in needs.items():
        for ok, message in tests:
            error = error.when((job_type == kind) & ~ok, message)
    return error.when(~F.coalesce(job_type.isin(*needs), F.lit(False)), "unknown type")


def clamped_score(raw: Column) -> Column:
    """A model's score as an integer 0 to 100; booleans count as 1 and 0, garbage as 0."""
    number = F.when(F.lower(raw) == "true", 1.0).when(F.lower(raw) == "false", 0.0).otherwise(raw.try_cast("double"))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number.cast("int"), F.lit(0))))


def active_variants(rows: DataFrame, category: str, registry: list[str], default: list[str], overrides: DataFrame) -> DataFrame:
    """rows with `variants`: those of the category's override (category, names) if it has one, even an empty one, else the default; unknown names left out."""
    known = F.array(*(F.lit(n) for n in registry))
    joined = rows.join(overrides.select(F.col("category").alias(category), F.col("names").alias("__names")), category, "left")
    chosen = F.coalesce("__names", F.array(*(F.lit(n) for n in default)))
    return joined.withColumn("variants", F.filter(chosen, lambda n: F.array_contains(known, n))).drop("__names")


def variant_errors(variant: Column, styles: tuple[str, ...], kinds: tuple[str, ...], presets: tuple[str, ...]) -> Column:
    """array<string>: what is wrong with a registered variant (JSON object text); with missing fields only these are named."""
    required = ("label", "prompt_style", "output_kind", "force_chromakey", "chromakey_rgb", "extract_preset")
    get = lambda k: F.get_json_object(variant, f"$.{k}")
    keys = F.json_object_keys(variant)
    missing = F.array_except(F.array(*(F.lit(k) for k in required)), keys)
    rgb = F.from_json(get("chromakey_rgb"), "array<int>")
    good_rgb = (F.size(rgb) == 3) & F.forall(rgb, lambda x: x.isNotNull() & x.between(0, 255))
    tests = F.array_compact(
        F.array(
            F.when(~F.coalesce(get("prompt_style").isin(*styles), F.lit(False)), F.lit("prompt_style")),
            F.when(~F.coalesce(get("output_kind").isin(*kinds), F.lit(False)), F.lit("output_kind")),
            F.when(~F.coalesce(get("force_chromakey").isin("true", "false"), F.lit(False)), F.lit("force_chromakey")),
            F.when((get("force_chromakey") == "true") & get("chromakey_rgb").isNull(), F.lit("chromakey_rgb missing")),
            F.when(get("chromakey_rgb").isNotNull() & ~F.coalesce(good_rgb, F.lit(False)), F.lit("chromakey_rgb")),
            F.when(get("extract_preset").isNotNull() & ~F.coalesce(get("extract_preset").isin(*presets), F.lit(False)), F.lit("extract_preset")),
            F.when(F.coalesce(F.trim(get("label")), F.lit("")) == "", F.lit("label")),
        )
    )
    return F.when(keys.isNull(), F.array(F.lit("not an object"))).when(F.size(missing) > 0, F.transform(missing, lambda m: F.concat(F.lit("missing "), m))).otherwise(tests)
