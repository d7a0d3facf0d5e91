"""Review artifacts and annotations as JSON columns: envelopes, proposals, migrations, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTIFACT_VERSION = 1

# The former annotation grid and what its entries became.
SCORES = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 4, 8: 5, 9: 5, 10: 6}
DEFECTS = {
    "3_jambes": "image_anatomie_pb",
    "2_objets": "image_duplication",
    "couleurs_résiduelles": "image_traces_couleur",
    "traits_flous": "image_flou",
    "traits_doubles": "image_traits_pb",
    "traits_discontinus": "image_traits_pb",
    "perspective_KO": "image_physique_pb",
    "gris_résiduel": "image_gris_residuel",
    "prompt_incohérent": "image_prompt_non_respecte",
}
IMAGE_NOTES = {
    "sujet_hors_catégorie": "image_hors_sujet",
    "sujet_tronqué": "image_compo_mauvaise",
    "composition_déséquilibrée": "image_compo_mauvaise",
    "trop_chargé": "image_complexe",
    "couleurs_persistantes": "image_traces_couleur",
    "traits_incomplets": "image_traits_pb",
}
PROMPT_NOTES = {"prompt_trop_vague": "prompt_ambigu", "prompt_trop_complexe": "prompt_complexe", "concept_difficile": "prompt_complexe"}
#: Fields that only entries of the present grid have.
NEW_FIELDS = ("image_tags", "prompt_tags", "flags", "score_legacy", "custom_tags")



def _empty() -> Column:
    return F.array().cast("array<string>")


def _map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def _texts(json: Column, path: str) -> Column:
    """array<string> at a path of JSON text; anything else gives no entries."""
    return F.coalesce(F.from_json(F.get_json_object(json, path), "array<string>"), _empty())


def is_new_grid(entry: Column) -> Column:
    """Whether an annotation (JSON object text) has a field of the present grid."""
    keys = F.coalesce(F.json_object_keys(entry), _empty())
    return F.arrays_overlap(keys, F.array(*(F.lit(k) for k in NEW_FIELDS)))


def migrate_annotation(entry: Column) -> Column:
    """struct<score, score_legacy, image_tags, prompt_tags, custom_tags, anomalies> of an annotation in the former or present grid.

    Entries of the present grid come back as they are, without anomalies. Former
    scores 1 to 10 are mapped, others reported; unknown defects are reported;
    notes are a JSON list of known notes and own tags, or one own tag.
    """
    raw = F.get_json_object(entry, "$.score")
    old = raw.try_cast("int")
    known = old.between(1, 10)
    defects, notes = _texts(entry, "$.defects"), F.trim(F.get_json_object(entry, "$.notes"))
    listed = F.when(F.startswith(notes, F.lit("[")), F.from_json(notes, "array<string>"))
    pills = F.filter(F.coalesce(listed, F.when(F.coalesce(notes, F.lit("")) != "", F.array(notes)), _empty()), lambda x: x != "")
    of = lambda table, items: F.array_compact(F.transform(items, lambda x: F.try_element_at(_map(table), x)))
    own = F.filter(pills, lambda x: F.try_element_at(_map(IMAGE_NOTES | PROMPT_NOTES), x).isNull())
    anomalies = F.array_compact(
        F.concat(
            F.array(F.when(raw.isNotNull() & old.isNull(), F.concat(F.lit("score wrong type: "), raw)), F.when(old.isNotNull() & ~known, F.concat(F.lit("score out of [1,10]: "), raw))),
            F.transform(F.filter(defects, lambda d: F.try_element_at(_map(DEFECTS), d).isNull()), lambda d: F.concat(F.lit("unknown defect: "), d)),
        )
    )
    return F.when(
        is_new_grid(entry),
        F.struct(
            old.alias("score"),
            F.get_json_object(entry, "$.score_legacy").try_cast("int").alias("score_legacy"),
            *(_texts(entry, f"$.{t}").alias(t) for t in ("image_tags", "prompt_tags", "custom_tags")),
            _empty().alias("anomalies"),
        ),
    ).otherwise(
        F.struct(
            F.when(known, F.try_element_at(_map(SCORES), old)).alias("score"),
            F.when(known, old).alias("score_legacy"),
            F.array_distinct(F.concat(of(DEFECTS, defects), of(IMAGE_NOTES, pills))).alias("image_tags"),
            F.array_distinct(of(PROMPT_NOTES, pills)).alias("prompt_tags"),
            F.array_distinct(own).alias("custom_tags"),
            anomalies.alias("anomalies"),
        )
    )


def annotation_row(entry: Column, image_vocabulary: list[str], prompt_vocabulary: list[str]) -> Column:
    """struct of an annotation's table row, with what is odd about it in `anomalies`; odd values stay, a score of wrong type goes.

    An entry that is no JSON object gives null fields and says so. The note of a
    pattern is dropped where there is no pattern.
    """
    parsed = F.try_parse_json(entry)
    is_object = F.coalesce(F.startswith(F.ltrim(entry), F.lit("{")) & parsed.isNotNull(), F.lit(False))
    raw = F.get_json_object(entry, "$.score")
    score = raw.try_cast("int")
    images, prompts = _texts(entry, "$.image_tags"), _texts(entry, "$.prompt_tags")
    flag = lambda name: F.get_json_object(entry, f"$.flags.{name}").try_cast("boolean")
    outside = lambda tags, known, what: F.transform(F.filter(tags, lambda t: ~F.array_contains(F.array(*(F.lit(k) for k in known)), t)), lambda t: F.concat(F.lit(f"unknown {what}: "), t))
    odd = F.array_compact(
        F.concat(
            F.array(F.when(raw.isNotNull() & score.isNull(), F.concat(F.lit("score wrong type: "), raw)), F.when(~score.between(1, 6), F.concat(F.lit("score out of [1,6]: "), raw))),
            outside(images, image_vocabulary, "image_tag"),
            outside(prompts, prompt_vocabulary, "prompt_tag"),
        )
    )
    pattern = F.coalesce(flag("pattern"), F.lit(False))
    row = F.struct(
        score.alias("score"),
        images.alias("image_tags"),
        prompts.alias("prompt_tags"),
        _texts(entry, "$.custom_tags").alias("custom_tags"),
        pattern.alias("pattern"),
        F.when(pattern, F.coalesce(F.get_json_object(entry, "$.flags.pattern_note"), F.lit(""))).otherwise("").alias("pattern_note"),
        F.coalesce(flag("sample"), F.lit(False)).alias("sample"),
        flag("publishable").alias("publishable"),
        odd.alias("anomalies"),
    )
    none = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("score", "int"), ("image_tags", "array<string>"), ("prompt_tags", "array<string>"), ("custom_tags", "array<string>"), ("pattern", "boolean"), ("pattern_note", "string"), ("sample", "boolean"), ("publishable", "boolean"))), F.array(F.lit("entry not an object")).alias("anomalies"))
    return F.when(is_object, row).otherwise(none)


def score_violation(score: Column, legacy: Column, note: Column) -> Column:
    """array<string> of an annotation's numbers out of range: score 1 to 6, former score 1 to 10, note 0 to 6; null is allowed."""
    tests = {"score": (score, 1, 6), "score_legacy": (legacy, 1, 10), "note": (note, 0, 6)}
    return F.array_compact(F.array(*(F.when(~c.between(low, high), F.lit(f"{name} not in [{low},{high}]")) for name, (c, low, high) in tests.items())))


def envelope(artifact_type: Column, entity_type: Column, entity_id: Column, proposal: Column, mode: str) -> Column:
    """JSON text of a review artifact; the proposal is JSON text of an object (anything else counts as empty)."""
    given = F.when(F.startswith(F.ltrim(proposal), F.lit("{")), F.try_parse_json(proposal))
    return F.to_json(
        F.struct(
            F.lit(ARTIFACT_VERSION).alias("artifact_version"),
            artifact_type.alias("artifact_type"),
            entity_type.alias("entity_type"),
            entity_id.alias("entity_id"),
            F.coalesce(given, F.parse_json(F.lit("{}"))).alias("proposal"),
            F.struct(F.lit(mode).alias("mode")).alias("apply_plan"),
        )
    )


def proposal(artifact: Column) -> Column:
    """JSON text of an artifact's proposal; of a bare object the object itself."""
    wrapped = F.get_json_object(artifact, "$.artifact_version") == str(ARTIFACT_VERSION)
    return F.when(F.coalesce(wrapped, F.lit(False)), F.coalesce(F.get_json_object(artifact, "$.proposal"), F.lit("{}"))).otherwise(artifact)


def nested_proposal(flat: Column) -> Column:
    """JSON text of a flat map of suggestions by field and locale (name_fr, description_en, keywords), nested; blank ones and others left out."""
    kept = F.map_filter(F.transform_values(flat, lambda _, v: F.trim(v)), lambda _, v: v.isNotNull() & (v != ""))
    by_locale = lambda field: F.map_from_entries(F.transform(F.filter(F.array_sort(F.map_entries(kept)), lambda e: F.startswith(e["key"], F.lit(f"{field}_"))), lambda e: F.struct(F.substring(e["key"], len(field) + 2, 99), e["value"])))
    some = lambda m: F.when(F.size(m) > 0, m)
    return F.to_json(F.struct(some(by_locale("name")).alias("name_i18n"), some(by_locale("description")).alias("description_i18n"), F.try_element_at(kept, F.lit("keywords")).alias("keywords")))
