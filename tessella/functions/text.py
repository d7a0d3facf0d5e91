"""Slugs, names, paths and prompts as column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import first_nonblank

# Latin letters with marks and their base letters, position by position.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

# Arabic letters and their Latin spelling in slugs.
ARABIC = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s",
    "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "a", "ة": "a", "ء": "", "آ": "a", "أ": "a", "إ": "i", "ؤ": "w", "ئ": "y",
}


def fold_latin(c: Column) -> Column:
    """Latin letters without their marks; combining marks go. For text outside Latin-1 see fold_any."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{M}+", "")


def fold_any(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for any script (an Arrow function: Spark has no normalisation)."""

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        apart = pc.utf8_normalize(texts, "NFKD")
        return pc.replace_substring_regex(apart, r"\p{M}+", "")

    return folded(c)


def kebab(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def r2_slug(name: Column) -> Column:
    """struct<slug, error>: strict slug that starts with a letter and has two characters at least."""
    slug = kebab(fold_latin(name))
    error = (
        F.when(name.isNull(), "missing")
        .when(slug == "", "empty")
        .when(F.length(slug) < 2, "too_short")
        .when(~slug.rlike("^[a-z][a-z0-9-]*[a-z0-9]$"), "invalid")
    )
    return F.struct(F.when(error.isNull(), slug).alias("slug"), error.alias("error"))


def normalise_arabic(c: Column) -> Column:
    """Without vowel marks and tatweel, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0640}]", ""), r"\s+", " "))


def arabic_letters(word: Column) -> Column:
    """Letter by letter; unknown characters go."""
    out = F.regexp_replace(word, "[^" + "".join(ARABIC) + "A-Za-z0-9-]", "")
    for letter, latin in ARABIC.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in ARABIC.items() if len(v) == 1}
    return F.lower(F.translate(out, "".join(single), "".join(single.values())))


def arabic_slug(c: Column, phrases: Column | None = None, known: Column | None = None) -> Column:
    """Phrase table, else word table, else letters. Both tables are map<string, string> columns."""
    norm = normalise_arabic(c)
    word = lambda w: F.coalesce(known[w], arabic_letters(w)) if known is not None else arabic_letters(w)
    spelled = kebab(F.array_join(F.filter(F.transform(F.split(norm, " "), word), lambda x: x != ""), "-"))
    return F.coalesce(phrases[norm], spelled) if phrases is not None else spelled


def post_slug(name: Column, locale: Column, phrases: Column | None = None, known: Column | None = None) -> Column:
    """struct<slug, error>."""
    slug = F.when(locale == "ar", arabic_slug(name, phrases, known)).otherwise(kebab(fold_latin(name)))
    error = (
        F.when(name.isNull(), "missing")
        .when(locale.isNull() | ~locale.isin("en", "fr", "ar"), "locale")
        .when(slug == "", "empty")
        .when(~slug.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "invalid")
    )
    return F.struct(F.when(error.isNull(), slug).alias("slug"), error.alias("error"))


def short_slug(c: Column, most: int = 60, default: str = "concept") -> Column:
    return first_nonblank(F.trim(F.substring(kebab(fold_latin(c)), 1, most), F.lit("-")), F.lit(default))


# paths and names


def last_segment(url: Column) -> Column:
    """Slug of an absolute URL (query dropped), a relative path or a bare slug: the last non-empty path segment."""
    absolute = F.lower(url).rlike("^[a-z][a-z0-9+.-]*://")
    path = F.when(absolute, F.regexp_replace(F.regexp_replace(url, r"^[^:]+://[^/?#]*", ""), r"[?#].*$", "")).otherwise(url)
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def filename_parts(name: Column) -> Column:
    """struct<concept, steps, cfg, seed> of `a_b_8s_cfg35_42.png`.

    The first `<n>s` token gives the steps and ends the concept; the last token
    is the seed if it is a number; a `cfg<n>` token before it is n / 10.
    """
    tokens = F.split(stem(name), "_")
    at = F.coalesce(F.array_min(F.transform(F.filter(F.transform(tokens, lambda x, i: F.when(x.rlike(r"^\d+s$"), i)), lambda i: i.isNotNull()), lambda i: i)), F.lit(-1))
    steps = F.when(at >= 0, F.regexp_extract(F.get(tokens, at), r"^(\d+)s$", 1).cast("int"))
    last, before = F.element_at(tokens, -1), F.try_element_at(tokens, F.lit(-2))
    cfg = F.when(before.rlike(r"^cfg\d+$"), F.regexp_extract(before, r"(\d+)", 1).cast("int") / 10)
    concept = F.array_join(F.when(at >= 0, F.slice(tokens, F.lit(1), at)).otherwise(tokens), "_")
    return F.struct(concept.alias("concept"), steps.alias("steps"), cfg.alias("cfg"), F.when(last.rlike(r"^\d+$"), last.try_cast("long")).alias("seed"))


def leaf_id(name: Column) -> Column:
    """Leaf of `benchmark:dir/leaf_512x512…`, else the name with `-` as `_`."""
    return first_nonblank(F.regexp_extract(name, r"benchmark:[^/]+/([A-Za-z0-9_]+?)_\d+x\d+", 1), F.replace(name, F.lit("-"), F.lit("_")))


# prompts. Vocabularies and protected contexts of the prompt filters.
COLORS = [
    "red", "orange", "yellow", "green", "blue", "purple", "violet", "pink", "brown", "black", "white", "grey", "gray",
    "scarlet", "crimson", "ruby", "magenta", "fuchsia", "rose", "amber", "ochre", "tan", "beige", "cream", "ivory",
    "lime", "olive", "emerald", "teal", "turquoise", "cyan", "azure", "navy", "indigo", "lavender", "lilac",
    "maroon", "burgundy", "chestnut", "golden", "silver", "bronze", "copper", "brass",
    "dark", "light", "bright", "pale", "deep", "vivid", "vibrant", "neon", "fluorescent",
]
ANCHORS = {"rainbow": "colorful", "sunset": "sky scene", "autumn": "seasonal scene", "fall season": "seasonal scene", "tropical": "exotic", "fire": "flame shape", "flame": "flame shape"}
GLOSSY = ["shiny", "glossy", "metallic", "chrome", "glass", "wet", "chocolate", "shining", "polished", "lacquered", "reflective", "mirrored"]
SOLID = [
    "realistic textures", "realistic texture", "depth shading", "volumetric lighting", "volumetric shading", "soft shading",
    "drop shadow", "drop shadows", "shaded", "shading", "volumetric", "3d", "rendered", "photorealistic",
]
PROTECTED = [
    ("orange", r"\b(round|fresh|peeled|whole|sliced|half)\s+orange\s+(with|on|in|and|of)\b"),
    ("orange", r"\b(an|the)\s+orange\s+(slice|segment|peel|wedge|half)\b"),
    ("glass", r"\b(drinking|tall|small|empty|full|water|milk|juice|wine)\s+glass\b"),
    ("glass", r"\bglass\s+of\s+(milk|water|juice|wine|lemonade)\b"),
    ("bright", r"\bbright\s+(future|idea|side|child|smile|day|eyes)\b"),
    ("dark", r"\bdark\s+(age|ages|side|secret|matter|knight|chocolate)\b"),
    ("red", r"\bred\s+(carpet|cross|panda|alert)\b"),
]
#: Private-use character put inside a protected word while others are stripped.
_SHIELD = chr(0xE000)


def whole_words(words: list[str]) -> str:
    """Pattern of whole words, any case, any blanks between the parts of a phrase."""
    parts = [w.replace(" ", r"\s+") for w in words]
    return r"(?i)(?<![A-Za-z])(?:" + "|".join(parts) + r")(?![A-Za-z])"


def tidy(c: Column) -> Column:
    """Collapsed blanks and no orphaned commas, as prompts want them."""
    for pattern, by in ((r"\s*,(\s*,)+", ","), (r"[ \t]+", " "), (r"\s+([,.;:!?])", "$1"), (r"^\s*,\s*", ""), (r"\s*,\s*$", "")):
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _shielded(c: Column) -> Column:
    """Protected words with the shield behind their first letter."""
    for token, pattern in PROTECTED:
        head, tail = pattern.split(token, 1)
        first = 2 + head.count("(")  # group of the first letter; the one before it is the whole head
        c = F.regexp_replace(c, f"(?i)({head})({token[0]})({token[1:]})(?={tail})", f"$1${first}{_SHIELD}${first + 1}")
    return c


def _strip(c: Column, words: list[str]) -> Column:
    """Whole words removed, but for those in a protected context of the input."""
    bare = F.regexp_replace(_shielded(c), whole_words(sorted(words, key=len, reverse=True)), "")
    return tidy(F.replace(bare, F.lit(_SHIELD), F.lit("")))


def strip_colors(c: Column) -> Column:
    return _strip(c, COLORS)


def replace_anchors(c: Column) -> Column:
    """All replacements at once: a replacement is never replaced again."""
    for i, word in enumerate(ANCHORS):
        c = F.regexp_replace(c, whole_words([word]), chr(0xE100 + i))
    for i, by in enumerate(ANCHORS.values()):
        c = F.replace(c, F.lit(chr(0xE100 + i)), F.lit(by))
    return tidy(c)


def strip_glossy(c: Column) -> Column:
    return _strip(c, GLOSSY)


def strip_solid(c: Column) -> Column:
    return tidy(F.regexp_replace(c, whole_words(SOLID), ""))


def filter_prompt(c: Column) -> Column:
    return strip_solid(strip_glossy(strip_colors(replace_anchors(c))))


def restyle(prompt: Column, header: str, new_header: str, remove: list[str], suffix: str) -> Column:
    """Header replaced once, patterns removed, commas squeezed, suffix appended."""
    at = F.instr(prompt, header)
    out = F.when(at > 0, F.overlay(prompt, F.lit(new_header), at, F.lit(len(header)))).otherwise(prompt)
    for pattern in remove:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(\s*,\s*)+", ", "), r"\s+", " ")
    return F.concat(F.trim(F.trim(out), F.lit(", ")), F.lit(suffix))


def styled(positive: Column, negative: Column, style: Column, styles: dict[str, dict]) -> Column:
    """struct<positive, negative> in the style of each row; of an unknown style unchanged.

    styles: name to `header`, `positive` and `negative` (what is added), `remove_positive`
    and `remove_negative` (patterns, any case).
    """
    def changed(text: Column, patterns: list[str], added: str) -> Column:
        for pattern in patterns:
            text = F.regexp_replace(text, f"(?i){pattern}", "")
        text = F.regexp_replace(F.regexp_replace(text, r",\s*,", ","), r"\s+", " ")
        return F.concat(F.rtrim(F.regexp_replace(F.trim(text), ",+$", "")), F.lit(f", {added}"))

    out = F.struct(positive.alias("positive"), negative.alias("negative"))
    for name, s in styles.items():
        head = F.regexp_replace(positive, HEADER, s["header"].replace("\\", "\\\\").replace("$", "\\$") + ", ")
        out = F.when(style == name, F.struct(changed(head, s.get("remove_positive", []), s["positive"]).alias("positive"), changed(negative, s.get("remove_negative", []), s["negative"]).alias("negative"))).otherwise(out)
    return out


#: Fixed value: the header of prompts that a style replaces.
HEADER = r"(?i)^coloring book page for kids,?\s*"


def vocabulary_sizes(spark: SparkSession) -> DataFrame:
    """name, words: how many words each filter knows."""
    sizes = {"color_nouns": COLORS, "color_anchors": ANCHORS, "glossy_terms": GLOSSY, "solid_terms": SOLID}
    return spark.createDataFrame([(k, len(v)) for k, v in sizes.items()], "name string, words int")


def inject_background(prompt: Column, phrase: str, after: str = " illustration,") -> Column:
    """phrase, unless there already: behind the first `after`, else in front."""
    at = F.instr(prompt, after)
    return (
        F.when(F.contains(prompt, F.lit(phrase)), prompt)
        .when(at > 0, F.concat(F.substring(prompt, F.lit(1), at + (len(after) - 1)), F.lit(f" {phrase},"), F.substring(prompt, at + len(after), F.length(prompt))))
        .otherwise(F.concat(F.lit(f"{phrase}, "), prompt))
    )


#: First words of leaves whose subject is a colour.
INTRINSIC_COLORS = ("rainbow", "crystal", "prism", "spectrum", "aurora")


def intrinsic_color(leaf: Column) -> Column:
    return F.coalesce(F.lower(F.trim(leaf)).rlike("^(" + "|".join(INTRINSIC_COLORS) + ")(_.*)?$"), F.lit(False))


# Ordered rules leaf -> category.
BIRDS = "peacock|owl|turkey_bird|penguin|parrot|eagle|hawk|swan|falcon|flamingo|hummingbird|crow|sparrow|pigeon|dove|woodpecker"
MARINE = "crab|shark|sea_turtle|seahorse|starfish|whale|harp_seal|dolphin|octopus|jellyfish|stingray|squid|lobster|clownfish"
PETS = "rabbit|hamster|guinea_pig|french_bulldog|labrador|pet_turtle|dairy_cow|donkey|sheep_with_lamb|eid_al_adha_sheep|persian_cat|british_shorthair_cat|maine_coon_cat"
BIG_CATS = "tiger|leopard|jaguar|cheetah|puma|panther|lynx|cougar"
WILD = "elephant|fox|wolf|tiger|leopard|jaguar|bear|alpaca|armadillo|chimpanzee|orangutan|sloth|hyena|zebra|buffalo|musk_ox|beaver|butterfly|bee|snail|spider|griffin|phoenix|dragon|kangaroo|antelope|giraffe|rhino|hippo|gorilla|panda|deer|moose"
PEOPLE = "firefighter|police|doctor|teacher|baker|astronaut|pilot|farmer|fisherman|dancer|chef|musician|painter|locksmith|roofer|tour_guide|house_painter|snowboarder|speed_skater|breakdancer|wizard|knight|princess|fairy|elf_|iron_man|captain_america|robot_superhero|scooby_doo|spongebob|stitch_from|mirabel|moana|tintin|yeti|football_coach"
HUMANS = r"human|kid|child|woman|man\b|baby|teenager|cartoon|yoga_pose|family_|water_skiing|superhero"
LETTERS = "lettre|letter_|alphabet|arabic"
DEFAULT_CATEGORY = "objects_things"


def category(leaf: Column) -> Column:
    """First matching rule; the default for blank leaves and for no match."""
    x = F.lower(F.coalesce(leaf, F.lit("")))
    return (
        F.when(x.startswith("lion"), "animals_lions")
        .when(x.rlike(BIRDS), "animals_birds")
        .when(x.rlike(MARINE), "animals_marine")
        .when(x.rlike(PETS) | (x.rlike("_cat|cat_") & ~x.rlike(BIG_CATS)), "animals_pets")
        .when(x.rlike(WILD), "animals_wild")
        .when(x.rlike(f"(^|_)({PEOPLE})") | x.rlike(HUMANS), "general_humans")
        .when(x.rlike(LETTERS), "letters_arabic")
        .otherwise(DEFAULT_CATEGORY)
    )


def has_latin(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def anchor_present(text: Column, anchor: Column) -> Column:
    """Arabic anchor in a text: as it is, without article, any token of three letters, or its first four letters."""
    bare = F.regexp_replace(anchor, "^ال", "")
    tokens = F.filter(F.split(anchor, r"\s+"), lambda t: F.length(t) >= 3)
    return (
        F.contains(text, anchor)
        | ((F.length(bare) >= 2) & F.contains(text, bare))
        | F.exists(tokens, lambda t: F.contains(text, t))
        | ((F.length(anchor) >= 4) & F.contains(text, F.substring(anchor, 1, 4)))
    )
