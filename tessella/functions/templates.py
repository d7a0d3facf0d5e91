"""Texts from templates and rules: filled templates, front matter, logged rewriting, name alignment."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of prompts that show a collection.
COLLECTIVE = ("imagier", "grid", "chart", "panel", "overview", "collection", "poster")


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column; null counts as empty, {{ and }} are braces."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def yaml_text(c: Column) -> Column:
    """A quoted YAML scalar; null is null."""
    safe = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), safe, F.lit('"')))


def yaml_list(c: Column) -> Column:
    """A block list of quoted scalars; an empty one is []."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) < 1, " []").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("\n  - "), yaml_text(x))), ""))


def front_matter(texts: dict[str, Column], lists: dict[str, Column], plain: dict[str, Column]) -> Column:
    """A front-matter block: quoted texts, then plain scalars (numbers, booleans), then lists, each in the given order."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_text(c)) for k, c in texts.items()]
    lines += [F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in plain.items()]
    lines += [F.concat(F.lit(f"{k}:"), yaml_list(c)) for k, c in lists.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


@dataclass(frozen=True)
class Rule:
    """kind `append` (any of `patterns` occurs: add `text`), `replace` (each phrase of `phrases`) or `regex` (`pattern` by `text`, unless its second group is in `skip`)."""

    id: str
    kind: str
    patterns: tuple[str, ...] = ()
    text: str = ""
    phrases: dict[str, str] = field(default_factory=dict)
    pattern: str = ""
    skip: tuple[str, ...] = ()


def _occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def rewrite(text: Column, rules: list[Rule]) -> Column:
    """struct<text, log array<struct<rule, action, what, n>>>: the rules in order, each event logged, blanks tidied at the end.

    Phrases and patterns are compared without case.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<struct<rule:string,action:string,what:string,n:int>>").alias("log"))
    for rule in rules:
        steps = []
        if rule.kind == "append":
            steps = [("append", None)]
        elif rule.kind == "replace":
            steps = [("replace", phrase) for phrase in rule.phrases]
        elif rule.kind == "regex":
            steps = [("regex", rule.pattern)]
        for action, what in steps:
            state = F.transform(F.array(state), _stepper(rule, action, what))[0]
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+,", ","), r"\s{2,}", " "), r",\s*,", ","))
    return F.transform(F.array(state), lambda s: F.named_struct(F.lit("text"), tidy(s["text"]), F.lit("log"), s["log"]))[0]


def _stepper(rule: Rule, action: str, what: str | None) -> Callable[[Column], Column]:
    return lambda s: _step(s, rule, action, what)


def _step(s: Column, rule: Rule, action: str, what: str | None) -> Column:
    event = lambda subject, n: F.named_struct(F.lit("rule"), F.lit(rule.id), F.lit("action"), F.lit(action), F.lit("what"), subject, F.lit("n"), n.cast("int"))
    if action == "append":
        found = F.get(F.filter(F.array(*(F.lit(p) for p in rule.patterns)), lambda p: F.contains(F.lower(s["text"]), F.lower(p))), F.lit(0))
        new, n, subject = F.concat(F.rtrim(s["text"]), F.lit(rule.text)), F.when(found.isNotNull(), 1).otherwise(0), found
    else:
        pattern = re.escape(what) if action == "replace" else what
        kept = f"(?!(?:{'|'.join(map(re.escape, rule.skip))})\\b)" if rule.skip else ""
        pattern = f"(?i){_before_second_group(pattern, kept)}"
        new = F.regexp_replace(s["text"], pattern, rule.phrases[what].replace("\\", "\\\\").replace("$", "\\$") if action == "replace" else rule.text)
        n, subject = _occurrences(s["text"], pattern), F.lit(what)
    return F.when(n > 0, F.named_struct(F.lit("text"), new, F.lit("log"), F.array_append(s["log"], event(subject, n)))).otherwise(s)


def _before_second_group(pattern: str, look: str) -> str:
    """The pattern with a lookahead set before its second group."""
    if not look:
        return pattern
    opens = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?)", pattern)]
    return pattern[: opens[1]] + look + pattern[opens[1] :]


def leading_name(leaf: Column, names: tuple[str, ...]) -> Column:
    """The name that a leaf id begins with (as its first `_` token), null if none; collections have none."""
    low = F.lower(leaf)
    collective = F.exists(F.array(*(F.lit(m) for m in COLLECTIVE)), lambda m: F.contains(low, m))
    found = F.get(F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.startswith(low, F.concat(n, F.lit("_")))), F.lit(0))
    return F.when(~collective, found)


# First tokens of leaves that name a number of subjects; parts of leaves that tend to show several subjects, and what their negative prompt gets.
NUMBERS = ("three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
SEVERAL = ("_with_friend", "_with_chicks", "_and_", "_in_anemone", "_with_school", "_with_cub", "_with_pup")
ISOLATION = ", two animals, pair of animals, multiple animals together"


def numbered(leaf: Column) -> Column:
    """Whether a leaf id begins with a number word, in any case; null has none."""
    return F.coalesce(F.lower(leaf).rlike(f"^({'|'.join(NUMBERS)})_"), F.lit(False))


def several(leaf: Column) -> Column:
    """Whether a leaf id has a part that tends to show several subjects."""
    return F.coalesce(F.exists(F.array(*(F.lit(p) for p in SEVERAL)), lambda p: F.contains(leaf, p)), F.lit(False))


def isolated(negative: Column, leaf: Column) -> Column:
    """The negative prompt, with a call for one subject where a leaf tends to show several."""
    return F.when(several(leaf), F.concat(negative, F.lit(ISOLATION))).otherwise(negative)


def align(words: Column, parts: Column) -> Column:
    """array<struct<word, part>>: words beside the parts of their transliteration; a word with the article `ال` takes `al` and the next part. Null where they do not come out even."""
    step = lambda acc, w: F.named_struct(
        F.lit("at"),
        acc["at"] + F.when(_article(w, acc, parts), 2).otherwise(1),
        F.lit("pairs"),
        F.array_append(acc["pairs"], F.named_struct(F.lit("word"), w, F.lit("part"), F.when(_article(w, acc, parts), F.concat(F.lit("al-"), F.get(parts, acc["at"] + 1))).otherwise(F.get(parts, acc["at"])))),
    )
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("pairs"), F.array().cast("array<struct<word:string,part:string>>"))
    done = F.aggregate(words, start, step)
    return F.when(done["at"] == F.size(parts), done["pairs"])


def _article(word: Column, acc: Column, parts: Column) -> Column:
    return F.coalesce(F.startswith(word, F.lit("ال")) & (F.get(parts, acc["at"]) == "al") & F.get(parts, acc["at"] + 1).isNotNull(), F.lit(False))


def resolution(c: Column, default: int = 1024) -> Column:
    """struct<w, h> of `WxH` text; anything else gives the default square."""
    w, h = (F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    fits = w.isNotNull() & h.isNotNull()
    return F.struct(F.when(fits, w).otherwise(default).alias("w"), F.when(fits, h).otherwise(default).alias("h"))


def size_ratio(before: Column, after: Column) -> Column:
    """Share of the former size, to four digits; null where there was none."""
    return F.when(before > 0, F.bround(after / before, 4))
