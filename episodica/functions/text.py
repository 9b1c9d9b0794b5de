"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import Profile

#: White space as Unicode has it; Java's own class is ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def none() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def normalize(text: Column) -> Column:
    """Null as "", each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def tokens(text: Column) -> Column:
    """The multiset of words (over one ASCII letter or digit), CJK characters, and adjacent pairs of all of these characters.

    Pairs run over spaces and punctuation. Four regular expressions, no lambda, so it stays in generated code; linear in
    the text's length. Where the tokens are used more than once, make them a column first."""
    low = F.lower(normalize(text))
    compact = F.regexp_replace(low, "[^a-z0-9一-鿿]+", "")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), 0)
    cjk = F.regexp_extract_all(low, F.lit("[一-鿿]"), 0)
    pairs = F.regexp_extract_all(compact, F.lit("(?=(..))"), 1)
    return F.concat(words, cjk, pairs)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def shared(a: Column, b: Column, profile: Profile, limit: int = 6) -> Column:
    """The first common tokens, sorted, without single characters and stop words."""
    stop = F.array(*[F.lit(x) for x in profile.stop])
    return F.slice(F.array_sort(F.filter(F.array_intersect(a, b), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))), 1, limit)


def coverage(query: Column, target: Column) -> Column:
    return F.size(F.array_intersect(query, target)) / F.greatest(F.size(query), F.lit(1))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def density(clean: Column, all_tokens: Column, question: Column, answer: Column, profile: Profile) -> Column:
    """Information density of a turn in [0, 1], unrounded, from its normalised text and that text's tokens; blank text has 0."""
    distinct = F.array_distinct(all_tokens)
    entities = F.size(F.filter(distinct, lambda t: any_of(t, profile.entity_types)))
    chars = F.length(F.replace(clean, F.lit(" "), F.lit("")))
    parts = sum((x.cast("int") for x in (normalize(question) != "", normalize(answer) != "", any_of(clean, profile.places), any_of(clean, profile.actions))), F.lit(0))
    score = (
        0.25 * F.least(F.lit(1.0), entities / 5.0)
        + 0.30 * F.least(F.lit(1.0), hits(clean, profile.critical) / 4.0)
        + 0.15 * (F.size(distinct) / F.greatest(F.size(all_tokens), F.lit(1)))
        + 0.15 * F.least(F.lit(1.0), F.log1p(chars) / F.log1p(F.lit(200)))
        + 0.15 * (parts / 4.0)
    )
    return F.when(clean == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _boost(kind: Column, boosts: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in boosts.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def importance(kind: Column, profile: Profile) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), 0.50 + _boost(kind, profile.boosts, 0.05))), 4)


def legacy_importance(text: Column, kind: Column, saliency: Column, profile: Profile) -> Column:
    score = 0.30 + F.least(F.lit(0.30), 0.06 * hits(normalize(text), profile.critical)) + _boost(kind, profile.legacy_boosts, 0.04) + F.least(F.lit(0.22), 0.22 * saliency)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), score)), 4)


def modality(paths: Column, visual: Column) -> Column:
    some = F.size(F.coalesce(paths, none())) > 0
    return F.when(some & (F.coalesce(visual, F.lit("")) != ""), "text+image").when(some, "image").otherwise("text")


def visual_text(paths: Column, visual: Column, profile: Profile) -> Column:
    """The description and a mark with each image's file name, joined; empty pieces are dropped."""
    names = F.transform(F.coalesce(paths, none()), lambda p: F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1))
    marks = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit(profile.image_mark), n))
    return F.array_join(F.filter(F.concat(F.array(normalize(visual)), marks), lambda p: p != ""), profile.join)


def turn_text(question: Column, answer: Column, visual: Column) -> Column:
    return normalize(F.concat(F.lit("Q: "), F.coalesce(question, F.lit("")), F.lit(" A: "), F.coalesce(answer, F.lit("")), F.lit(" V: "), F.coalesce(visual, F.lit(""))))


def local_summary(question: Column, answer: Column, visual: Column) -> Column:
    empty = F.lit("")
    return F.substring(normalize(F.concat_ws(" ", F.coalesce(question, empty), F.coalesce(answer, empty), F.coalesce(visual, empty))), 1, 120)


def pinned(text: Column, profile: Profile) -> Column:
    return any_of(normalize(text), profile.pins)


def is_correction(question: Column, answer: Column, profile: Profile) -> Column:
    return any_of(F.concat(F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))), profile.corrections)


def conflict_signal(text: Column, profile: Profile) -> Column:
    return F.least(F.lit(1.0), hits(F.lower(F.coalesce(text, F.lit(""))), profile.conflicts) / 2.0)


def evidence_weight(text: Column, frequency: Column, importance: Column, age: Column, half_life: float, profile: Profile) -> Column:
    """age: seconds since last seen; 0 if never seen."""
    base = 0.3 + 0.2 * F.least(F.lit(1.0), frequency / 5.0) + 0.2 * importance
    authority = F.when(any_of(F.coalesce(text, F.lit("")), profile.authority), 0.3).otherwise(0.0)
    recency = F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), age) / max(half_life, 1.0))
    return F.least(F.lit(1.0), base * (1.0 + conflict_signal(text, profile) + authority) + 0.3 * recency)


def key_entities(text: Column, profile: Profile) -> Column:
    """struct of a set for each class of key entity."""
    clean = F.coalesce(text, F.lit(""))
    sets = [F.array_distinct(F.concat(*[F.regexp_extract_all(clean, F.lit(p), 1 if "(" in p and "(?" not in p[:2] else 0) for p in patterns])).alias(k) for k, patterns in profile.key_patterns.items()]
    return F.struct(*sets)


def key_match(a: Column, b: Column, profile: Profile) -> Column:
    """Mean Jaccard over the classes that both sides have; 1 if there is none."""
    total, n = F.lit(0.0), F.lit(0)
    for k in profile.key_patterns:
        x, y = a[k], b[k]
        some = (F.size(x) > 0) & (F.size(y) > 0)
        both = F.size(F.array_intersect(x, y))
        total = total + F.when(some, both / (F.size(x) + F.size(y) - both)).otherwise(0.0)
        n = n + some.cast("int")
    return F.when(n == 0, 1.0).otherwise(total / n)


def strip_fence(text: Column) -> Column:
    """A JSON text without its code fence."""
    clean = F.regexp_replace(F.regexp_replace(normalize(text), "(?i)^```json\\s*", ""), "^```\\s*", "")
    return F.trim(F.regexp_replace(clean, "\\s*```$", ""))


def time_or(text: Column, as_of: Column) -> Column:
    """Digits with dots as a number, anything else as as_of."""
    return F.coalesce(F.when(text.rlike(r"^[0-9.]+$"), text.try_cast("double")), as_of)


def fuse(before: Column, new: Column, alike_by: Column, profile: Profile, alike: float = 0.70, limit: int = 240) -> Column:
    """A summary after a new one: as it was if they are alike, else both, cut."""
    return F.when(alike_by > alike, before).otherwise(F.substring(F.concat(before, F.lit(profile.join), new), 1, limit))
