"""Column functions: concept candidates, content filters, label and verdict parsers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import DEFAULT, SUFFIXES, Lists


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Words of Latin letters without marks, and of any script.
LATIN, ANY_SCRIPT = "[a-z]{2,}", r"[\p{L}\p{M}]{2,}"


def word_concepts(text: Column, pattern: str = LATIN) -> Column:
    """The distinct lower-case words of two letters or more; ``ANY_SCRIPT`` takes letters of every script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def usable(text: Column, least: int = 10, beyond: bool = False) -> Column:
    """Whether a text, trimmed, has ``least`` characters (more with ``beyond``); a null has none."""
    n = F.length(strip(F.coalesce(text, F.lit(""))))
    return n > least if beyond else n >= least


def shortened(text: Column, limit: int) -> Column:
    """The first ``limit`` characters: a projection for reports and requests, never for statistics."""
    return F.substring(text, 1, limit)


def prompt_words(text: Column, lists: Lists = DEFAULT) -> Column:
    """Content words of a prompt: its words without the stop-words, sorted."""
    return F.array_sort(F.array_except(word_concepts(text), F.array(*map(F.lit, lists.stop))))


def _any(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def drop_reason(concept: Column, is_prompt: Column, lists: Lists = DEFAULT, min_len: int = 3) -> Column:
    """Why the relaxed filter drops a concept, null if it stays; the first reason in order."""
    c = strip(F.lower(concept))
    w = F.split(c, r"\s+")
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    person = (F.size(w) == 2) & first.isin(*lists.names) & ~second.isin(*lists.names) & (F.length(second) <= 10) & ~second.rlike(f"({'|'.join(SUFFIXES)})$")
    return (
        F.when((F.length(c) < min_len) | (F.length(F.replace(c, F.lit(" "), F.lit(""))) < 2), "short")
        .when(F.regexp_replace(c, "[ .-]", "").rlike("^[0-9]+$"), "number")
        .when((F.size(w) == 1) & c.isin(*lists.names), "person_name")
        .when(person, "person_name")
        .when(c.isin(*lists.filler), "llm_filler")
        .when(_any(c, lists.filler_patterns), "llm_filler")
        .when((F.size(w) == 1) & c.isin(*lists.noise), "noise")
        .when(~is_prompt & (F.size(w) == 1) & c.isin(*lists.geo), "geo_noise")
    )


def drop_reason_strict(concept: Column, is_prompt: Column, lists: Lists = DEFAULT) -> Column:
    """The strict filter: names without guards, fiction, filler, its own patterns, geography, low quality."""
    c = strip(F.lower(concept))
    w = F.split(c, r"\s+")
    return (
        F.when((F.size(w) <= 2) & F.get(w, F.lit(0)).isin(*lists.names), "person_name")
        .when((F.size(w) == 1) & c.isin(*lists.fiction), "fiction")
        .when(c.isin(*lists.filler) | _any(c, lists.strict_patterns), "llm_filler")
        .when(~is_prompt & (F.size(w) == 1) & c.isin(*lists.geo), "geo_noise")
        .when((F.length(c) < 3) | F.regexp_replace(c, "[ .-]", "").rlike("^[0-9]+$") | ((F.size(w) == 1) & c.isin(*lists.noise)), "low_quality")
    )


def normalise_label(raw: Column, categories: list[str], merge: dict[str, str] | None = None) -> Column:
    """A free-text answer as one of ``categories``: merged names, then exact, separator-blind, and contained matches; null if none."""
    c = strip(F.regexp_replace(F.lower(F.split(strip(F.coalesce(raw, F.lit(""))), "\n")[0]), "[\"'`]", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"^[-*•\s]+", ""), r"^category:\s*", "")
    c = strip(c)
    for old, new in (merge or {}).items():
        c = F.when(c == old, new).otherwise(c)
    flat = lambda x: F.regexp_replace(x, "[ _/-]", "")
    known = F.array(*map(F.lit, categories))
    exact = F.get(F.filter(known, lambda k: k == c), F.lit(0))
    blind = F.get(F.filter(known, lambda k: flat(k) == flat(c)), F.lit(0))
    inside = F.get(F.filter(known, lambda k: F.contains(c, k)), F.lit(0))
    return F.when(c != "", F.coalesce(exact, blind, inside))


def parse_verdict(raw: Column, categories: list[str]) -> tuple[Column, Column]:
    """(verdict, better category) of a judge's answer."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    verdict = F.when(low.rlike("borderline"), "borderline").when(low.rlike("reject|incorrect|wrong"), "reject").when(low.rlike("accept|correct|agree"), "accept")
    rest = F.regexp_replace(low, "^[^\n]*\n?", "")
    better = F.get(F.filter(F.array(*map(F.lit, categories)), lambda k: F.contains(rest, k)), F.lit(0))
    return verdict, F.when(verdict == "reject", better)


def broad(label: Column) -> Column:
    """The part of a hierarchical label before the colon."""
    return strip(F.substring_index(label, ":", 1))


def json_labels(raw: Column) -> Column:
    """concept -> label of a model's answer: fenced or embedded JSON, else its ``"k": "v"`` lines, else null."""
    block = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.regexp_replace(block, r",\s*\}", "}"), "map<string,string>")
    pairs = F.regexp_extract_all(raw, F.lit(r'"[^"]+"\s*:\s*"[^"]+"'), F.lit(0))
    side = lambda x, n: F.regexp_extract(x, r'"([^"]+)"\s*:\s*"([^"]+)"', n)
    lines = F.map_from_entries(F.transform(pairs, lambda x: F.struct(side(x, 1), side(x, 2))))
    return F.coalesce(F.when(F.size(F.map_keys(parsed)) > 0, parsed), F.when(F.size(pairs) > 0, lines))
