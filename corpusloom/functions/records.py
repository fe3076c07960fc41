"""What records hold besides text: JSON bags, readings, locators, occurrences; and whether a record bears on a term."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from . import text as T
from .identity import UNIT, digest


def json_object(raw: Column) -> Column:
    """raw, if it is a JSON object (an empty one where it is null or empty), else null."""
    given = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("{}"))
    return F.when(F.try_parse_json(given).isNotNull() & given.startswith("{"), given)


def string_set(raw: Column) -> Column:
    """The distinct trimmed strings of a JSON list in order; null if raw is none, or holds anything else."""
    given = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("[]"))
    items = F.from_json(given, "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string"))))
    fit = F.try_parse_json(given).isNotNull() & given.startswith("[") & F.forall(texts, lambda t: t.isNotNull())
    return F.when(fit, F.array_sort(F.array_distinct(F.filter(texts, lambda t: t != ""))))


def evidence_ids(raw: Column, keys: list[str]) -> Column:
    """The distinct ids that an object names under any of the keys, as a string or in a list; what is no string is none."""
    bag = F.try_parse_json(json_object(raw))
    single = F.array(*[F.when(F.schema_of_variant(F.try_variant_get(bag, f"$.{k}", "variant")) == "STRING", F.try_variant_get(bag, f"$.{k}", "string")) for k in keys])
    none = F.array().cast("array<variant>")
    listed = F.flatten(F.array(*[F.coalesce(F.try_variant_get(bag, f"$.{k}", "array<variant>"), none) for k in keys]))
    texts = F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(single, texts), lambda t: t.isNotNull() & (t != ""))))


def _loaded(raw: str):
    try:
        return json.loads(raw)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(ArrayType(StringType()))
def flat_strings(raw: pd.Series) -> pd.Series:
    """All strings in a JSON value, depth first, members of objects by key; none where it is damaged."""

    def strings(value) -> list[str]:
        stack, found = [value], []
        while stack:
            now = stack.pop()
            if isinstance(now, str):
                found.append(now)
            elif isinstance(now, (list, dict)):
                stack += reversed(now if isinstance(now, list) else [now[k] for k in sorted(now)])
        return found

    return raw.map(lambda r: strings(_loaded(r)))


@F.pandas_udf(StringType())
def merged_json(base: pd.Series, patch: pd.Series) -> pd.Series:
    """The base object with the patch's members put in; objects under the same key are merged in turn, all else replaced."""

    def merged(a, b):
        both = isinstance(a, dict) and isinstance(b, dict)
        return {k: merged(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}} if both else b

    return pd.Series([json.dumps(merged(_loaded(a) or {}, _loaded(b) or {}), sort_keys=True) for a, b in zip(base, patch, strict=True)])


def ruby_covers(term: Column, tokens: Column) -> Column:
    """Whether tokens (t, r) show a term with Han characters whole, and give each token that has any a reading."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    shown = bare(F.array_join(F.transform(tokens, lambda x: F.coalesce(x["t"], F.lit(""))), ""))
    read = F.forall(tokens, lambda x: ~F.coalesce(x["t"], F.lit("")).rlike(r"\p{IsHan}") | (F.trim(F.coalesce(x["r"], F.lit(""))) != ""))
    return ~term.rlike(r"\p{IsHan}") | F.coalesce((F.size(tokens) > 0) & (shown == bare(term)) & read, F.lit(False))


def sanitized_locator(value: Column) -> Column:
    """A locator fit for publication: itself if it is short and gives nothing away, else a name made of its hash."""
    text = T.clean_text(F.coalesce(value, F.lit("")))
    fit = (F.length(text) <= 160) & ~T.sensitive(text) & ~text.contains("..") & ~text.contains("\\")
    return F.when((text == "") | fit, text).otherwise(F.concat(F.lit("locator_"), F.substring(digest(text), 1, 24)))


def node_identity(kind: Column, language: Column, role: Column, form: Column) -> Column:
    """By what a lexical node is itself: kind, language, role and form, not its id; null where one is empty."""
    parts = [T.lower_key(c) for c in (kind, language, role)]
    parts.append(T.lower_key(F.regexp_replace(form, "[‐-―−﹘﹣－]", "-")))
    whole = F.forall(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.when(whole, F.concat_ws(UNIT, *parts))


def occurrence(term: Column, base: Column, kind: Column, ordinal: Column) -> Column:
    """Where a part stands in its term: its span if it has one place there (a prefix the start, a suffix the end), else its ordinal."""
    word, part = T.lower_key(term), T.lower_key(base)
    starts = F.sequence(F.lit(0), F.greatest(F.length(word) - F.length(part), F.lit(0)))
    at = F.filter(starts, lambda i: F.substring(word, i + 1, F.length(part)) == part)
    at = F.when(kind == "prefix", F.filter(at, lambda i: i == 0)).when(kind == "suffix", F.filter(at, lambda i: i + F.length(part) == F.length(word))).otherwise(at)
    span = F.concat_ws(":", F.lit("span"), at[0].cast("string"), (at[0] + F.length(part)).cast("string"))
    return F.when((F.length(part) > 0) & (F.size(at) == 1), span).otherwise(F.concat(F.lit("ordinal:"), F.coalesce(ordinal.cast("string"), F.lit("-1"))))


#: Verbs after a term, and phrases before it, that say where it comes from.
COMES = "come comes came derive derives derived originate originates originated descend descends descended developed borrowed coined formed taken adapted adopted goes went".split()
LEADS = ("source of", "gave rise to", "yielded", "produced", "became", "developed into", "borrowed as", "coined as", "known in English as", "whence")


@F.pandas_udf(BooleanType())
def _says_origin(term: pd.Series, excerpt: pd.Series) -> pd.Series:
    """Whether an excerpt says of a term where it comes from, leads up to it, or has it as a numbered entry."""
    after, before = "|".join(COMES), "|".join(LEADS)

    def says(one: str | None, text: str | None) -> bool:
        words = re.findall("[A-Za-z]+", one or "")
        if not words or not text:
            return False
        name = r"\b" + r"[\s'-]+".join(words) + r"\b"
        ways = (rf"{name}(?:\s*\[\d+\])?\s+(?:(?:is|was|were)\s+)?(?:{after})\b", rf"\b(?:{before})\s+(?:the\s+)?(?:modern\s+)?(?:English\s+)?{name}", rf"(?:^|[.;:]\s+){name}\s*\[\d+\]")
        return any(re.search(w, text, re.I) for w in ways)

    return pd.Series([says(t, e) for t, e in zip(term, excerpt, strict=True)], dtype=bool)


def origin_matches(term: Column, kind: Column, headword: Column, excerpt: Column) -> Column:
    """Whether an entry tells a term's origin: its own, unless it only points elsewhere; one that points to the term; or one
    whose text says so."""
    flat, key = T.compact(F.coalesce(excerpt, F.lit(""))), T.plain_letters(term)
    targets = T.cross_references(flat)
    points = F.array_contains(F.transform(targets, lambda t: F.regexp_replace(F.lower(t), "[^a-z]", "")), key)
    own = F.when(T.plain_letters(F.coalesce(headword, F.lit(""))) == key, F.size(targets) == 0).otherwise(points | _says_origin(term, flat))
    return F.coalesce((kind == "entry") & (key != "") & own, F.lit(False))


def relevant(term: Column, kind: Column, corpus: Column, headword: Column, excerpt: Column, forms: Column | None = None) -> Column:
    """Whether a cited record bears on a card: by its headword, as a record of word parts, by telling the origin, or by
    holding all tokens of one of the card's other forms of three letters or more."""
    low = F.lower(F.coalesce(corpus, F.lit("")))
    out = (T.plain_letters(F.coalesce(headword, term)) == T.plain_letters(term)) | F.coalesce(kind, F.lit("")).startswith("morphology-")
    out = out | low.contains("root-dictionary") | low.contains("affix-dictionary") | origin_matches(term, kind, headword, excerpt)
    if forms is not None:
        held = F.regexp_extract_all(F.lower(excerpt), F.lit(T.WORD), F.lit(0))
        tokens = lambda f: F.regexp_extract_all(F.lower(f), F.lit(T.WORD), F.lit(0))
        out = out | F.exists(forms, lambda f: (F.length(F.regexp_replace(f, r"[^\p{L}]", "")) >= 3) & (F.lower(f) != F.lower(term)) & (F.size(tokens(f)) > 0) & (F.size(F.array_except(tokens(f), held)) == 0))
    return F.coalesce(out, F.lit(False))
