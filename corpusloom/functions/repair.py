"""Recovering structure: damaged JSON replies, phrases back on their source text, prompts cut to a budget."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import ELLIPSIS

_TOKEN = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|["'{}\[\],]""", re.S)
_STRING = r'"(?:[^"\\]|\\.)*"'
#: Fixed value: the one list whose missing brackets are put back, as no other loose string can be told from a missing key.
_LOOSE_LIST = re.compile(rf'("evidence_ids"\s*:\s*)({_STRING}(?:\s*,\s*{_STRING})+)(?=\s*[,}}])')
_PAIRS = {"{": "}", "[": "]"}


def _bare(reply: str) -> str:
    """A reply without its reasoning, finished or not, and without the fence around it."""
    answer = re.sub(r"<think>.*?(?:</think>|\Z)", "", reply, flags=re.S).strip()
    return re.sub(r"\A```(?:json|python)?\s*|\s*```\Z", "", answer) if answer.startswith("```") else answer


def _closed(text: str) -> tuple[str, int] | None:
    """The object that text begins with, its open brackets closed and commas before a close dropped, and where it ends; None
    if brackets cross or a string has no end."""
    out, waiting, at, comma = [], [], 0, -1
    for token in _TOKEN.finditer(text):
        mark = token[0]
        gap = text[at : token.start()]
        if gap.strip():
            comma = -1
        out.append(gap)
        at = token.end()
        if mark in "\"'":
            return None
        if mark in "}]":
            if not waiting or waiting.pop() != mark:
                return None
            if comma >= 0:
                out[comma] = ""
        elif mark in "{[":
            waiting.append(_PAIRS[mark])
        out.append(mark)
        comma = len(out) - 1 if mark == "," else -1
        if not waiting:
            return "".join(out), at
    rest = text[at:]
    if comma >= 0 and not rest.strip():
        out[comma] = ""
    return "".join([*out, rest]).rstrip() + "".join(reversed(waiting)), len(text)


def recovered(reply: str) -> tuple[dict, str] | None:
    """(object, how) of the first JSON object a reply holds: as it stands, with containers closed, with the brackets of its
    evidence list, or as a Python literal of JSON's types. Nothing is made up; None if there is none."""
    answer = _bare(reply or "")
    at = answer.find("{")
    while at >= 0:
        found = _closed(answer[at:])
        end = at + found[1] if found else at + 1
        if found:
            tries = (("none", answer[at:end], json.loads), ("container-repair", found[0], json.loads), ("evidence-array-repair", _LOOSE_LIST.sub(r"\1[\2]", found[0]), json.loads), ("literal-repair", found[0], ast.literal_eval))
            for how, text, parse in tries:
                try:
                    value = json.loads(json.dumps(parse(text), ensure_ascii=False, allow_nan=False))
                except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
                    continue
                if isinstance(value, dict):
                    return value, how
        at = answer.find("{", end)
    return None


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("how", StringType())]))
def recovered_json(replies: pd.Series) -> pd.DataFrame:
    """recovered() as a column: the object in canonical JSON and how it was had; nulls where a reply holds none."""
    rows = [recovered(r) if isinstance(r, str) else None for r in replies]
    return pd.DataFrame({"value": [json.dumps(r[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if r else None for r in rows], "how": [r[1] if r else None for r in rows]})


def aligned(text: str, phrases: list[str], most: int = 8) -> list[str] | None:
    """The stretches of text that phrases stand for, which together are the whole text: what lies between goes to the phrase
    before, at the start to the first. None if a letter or digit would be skipped, or a phrase isn't there in its turn."""
    if not 1 <= len(phrases) <= most or any(not (p or "").strip() for p in phrases):
        return None
    loose = lambda p: r"\s+".join(map(re.escape, p.split()))
    found = re.fullmatch("".join([r"([\W_]*?)", *(f"({loose(p)}" + r"[\W_]*?)" for p in phrases[:-1]), f"({loose(phrases[-1])}" + r"[\W_]*)"]), text, re.S)
    if not found:
        return None
    head, *rest = found.groups()
    return [head + rest[0], *rest[1:]]


@F.pandas_udf(ArrayType(StringType()))
def aligned_parts(texts: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([aligned(t, list(p)) if isinstance(t, str) and p is not None else None for t, p in zip(texts, phrases, strict=True)])


def estimate(text: str) -> int:
    """token_estimate() of functions.text for one string."""
    plain = sum(c < "\x80" for c in text)
    need = max(plain / 2.5 + 1.25 * (len(text) - plain), len(text.encode()) / 2.5)
    return max(1, -int(-need // 1))


#: Steps of compaction: most characters of a string, most items of a list.
LADDER = ((520, 16), (360, 12), (240, 10), (160, 8), (104, 6), (72, 4))


def compacted(prompt: str, budget: int) -> str:
    """A prompt of at most budget tokens: strings and lists in its JSON get shorter step by step, then its middle goes."""

    def shorter(value, characters: int, items: int):
        if isinstance(value, str):
            return value if len(value) <= characters else value[: characters - 1].rstrip() + ELLIPSIS
        if isinstance(value, list):
            return [shorter(v, characters, items) for v in value[:items]]
        return {k: shorter(v, characters, items) for k, v in value.items()} if isinstance(value, dict) else value

    def step(text: str, characters: int, items: int) -> str:
        out, at, decoder = [], 0, json.JSONDecoder()
        for start in re.finditer(r"[\[{]", text):
            if start.start() < at:
                continue
            try:
                value, end = decoder.raw_decode(text, start.start())
            except ValueError:
                continue
            out += [text[at : start.start()], json.dumps(shorter(value, characters, items), ensure_ascii=False, separators=(",", ":"))]
            at = end
        return "".join([*out, text[at:]])

    text = prompt.strip()
    for characters, items in LADDER:
        if estimate(text) <= budget:
            return text
        text = step(text, characters, items)
    low, high, gap = 0, len(text), " [...] "
    if estimate(text) <= budget:
        return text
    cut = lambda kept: text[: kept - kept // 2] + gap + (text[len(text) - kept // 2 :] if kept > 1 else "")
    while low < high:  # the most characters that fit
        kept = (low + high + 1) // 2
        low, high = (kept, high) if estimate(cut(kept)) <= budget else (low, kept - 1)
    return cut(low)


@F.pandas_udf(StringType())
def compacted_prompts(prompts: pd.Series, budgets: pd.Series) -> pd.Series:
    return pd.Series([compacted(p, int(b)) if isinstance(p, str) else None for p, b in zip(prompts, budgets, strict=True)])
