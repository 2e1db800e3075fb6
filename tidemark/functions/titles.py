"""Title fingerprints of four widening tiers; sets are strings of sorted distinct tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABBREVIATIONS, DIFFICULTY, LEADING_VERBS, STOPWORDS
from .text import tokenize


def normalize(title: Column) -> Column:
    return F.array_join(tokenize(title), " ")


def _kept(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def _as_set(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def signature(title: Column) -> Column:
    return _as_set(_kept(tokenize(title)))


def stem(t: Column) -> Column:
    return F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def reduced(title: Column, strip_verb: bool = False) -> Column:
    tokens = tokenize(title)
    if strip_verb:
        tokens = F.when(F.get(tokens, F.lit(0)).isin(*LEADING_VERBS), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)
    spelled = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return _as_set(F.transform(_kept(tokens), lambda t: stem(F.coalesce(F.try_element_at(spelled, t), t))))


def difficulty(level: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DIFFICULTY.items() for x in pair)), level)


def origin_url(slug: Column, template: str = "https://leetcode.com/problems/%s/") -> Column:
    return F.format_string(template, slug)
