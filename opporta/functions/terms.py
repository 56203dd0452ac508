"""Word-boundary term search that grows with the text, not with text x terms.

Each text is split into its distinct words once. A term is looked for only where its longest
word occurs (a hash intersection), and the few candidates are then checked with the full pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions.text import NOT_WORD, WORD


def anchor_word(term: str) -> str:
    """Longest word of a term; empty when the term has no word character."""
    words = [w for w in re.split(r"\W+", term.lower()) if w]
    return max(words, key=len, default="")


def boundary_pattern(term: str) -> str:
    """Java pattern: the whole term between non-word neighbors."""
    return rf"(?<!{WORD})\Q{term.lower()}\E(?!{WORD})"


def pattern_column(term: Column) -> Column:
    return F.concat(F.lit(rf"(?<!{WORD})\Q"), F.lower(term), F.lit(rf"\E(?!{WORD})"))


def distinct_words(lowered: Column) -> Column:
    return F.array_distinct(F.split(lowered, NOT_WORD + "+"))


def with_term_hits(df: DataFrame, text: Column, terms: list[str], out: str) -> DataFrame:
    """Add `out ARRAY<INT>`: positions (0-based) of the terms found in the text. No shuffle.

    For bounded term lists, which become constants of the plan.
    """
    if not terms:
        return df.withColumn(out, F.expr("CAST(array() AS ARRAY<INT>)"))
    by_anchor: dict[str, list[int]] = {}
    for position, term in enumerate(terms):
        by_anchor.setdefault(anchor_word(term), []).append(position)
    always = by_anchor.pop("", [])
    low, words = f"_{out}_low", f"_{out}_words"
    staged = df.withColumn(low, F.lower(text))
    candidates = F.array(*[F.lit(p) for p in always]).cast("array<int>")
    if by_anchor:
        lookup = F.create_map(*[x for a, ps in by_anchor.items() for x in (F.lit(a), F.array(*map(F.lit, ps)))])
        staged = staged.withColumn(words, F.array_intersect(
            distinct_words(F.col(low)), F.array(*map(F.lit, by_anchor))))
        candidates = F.concat(candidates, F.flatten(F.transform(F.col(words), lambda w: F.element_at(lookup, w))))
    patterns = F.array(*[F.lit(boundary_pattern(t)) for t in terms])
    hits = F.filter(candidates, lambda i: F.regexp_like(F.col(low), F.element_at(patterns, i + 1)))
    return staged.withColumn(out, F.coalesce(hits, F.expr("CAST(array() AS ARRAY<INT>)"))).drop(low, words)
