"""Indicator classification by ordered text rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalars import split_topics

OTHERS = -1

# Bucket numbers and names.
BUCKET_NAMES = {
    1: "Output and capacity utilization measures",
    2: "Consumption and sales data",
    3: "Inventories and orders",
    4: "Interest rates and asset prices",
    5: "Exchange rates and foreign trade",
    6: "Employment metrics",
    7: "Earnings and labor force measures",
    8: "Wages and prices",
    9: "Government fiscal activity measures",
    10: "Other business condition indicators",
    -1: "Others",
}
# Words per bucket, matched as whole words in any case.
BUCKET_WORDS = {
    1: ["gdp", "gross domestic product", "value added", "gva", "capital formation", "industrial production",
        "manufacturing", "output", "production"],
    2: ["consumption", "expenditure", "retail", "sales"],
    3: ["inventory", "changes in inventories", "orders", "shipment"],
    4: ["interest rate", "deposit rate", "bond", "capitalization", "stock", "outstanding", "level", "spread",
        "interest", "financial", "credit", "money supply", "share price"],
    5: ["exchange rate", "export", "import", "trade", "current account", "balance of payments", "BoP"],
    6: ["employment", "unemploy", "underemploy", "labor force", "job", "migration"],
    7: ["earning", "income", "remittance", "wage", "compensation"],
    8: ["price", "inflation", "deflator", "cpi", "ppi"],
    9: ["government", "fiscal", "tax", "revenue", "public sector", "broad money"],
    10: ["confidence", "survey", "indicator", "sentiment", "business"],
}
# Words that exclude an indicator.
EXCLUDED_WORDS = ["rural", "urban", "female", "male", "young adults", "older adults", "richest", "poorest",
                  "primary education", "secondary education", "aged 15-24", "dummy", "crisis"]
# Topics that exclude an indicator, topics that decide its bucket, topics of interest.
EXCLUDED_TOPICS = ["Health", "Environment", "Agriculture & Rural Development"]
TOPIC_BUCKETS = {"Trade": 5, "External Debt": 5, "Financial Sector": 4, "Public Sector": 9}
WANTED_TOPICS = ["Economy & Growth", "Financial Sector", "External Debt"]


def whole_word(word: str) -> str:
    return rf"\b{word}\b"


@dataclass(frozen=True)
class Rules:
    """Decision list: exclusions first, then buckets in order, then topics."""

    patterns: Mapping[int, Sequence[str]]
    names: Mapping[int, str]
    excluded_patterns: Sequence[str] = ()
    excluded_topics: Sequence[str] = ()
    topic_buckets: Mapping[str, int] = field(default_factory=dict)


DEFAULT_RULES = Rules(
    patterns={b: [whole_word(w) for w in words] for b, words in BUCKET_WORDS.items()},
    names=BUCKET_NAMES,
    excluded_patterns=[whole_word(w) for w in EXCLUDED_WORDS],
    excluded_topics=EXCLUDED_TOPICS,
    topic_buckets=TOPIC_BUCKETS,
)


def add_rules(
    rules: Rules,
    bucket: int,
    patterns: Sequence[str] = (),
    topic_buckets: Mapping[str, int] | None = None,
    name: str | None = None,
) -> Rules:
    """A new rule table with more patterns for one bucket and more topic overrides."""
    merged = {b: list(p) for b, p in rules.patterns.items()}
    merged.setdefault(bucket, [])
    merged[bucket] = [*merged[bucket], *patterns]
    names = {**rules.names, **({bucket: name} if name else {})}
    return replace(
        rules, patterns=merged, names=names, topic_buckets={**rules.topic_buckets, **(topic_buckets or {})}
    )


def set_column_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Expose a source's own columns as ``name``, ``note``, ``topics``; absent ones are empty."""
    exprs = [
        F.coalesce(F.col(mapping[c]), F.lit("")).alias(c) if mapping.get(c) else F.lit("").alias(c)
        for c in ("name", "note", "topics")
    ]
    return df.select("*", *[e for e, c in zip(exprs, ("name", "note", "topics")) if c not in df.columns])


def _any_match(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def bucket_expression(rules: Rules, name: Column, note: Column, topics: Column) -> Column:
    """The whole decision list as one CASE expression."""
    text = F.concat_ws(" ", F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(note, F.lit(""))))
    listed = split_topics(topics)
    branches: list[tuple[Column, int]] = []
    if rules.excluded_topics:
        branches.append((F.arrays_overlap(listed, F.array(*map(F.lit, rules.excluded_topics))), OTHERS))
    if rules.excluded_patterns:
        branches.append((_any_match(text, rules.excluded_patterns), OTHERS))
    branches += [(_any_match(text, p), b) for b, p in rules.patterns.items() if p]
    branches += [(F.array_contains(listed, t), b) for t, b in rules.topic_buckets.items()]
    case = None
    for condition, bucket in branches:
        case = F.when(condition, bucket) if case is None else case.when(condition, bucket)
    return F.lit(OTHERS) if case is None else case.otherwise(OTHERS)


def classify(
    df: DataFrame, rules: Rules = DEFAULT_RULES, name: str = "name", note: str = "note", topics: str = "topics"
) -> DataFrame:
    """Add ``bucket`` and ``bucket_name``."""
    bucket = bucket_expression(rules, F.col(name), F.col(note), F.col(topics))
    pairs = [x for b, n in rules.names.items() for x in (F.lit(b), F.lit(n))]
    out = df.withColumn("bucket", bucket)
    return out.withColumn("bucket_name", F.try_element_at(F.create_map(*pairs), F.col("bucket")))
