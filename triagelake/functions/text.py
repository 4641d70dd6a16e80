"""Text expressions with one meaning of white space: Unicode's, as in Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it for
    each element."""
    return F.get(F.transform(F.array(value), use), 0)


def hold(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the named columns, made once: behind a generator of one row, which the
    optimizer does not look through."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def windows(text: Column, n: int, least: int | None = None) -> Column:
    """From each place of the text the ``n`` characters there (at its end fewer, but
    ``least`` or more), in time linear in the text."""
    least = least or n

    def by_characters(chars: Column) -> Column:
        return F.when(
            F.size(chars) >= least,
            F.transform(F.sequence(F.lit(1), F.size(chars) - least + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), "")),
        ).otherwise(F.array().cast("array<string>"))

    by_pattern = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{least},{n}}}))"), F.lit(1))
    # the pattern's places are 16-bit units: not for characters of two
    two = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(two, bind(F.filter(F.split(text, ""), lambda x: x != ""), by_characters)).otherwise(by_pattern)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, rf"{SPACE}+", "")


@F.pandas_udf(T.ArrayType(T.LongType()))
def starts_of(sizes: pd.Series) -> pd.Series:
    """Of each array of sizes where its parts begin, one character apart: only sizes go to Python."""
    return sizes.map(lambda x: None if x is None else np.concatenate([[0], np.cumsum(np.asarray(x, np.int64) + 1)])[: len(x)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def last_true(flags: pd.Series) -> pd.Series:
    """Of each array of flags, at every place the last place so far with a true one, or -1."""
    def places(x: np.ndarray) -> np.ndarray:
        known = np.array([v is not None and bool(v) for v in x], bool)
        return np.maximum.accumulate(np.where(known, np.arange(len(x)), -1)).astype(np.int32)

    return flags.map(lambda x: None if x is None else places(x))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return F.coalesce(out, F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def ordered_distinct(items: Column) -> Column:
    """Stripped, without blanks, each once, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def trigram_terms(query: Column) -> Column:
    """Distinct search terms: white-space tokens of three characters or more, then
    the three-character windows at every second place of the stripped query."""
    def terms(clean: Column) -> Column:
        tokens = F.filter(F.split(clean, rf"{SPACE}+"), lambda t: F.length(t) >= 3)
        return F.array_distinct(F.concat(tokens, F.filter(windows(clean, 3), lambda x, i: i % 2 == 0)))

    return bind(strip(F.replace(query, F.lit('"'), F.lit(" "))), terms)


def sentences(c: Column) -> Column:
    """Parts that end with a sentence mark, which they keep."""
    return F.split(c, r"(?<=[。！？；])")


def uuid_of_hash(c: Column) -> Column:
    """The first 32 hex digits of SHA-256 in the form of a UUID."""
    return F.regexp_replace(F.left(F.sha2(c, 256), F.lit(32)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def hash_vector(c: Column) -> Column:
    """A unit vector of 32 components from the SHA-256 of a text (bytes less 127.5)."""
    def unit(raw: Column) -> Column:
        return bind(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(raw, lambda x: x / norm))

    def components(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") - 127.5
        )

    return bind(F.sha2(c, 256), lambda digest: bind(components(digest), unit))


def parse_json_object(c: Column) -> Column:
    """The JSON object in a model's answer: without a code fence, or from the
    first to the last brace; null where it is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    salvaged = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    value = F.coalesce(F.try_parse_json(body), F.try_parse_json(salvaged))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def grouped_summary(items: Column, prefix: str = "负责", fallback: str = "职责来源") -> Column:
    """Evidence items (array<struct<source, quote>>) as text: sources in order of
    first occurrence, each with its distinct quotes as bullet lines.  A quote that
    starts with ``prefix`` loses it; blank quotes have no effect."""
    clean = F.transform(items, lambda e: F.struct(
        first_filled(e["source"], F.lit(fallback)).alias("source"),
        F.when(
            strip(e["quote"]).startswith(prefix),
            F.regexp_replace(F.substr(strip(e["quote"]), F.lit(len(prefix) + 1)), rf"\A{SPACE}+", ""),
        ).otherwise(F.coalesce(strip(e["quote"]), F.lit(""))).alias("quote"),
    ))
    clean = F.filter(clean, lambda e: e["quote"] != "")
    sources = F.array_distinct(F.transform(clean, lambda e: e["source"]))
    blocks = F.transform(sources, lambda s: F.concat(
        F.lit("“"), s, F.lit("”负责：\n\n"),
        F.array_join(F.transform(
            F.array_distinct(F.transform(F.filter(clean, lambda e: e["source"] == s), lambda e: e["quote"])),
            lambda q: F.concat(F.lit("- "), q)), "\n"),
    ))
    return F.nullif(F.array_join(blocks, "\n\n"), F.lit(""))
