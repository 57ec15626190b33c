"""Text normalisation, statistics, gates and identifiers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space within a line, as a regex class.
BLANK = r"[ \t\x0B\f\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC, which has no built-in: an Arrow-batched function."""
    return F.pandas_udf(_nfc, "string")(text)


#: Fixed values: (warning, pattern, replacement) of the regex steps, in order.
STEPS = (
    ("bom_removed", "^\ufeff", ""),
    ("line_endings", r"\r\n?", "\n"),
    ("trailing_blanks", rf"(?m){BLANK}+$", ""),
    ("control_characters", CONTROL, ""),
    ("blank_lines", r"\n{4,}", "\n\n\n"),
    ("outer_blank_lines", rf"\A(?:{BLANK}*\n)+|(?:\n{BLANK}*)+\z", ""),
)


def normalize(df: DataFrame, column: str = "text", out: str = "normalized_text") -> DataFrame:
    """df with the normalised text and the array `warnings` of the steps that changed it.

    Every step is a column of its own, so each regex runs once.  Null text stays null, without
    warnings; a result of fewer than ten characters adds low_text.
    """
    work, before = df.withColumn("_n0", nfc(F.col(column))), "_n0"
    flags = [F.when(F.col(column) != F.col("_n0"), F.lit("unicode_normalized"))]
    for i, (warning, pattern, to) in enumerate(STEPS, 1):
        work = work.withColumn(f"_n{i}", F.regexp_replace(before, pattern, to))
        flags.append(F.when(F.col(before) != F.col(f"_n{i}"), F.lit(warning)))
        before = f"_n{i}"
    flags.append(F.when(F.length(F.regexp_replace(F.col(before), rf"^(?:{BLANK}|\n)+|(?:{BLANK}|\n)+$", "")) < 10, F.lit("low_text")))
    work = work.withColumns({out: F.col(before), "warnings": F.array_compact(F.array(*flags))})
    return work.drop(*[c for c in work.columns if c.startswith("_n")])


def statistics(text: Column) -> dict[str, Column]:
    """character_count, word_count, line_count, blank_line_count and paragraph_count; empty text has no lines, null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))
    kinds = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(rf"^(?:{BLANK}|\r)*$"), "b").otherwise("x")), "")
    return {
        "character_count": F.length(t).cast("bigint"), "word_count": F.size(F.regexp_extract_all(t, F.lit(rf"(?:(?!{BLANK})[^\n\r])+"), F.lit(0))).cast("bigint"), "line_count": F.size(lines).cast("bigint"),
        "blank_line_count": (F.length(kinds) - F.length(F.replace(kinds, F.lit("b"), F.lit("")))).cast("bigint"), "paragraph_count": F.size(F.regexp_extract_all(kinds, F.lit("(x+)"))).cast("bigint"),
    }


#: Patterns of labels and leaked headings.
LABEL_PATTERN = r"^\*\*[^*\n]+:\*\*\s*\S"
HEADING_MARK_PATTERN = r"^#{1,6}\s+\S"
BOLD_HEADING_PATTERN = r"^\*\*[^*:\n]+\*\*[.\s]*$"


def assertion_type(text: Column, origin: Column | None = None) -> Column:
    """The regex arms of the claim gate, in order: empty, origin overrides, metadata label, leaked or bold heading, question, title, assertion."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    out = F.when(t == "", "empty")
    if origin is not None:
        for kind in ("table", "code_block", "block_quote"):
            out = out.when(origin == kind, kind)
    title = t.rlike(r"^[A-Z][A-Za-z0-9-]*( ([A-Z][A-Za-z0-9-]*|of|and|the|for|in|on|to|a)){0,7}$")
    return (
        out.when(t.rlike(LABEL_PATTERN), "metadata").when(t.rlike(HEADING_MARK_PATTERN), "heading").when(t.rlike(BOLD_HEADING_PATTERN), "heading")
        .when(t.rlike(r"\?[\"')\]]*$"), "question").when(title, "heading").otherwise("declarative_assertion")
    )


def short_id(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, size)


def source_line(text: Column) -> Column:
    """What the first **Source:** line names; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\*\*Source:\*\*[ \t]*([^\n]+)", 1)
    return F.when(found != "", F.trim(found))


def front_matter(text: Column) -> Column:
    """The lines between the opening --- and the next one; null without front matter."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"\A---[ \t]*\n((?:[^\n]*\n)*?)---[ \t]*(?:\n|\z)", 1)
    return F.when(found != "", found)


def provenance(text: Column) -> dict[str, Column]:
    """source, author and publication_date from front matter, else the **Source:** line; dates in three formats."""
    head = front_matter(text)
    field = lambda names: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^(?:{names})[ \t]*:[ \t]*[\"']?([^\n\"']+)", 1)), F.lit(""))
    date = field("date|published|publication_date|created")
    parsed = F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")])
    return {"source": F.coalesce(field("source|url|source_id"), source_line(text)), "author": field("author|authors|by"), "publication_date": parsed}


def naive_sentences(text: Column) -> Column:
    """Sentences of the naive baseline: markdown stripped, split after final marks, kept where a word has four letters or more."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in ((r"(?s)```.*?```", " "), (r"(?m)^\s*[#>*+-]+\s*", ""), (r"[*_`]", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.filter(F.split(F.trim(t), r"(?<=[.!?])\s+"), lambda s: s.rlike("[A-Za-z]{4}"))
