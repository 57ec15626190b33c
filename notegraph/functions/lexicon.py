"""Word lists and lexical measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
NEGATION_MARKERS = (
    "not", "no", "never", "neither", "nor", "without", "n't", "cannot", "can't", "won't", "doesn't", "don't", "isn't", "aren't", "wasn't", "weren't",
    "hasn't", "haven't", "hadn't", "wouldn't", "couldn't", "shouldn't",
)
NEGATION_CUES = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "can't", "won't", "isn't", "aren't", "wasn't", "weren't", "doesn't", "don't", "didn't", "hasn't", "haven't", "hadn't",
    "shouldn't", "wouldn't", "couldn't", "without", "lacks", "lacking", "fails", "failed", "unable", "incorrect", "false", "wrong",
)
MODALITY = {
    "impossible": ("cannot", "can't", "impossible"),
    "required": ("must", "will", "shall", "need", "have to", "has to"),
    "probable": ("probably", "likely", "should", "ought"),
    "possible": ("may", "might", "could", "can"),
}
CONDITIONAL_MARKERS = ("if", "unless", "when", "whenever", "provided", "assuming")
COMPARISON_MARKERS = (
    "faster", "slower", "better", "worse", "more", "less", "higher", "lower", "greater", "smaller", "stronger", "weaker", "outperforms", "underperforms",
    "exceeds", "beats", "superior", "inferior", "compared", "than",
)
ATTRIBUTION_CUES = (
    "benchmark", "benchmarks", "audit", "audits", "review", "reviews", "experiment", "experiments", "study", "studies", "test", "tests", "testing", "confirm",
    "confirms", "confirmed", "confirming", "report", "reports", "reported", "reporting", "observe", "observes", "observed", "observing", "measure", "measures",
    "measured", "measuring", "verify", "verifies", "verified", "verifying", "independent", "internal", "external",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "but", "by", "can", "could", "did", "do", "does", "each",
    "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in", "into", "is", "it", "its", "just", "may", "more", "most", "must", "no", "not", "of", "on", "one", "only",
    "or", "other", "our", "out", "over", "same", "she", "should", "since", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those",
    "through", "to", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "would", "you", "your",
)


def _list(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column) -> Column:
    """Lower-case words between runs of whitespace; null gives none."""
    trimmed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.filter(F.split(trimmed, " "), lambda w: w != "")


def is_negated(text: Column) -> Column:
    return F.arrays_overlap(words(text), _list(NEGATION_MARKERS))


def modality(text: Column) -> Column:
    """impossible before required before probable before possible, else certain."""
    found = words(text)
    out = F.when(F.lit(False), "certain")
    for name, markers in MODALITY.items():
        out = out.when(F.arrays_overlap(found, _list(markers)), name)
    return out.otherwise("certain")


def is_conditional(text: Column) -> Column:
    return F.arrays_overlap(words(text), _list(CONDITIONAL_MARKERS))


def is_comparative(text: Column) -> Column:
    return F.arrays_overlap(words(text), _list(COMPARISON_MARKERS))


def is_quoted(text: Column) -> Column:
    """Whether a straight double or single quotation mark stands in the text."""
    return F.coalesce(text.rlike("[\"']"), F.lit(False))


def has_negation_cue(text: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z']+)")), _list(NEGATION_CUES))


def content_tokens(text: Column, without: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case tokens of more than three characters that are no stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)")))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 3), _list(STOP_WORDS + without))


def capitalized(text: Column, skip_first: bool = False) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"))
    if skip_first:
        found = F.slice(found, 2, 1_000_000)
    return F.array_distinct(F.filter(found, lambda t: t.rlike("^[A-Z]") & ~F.array_contains(_list(STOP_WORDS), F.lower(t))))


def relatedness(a: Column, b: Column) -> Column:
    """Jaccard overlap of content tokens, at least .5 where a capitalised word is shared; null texts give 0."""
    x, y = content_tokens(a), content_tokens(b)
    jaccard = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    shared = F.size(F.array_intersect(capitalized(a), capitalized(b))) > 0
    return F.when(shared, F.greatest(jaccard, F.lit(0.5))).otherwise(jaccard)


def specificity(text: Column) -> Column:
    """Content tokens + 2 numbers + 2 years + 1.5 months + 1.5 capitalised words after the first; words are runs of ASCII letters, digits and _."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit("([A-Za-z0-9_]+)"))
    numbers = F.size(F.regexp_extract_all(t, F.lit(r"([0-9]+(\.[0-9]+)?)")))
    years = F.size(F.filter(found, lambda w: w.rlike("^(18|19|20)[0-9]{2}$")))
    months = F.size(F.filter(found, lambda w: F.array_contains(_list(MONTHS), F.lower(w))))
    return F.size(content_tokens(t, ATTRIBUTION_CUES)) + 2.0 * numbers + 2.0 * years + 1.5 * months + 1.5 * F.size(capitalized(t, skip_first=True))
