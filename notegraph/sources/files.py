"""File sources: discovery, filters, decoding and loading of Markdown, text and PDF files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.config import DEFAULTS
from notegraph.functions import text as T
from notegraph.operators.joins import salted


class DiscoveryError(ValueError):
    """A root that cannot be scanned."""


def validate_roots(roots: list[str]) -> list[str]:
    if not roots:
        raise DiscoveryError("no directory given")
    for r in roots:
        p = Path(r)
        if not p.exists() or not p.is_dir():
            raise DiscoveryError(f"not a directory: {r}")
    return [str(Path(r).resolve()) for r in roots]


def discover(spark: SparkSession, roots: list[str], ignored: list[str] | None = None) -> DataFrame:
    """path, relative_path, source_root, format, size_bytes, modified_at, hash, content, rejection_reason of all files below the roots.

    Hidden and ignored path parts are left out; rejected are unknown extensions and files above the size
    limit.  The reader lists no empty files, so they have no row.
    """
    rules = DEFAULTS["discovery"]
    out = None
    for root in validate_roots(roots):
        # the reader itself skips nothing, so hidden and ignored parts are filtered on the path
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = raw.withColumn("source_root", F.lit(root))
        out = rows if out is None else out.unionByName(rows)
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.expr("substring(plain, length(source_root) + 2)")
    parts = F.split("relative_path", "/")
    skip = F.exists(parts, lambda p: p.startswith(".") | p.isin(*(ignored or rules["ignored"])))
    suffix = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    reason = F.when(~suffix.isin(*rules["extensions"]), "unsupported_extension").when(F.col("length") == 0, "empty_file").when(F.col("length") > rules["max_bytes"], "too_large")
    rows = out.withColumn("plain", path).withColumn("relative_path", relative).where(~skip)
    return rows.select(
        F.col("plain").alias("path"), "relative_path", "source_root", F.when(suffix == ".md", "markdown").when(suffix == ".txt", "text").when(suffix == ".pdf", "pdf").alias("format"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("hash"), "content", reason.alias("rejection_reason"),
    )


def duplicates(hashed: DataFrame, key: str = "path") -> DataFrame:
    """key, canonical_<key>, is_canonical: per hash the first key stands for all; keys are unique.

    The first key is a partial aggregate, so a hash that many keys share is never gathered.
    """
    name = "canonical_key" if key == "doc_key" else f"canonical_{key}"
    first = hashed.groupBy("hash").agg(F.min(key).alias(name))
    return salted(hashed.select(key, "hash"), first, ["hash"], key).select(key, name, (F.col(key) == F.col(name)).alias("is_canonical"))


def decode_bytes(raw: bytes) -> tuple[str, str, bool]:
    """(text, encoding, whether mixed line endings) by utf-8, utf-8-sig, utf-16 (with its mark, or where a quarter of all bytes is NUL), latin-1; NUL removed."""
    if raw[:3] == b"\xef\xbb\xbf":
        text, used = raw.decode("utf-8-sig", errors="replace"), "utf-8-sig"
    elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text, used = raw.decode("utf-16", errors="replace"), "utf-16"
    elif len(raw) % 2 == 0 and raw.count(0) * 4 >= len(raw) > 0:
        high = raw[::2].count(0) > raw[1::2].count(0)
        text, used = raw.decode("utf-16-be" if high else "utf-16-le", errors="replace"), "utf-16"
    else:
        try:
            text, used = raw.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            text, used = raw.decode("latin-1"), "latin-1"
    mixed = "\r\n" in text and "\n" in text.replace("\r\n", "")
    return text.replace("\x00", ""), used, mixed


def read_pdf(raw: bytes) -> tuple[str, list[str]]:
    """Text layer of a PDF, page by page, and warnings where it exceeds the limits of pages or characters; needs pypdf."""
    import io

    import pypdf

    limit = DEFAULTS["parsing"]
    pages = pypdf.PdfReader(io.BytesIO(raw)).pages
    text = "\n\n\f\n\n".join(p.extract_text() or "" for p in pages[: limit["pdf_pages"]])
    warnings = [w for w, on in (("pdf_pages_left_out", len(pages) > limit["pdf_pages"]), ("pdf_text_cut", len(text) > limit["pdf_chars"])) if on]
    return text[: limit["pdf_chars"]], warnings


def load(files: DataFrame) -> DataFrame:
    """doc_id, path, format, text, encoding, read_warnings, error of accepted files; a failing file has error and null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, p, f, raw in zip(b["hash"], b["path"], b["format"], b["content"], strict=True):
                try:
                    if f == "pdf":
                        text, warnings = read_pdf(raw)
                        out.append((h, p, f, text, "pdf", warnings, None))
                    else:
                        text, used, mixed = decode_bytes(raw)
                        warnings = [w for w, on in (("encoding_fallback", used != "utf-8"), ("mixed_line_endings", mixed), ("nul_removed", b"\x00" in raw and used != "utf-16")) if on]
                        out.append((h, p, f, text, used, warnings, None))
                except Exception as x:  # noqa: BLE001
                    out.append((h, p, f, None, None, [], f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "format", "text", "encoding", "read_warnings", "error"])

    accepted = files.where("rejection_reason is null").select("hash", "path", "format", "content")
    return accepted.mapInPandas(run, "doc_id string, path string, format string, text string, encoding string, read_warnings array<string>, error string")


def documents(files: DataFrame) -> DataFrame:
    """Loaded documents, once per content, normalised, with statistics and provenance."""
    first = files.where("rejection_reason is null").withColumn("o", F.row_number().over(Window.partitionBy("hash").orderBy("path"))).where("o = 1").drop("o")
    out = T.normalize(load(first))
    return out.withColumns(T.statistics(F.col("normalized_text")) | T.provenance(F.col("text")))
