"""Markdown blocks and rule-based sentences of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Line patterns of block types.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
SETEXT = {"=": re.compile(r"^={3,}\s*$"), "-": re.compile(r"^-{3,}\s*$")}
BULLET = re.compile(r"^(\s*)[*+\-]\s+(.+)$")
ORDERED = re.compile(r"^(\s*)\d+[.)]\s+(.+)$")
QUOTE = re.compile(r"^>\s*(.*)")
FENCE = re.compile(r"^(`{3,}|~{3,})")
TABLE = re.compile(r"^\|(.+)\|")
RULE = re.compile(r"^(\*{3,}|-{3,}|_{3,})\s*$")
FRONT = re.compile(r"^---\s*$")
#: Abbreviations after which a full stop ends nothing.
ABBREVIATIONS = frozenset(("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "rev", "gen", "e.g", "i.e", "vs", "etc", "fig", "no", "vol", "pt", "pp", "u.s", "u.k", "a.m", "p.m", "ph.d", "m.d", "b.c", "a.d"))


@dataclass
class Block:
    kind: str
    text: str
    level: int | None
    start: int
    end: int


def scan(text: str) -> list[Block]:
    """Blocks of a document in order with their places, marks included.

    Each line is tested as front matter (first line only, if it is closed), fence, blank, rule,
    heading, quote, table row, bullet, ordered item, paragraph; an unclosed fence ends with the text.
    """
    lines: list[tuple[str, int]] = []
    at = 0
    for line in text.split("\n"):
        lines.append((line, at))
        at += len(line) + 1
    out: list[Block] = []
    i, n = 0, len(lines)
    para: list[int] = []

    def flush() -> None:
        if para:
            first, last = lines[para[0]], lines[para[-1]]
            out.append(Block("paragraph", "\n".join(lines[k][0] for k in para).strip(), None, first[1], last[1] + len(last[0])))
            para.clear()

    def group(kind: str, test, strip) -> int:
        j = i
        while j < n and test(lines[j][0]):
            j += 1
        out.append(Block(kind, "\n".join(strip(lines[k][0]) for k in range(i, j)).strip(), None, lines[i][1], lines[j - 1][1] + len(lines[j - 1][0])))
        return j

    if n and FRONT.match(lines[0][0]):
        close = next((k for k in range(1, n) if FRONT.match(lines[k][0])), None)
        if close is not None:
            out.append(Block("front_matter", "\n".join(x for x, _ in lines[1:close]), None, 0, lines[close][1] + len(lines[close][0])))
            i = close + 1
    while i < n:
        line, start = lines[i]
        fence = FENCE.match(line)
        if fence:
            flush()
            mark = fence[1][0] * 3
            j = next((k for k in range(i + 1, n) if lines[k][0].strip().startswith(mark) and not lines[k][0].strip().strip(mark[0])), n - 1)
            inner = range(i + 1, j if j < n and lines[j][0].strip().startswith(mark) and j > i else n)
            out.append(Block("code_block", "\n".join(lines[k][0] for k in inner), None, start, lines[j][1] + len(lines[j][0])))
            i = j + 1
        elif not line.strip():
            flush()
            i += 1
        elif RULE.match(line) and not (para and SETEXT["-"].match(line)):
            flush()
            out.append(Block("horizontal_rule", line.strip(), None, start, start + len(line)))
            i += 1
        elif (m := HEADING.match(line)) is not None:
            flush()
            out.append(Block("heading", m[2].rstrip("#").strip(), len(m[1]), start, start + len(line)))
            i += 1
        elif i + 1 < n and not para and SETEXT["="].match(lines[i + 1][0]):
            flush()
            out.append(Block("heading", line.strip(), 1, start, lines[i + 1][1] + len(lines[i + 1][0])))
            i += 2
        elif i + 1 < n and not para and SETEXT["-"].match(lines[i + 1][0]) and not (BULLET.match(line) or ORDERED.match(line) or QUOTE.match(line) or TABLE.match(line)):
            flush()
            out.append(Block("heading", line.strip(), 2, start, lines[i + 1][1] + len(lines[i + 1][0])))
            i += 2
        elif QUOTE.match(line):
            flush()
            i = group("block_quote", lambda x: QUOTE.match(x) is not None, lambda x: QUOTE.match(x)[1])
        elif TABLE.match(line):
            flush()
            i = group("table", lambda x: TABLE.match(x) is not None, str.strip)
        elif (m := BULLET.match(line)) is not None or (m := ORDERED.match(line)) is not None:
            flush()
            out.append(Block("bullet_item" if BULLET.match(line) else "ordered_item", m[2].strip(), None, start, start + len(line)))
            i += 1
        else:
            para.append(i)
            i += 1
    flush()
    return out


def prose(kind: str, text: str) -> str:
    """The prose of a block: items and quotes end with a full stop, table rows read "header: value.", other kinds have none."""
    if kind in ("bullet_item", "ordered_item", "block_quote"):
        t = text.strip()
        return t if not t or t[-1] in ".?!" else t + "."
    if kind == "table":
        rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in text.split("\n") if not re.match(r"^\|[\s\-:|]+\|", r)]
        return "\n".join(" ".join(f"{h}: {v}." for h, v in zip(rows[0], r, strict=False) if v) for r in rows[1:]) if rows else ""
    return text if kind == "paragraph" else ""


def split_sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) by rule: . ? ! with blanks and a capital or digit behind it, but for abbreviations, decimals and trailing dots."""
    out, at, n = [], 0, len(text)
    for m in re.finditer(r"[.?!]+[\"'”’)\]]*", text):
        mark, end = m[0], m.end()
        nxt = re.match(r"\s+[\"'“‘(\[]*([^\W_])", text[end : end + 40])
        if not nxt or not (nxt[1].isupper() or nxt[1].isdigit()):
            continue
        if mark.startswith("..") and set(mark) <= {"."}:
            continue
        word = re.search(r"[A-Za-z.]*$", text[max(0, m.start() - 12) : m.start()])[0].lower().lstrip(".")
        if mark[0] == "." and word in ABBREVIATIONS:
            continue
        part = text[at:end]
        out.append((at + len(part) - len(part.lstrip()), end))
        at = end
    part = text[at:n]
    if part.strip():
        out.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
    return out


def block_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, event_no, block_type, text, heading_level, char_start, char_end of every block; null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, x.kind, x.text, x.level, x.start, x.end) for k, t in zip(b["key"], b["text"], strict=True) if t for i, x in enumerate(scan(t), 1)]
            yield pd.DataFrame(out, columns=["key", "event_no", "block_type", "text", "heading_level", "char_start", "char_end"]).astype({"heading_level": "Int32"})

    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, event_no int, block_type string, text string, heading_level int, char_start int, char_end int")
    return rows.withColumnRenamed("key", key)


def contexts(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """events with `context`, the path of headings above: per level the last heading not closed by one of a lower level.

    Titles without letters or digits are ignored; one document is one window partition.
    """
    w = Window.partitionBy(key).orderBy("event_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = (F.col("block_type") == "heading") & F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    out = events
    for level in range(1, 7):
        mine = title & (F.col("heading_level") == level)
        out = out.withColumn(f"_p{level}", F.max(F.when(mine, F.col("event_no"))).over(w)).withColumn(f"_t{level}", F.last(F.when(mine, F.trim("text")), ignorenulls=True).over(w))
    parts = []
    for level in range(1, 7):
        lower = [F.coalesce(F.col(f"_p{k}"), F.lit(-1)) for k in range(1, level)]
        top = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(-1)
        parts.append(F.when(F.col(f"_p{level}") > top, F.col(f"_t{level}")))
    return out.withColumn("context", F.concat_ws(" > ", *parts)).drop(*[f"_{x}{k}" for x in "pt" for k in range(1, 7)])


def sentences(events: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """key, event_no, position, text, char_start, context, sentence_id of all rule-based sentences of at least `least` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, e, kind, t, start, ctx in zip(b["key"], b["event_no"], b["block_type"], b["text"], b["char_start"], b["context"], strict=True):
                p = prose(kind, t or "")
                out += [(k, e, i, p[s:x], None if start is None or pd.isna(start) else int(start) + s, ctx) for i, (s, x) in enumerate(split_sentences(p)) if x - s >= least]
            yield pd.DataFrame(out, columns=["key", "event_no", "n", "text", "char_start", "context"]).astype({"char_start": "Int32"})

    kind = dict(events.dtypes)[key]
    rows = contexts(events, key).select(F.col(key).alias("key"), "event_no", "block_type", "text", "char_start", "context")
    out = rows.mapInPandas(run, f"key {kind}, event_no int, n int, text string, char_start int, context string")
    w = Window.partitionBy("key").orderBy("event_no", "n")
    sid = F.substring(F.sha2(F.concat_ws(":", F.col("key").cast("string"), "text", F.col("char_start").cast("string")), 256), 1, 16)
    return out.withColumns({"position": F.row_number().over(w) - 1, "sentence_id": sid}).drop("n").withColumnRenamed("key", key)


def sentence_problems(sentences: DataFrame) -> DataFrame:
    """document_id, sentence_id, problem of sentences: empty, duplicate_id, position_order, bad_offsets; several rows where several hold.

    sentences: document_id, sentence_id, position, text, char_start, char_end.  Positions must grow within a document
    as they stand by their offsets; the window holds one document.
    """
    w = Window.partitionBy("document_id").orderBy("char_start", "sentence_id")
    ids = sentences.groupBy("document_id", "sentence_id").agg(F.count("*").alias("times"))
    rows = sentences.join(ids, ["document_id", "sentence_id"]).withColumn("before", F.lag("position").over(w))
    found = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"), F.when(F.col("times") > 1, "duplicate_id"),
        F.when(F.col("position") <= F.col("before"), "position_order"), F.when((F.col("char_start") >= F.col("char_end")) & (F.col("char_end") > 0), "bad_offsets"),
    ))
    return rows.select("document_id", "sentence_id", F.explode(found).alias("problem"))
