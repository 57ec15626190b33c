"""Problem 9: unfilled template slots, filler text, error pages and demands for scripts.

Nothing here knows what an error message says.  The statements of every document's own prose
(code, quotations and front matter set aside) are aligned over the whole collection.

* Slots: a statement with its marked spans, blanks, figures and names taken out is a frame.
  Records of one frame are aligned; a place where they hold different fillings is a slot.  A
  name that stands as a filling in several frames and under several marks is a variable name,
  and a mark most of whose contents are variable names is a slot mark.  A slot that still holds
  a variable name in slot marks, or a blank, flags its document.
* Page templates: a statement that hardly ever varies (it makes up most of all statements that
  begin or end like it) and comes back in several texts is rigid.  Texts of nothing but rigid
  statements and slots are hollow pages; a rigid statement of which a fair share stands on
  hollow pages is a message of an error, script or stub page and flags every document with it.
* Defaults: statements made of the printers' filler words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators.joins import salted

#: Words of the printers' filler text.
FILLER_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_ID = r"[^\W\d_](?:[\w .-]{0,38}?[^\W_])?"
#: Text between two runs of symbols, or a ruled blank with its name in brackets behind it.
_SPAN = re.compile(
    r"(?P<o>[\[{<$%@#~^|«:&=!/+\\]{1,4}|_{2,3})(?P<b>\s?)(?P<v>" + _ID + r")\s?(?P<c>[\]}>$%@#~^|»:&=!/+\\]{1,4}|_{2,3})|(?<!\w)_{3,}\s*\((?P<n>" + _ID + r")\)"
)
_BLANK = re.compile(r"(?<!\w)([_?.X#~=-])\1{3,}(?!\w)")
_MIRROR = str.maketrans("[{<«(", "]}>»)")
_MARKS = frozenset("[{<$%@#~^«:&=!/+\\_|")
_RUN = re.compile(r"([_?.X#~=-])\1\1\1")
_NAME = re.compile(r"(?<=\w\s)[^\W\d_a-z]\w+|(?<=,\s)[A-Z]\w+")
_FIGURE = re.compile(r"\d+(?:[.,:/-]\d+)*")
_WORD = re.compile(r"[^\W\d_]+")
_SLOT = "␟"
_SLOT_RUN = re.compile(_SLOT + r"(?:\s*" + _SLOT + r")+")
_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)[^\n]*$|\Z)", re.S | re.M)
_FRONT = re.compile(r"\A---\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_CODE = re.compile(r"``[^`]*``|`[^`]*`")
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|‘[^’\n]{2,400}’(?!\w)|(?<!\w)'[^'\n]{3,400}'(?!\w)|「[^」\n]{1,400}」|『[^』\n]{1,400}』|«[^»\n]{1,400}»")
_QUOTES = frozenset("\"“„‘'「『«")
_ANGLED = re.compile(r"«\s?[^\W\d_A-Z]+(?:[ _][^\W\d_A-Z]+){0,3}\s?»")
_MARK = re.compile(r"^\s*(?:#{1,6}\s+|[-*+•]\s+|\d{1,3}[.)]\s+)+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”')\]]*\s+(?=\S)|(?<=[。！？।؟።])\s*")
_OUTER = " \t.!?…。！？।؟።:;,-–—|_#\"'“”()"


def statements(text: str) -> list[str]:
    """Statements of the document's own prose, without emphasis marks, each quotation replaced by “”."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "")
    if t.startswith("---\n"):
        t = _FRONT.sub("", t, count=1)
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    own = []
    for line in t.split("\n"):
        bare = line.strip()
        if not bare or bare[0] == ">":
            continue
        if line.startswith(("    ", "\t")) and bare[0] not in "-*+" and "=" in bare:
            continue
        if "`" in bare:
            bare = _CODE.sub(" ", bare)
        bare = _MARK.sub("", bare).replace("**", "")
        if not _QUOTES.isdisjoint(bare):
            bare = _QUOTED.sub(lambda m: m[0] if _ANGLED.fullmatch(m[0]) else " “” ", bare)
        for s in _SENTENCE.split(bare):
            s = s.strip()
            if s:
                own.append(s)
    return own


def core(s: str) -> str:
    """Lower case, without emphasis marks, outer punctuation and doubled blanks."""
    return " ".join(s.lower().replace("’", "'").replace("*", "").split()).strip(_OUTER)


def latin_filler(c: str) -> bool:
    """Whether a statement, in lower case, is made of the printers' filler words: four or more words, at least .7 of them."""
    if len(FILLER_LATIN.intersection(c.replace(",", " ").split(" "))) < 2:
        return False
    words = _WORD.findall(c)
    return len(words) >= 4 and sum(w in FILLER_LATIN for w in words) >= 0.7 * len(words)


def ends(c: str) -> tuple[str, str]:
    """The first and the last two words; of a statement without blanks, four characters."""
    w = c.split(" ")
    return (c[:4], c[-4:]) if len(w) == 1 else (" ".join(w[:2]), " ".join(w[-2:]))


def spans(s: str) -> list[tuple[str, str, int, int]]:
    """(mark, contents, start, end) of the spans between two runs of symbols that mirror each other."""
    out = []
    for m in _SPAN.finditer(s):
        if m["n"]:
            out.append(("____()", m["n"], m.start(), m.end()))
            continue
        o, c = m["o"], m["c"]
        mirrored = o[::-1].translate(_MIRROR)
        if c in mirrored or len(c) >= 2 and mirrored in c:
            out.append((o + ("_" if m["b"] else "") + c, m["v"], m.start(), m.end()))
    return out


def variable(v: str) -> str:
    return re.sub(r"[\s_.-]+", " ", v).strip().lower()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def aligned_parts(s: str) -> tuple[str, list[tuple[str, str]]]:
    """(frame, [(mark, contents)]): the statement with spans, blanks, figures and names as slots, and what marks and blanks hold."""
    found: list[tuple[str, str]] = []
    m = s
    if not _MARKS.isdisjoint(s):
        at = spans(s)
        found += [(mark, variable(v)) for mark, v, _, _ in at]
        for _, _, a, b in reversed(at):
            m = m[:a] + _SLOT + m[b:]
    if _RUN.search(m):
        found += [("blank", x[1]) for x in _BLANK.finditer(m)]
        m = _BLANK.sub(_SLOT, m)
    return _SLOT_RUN.sub(_SLOT, core(_FIGURE.sub(_SLOT, _NAME.sub(_SLOT, m)))), found


_ROW = "c array<bigint>, a array<bigint>, z array<bigint>, latin array<bigint>, filled array<bigint>, spans array<struct<c:bigint,f:bigint,bare:boolean,mark:string,v:string>>"


def scan(text: str) -> tuple[list, list, list, list, list, list]:
    """What one text gives to the alignment: statements, their beginnings, their ends, filler statements, filled frames, spans."""
    cores: dict[int, tuple[int, int]] = {}
    latin: set[int] = set()
    filled: set[int] = set()
    held: set[tuple] = set()
    for s in statements(text):
        c = _FIGURE.sub("0", core(s))
        if not c:
            continue
        h = _hash(c)
        if h not in cores:
            a, z = ends(c)
            cores[h] = (_hash(a), _hash(z))
            if latin_filler(c):
                latin.add(h)
        frame, found = aligned_parts(s)
        bare = frame == _SLOT
        if found:
            f = _hash(frame)
            held.update((h, f, bare, mark, v) for mark, v in found if mark != "blank" or not bare)
        elif _SLOT in frame and not bare:
            filled.add(_hash(frame))
    return list(cores), [a for a, _ in cores.values()], [z for _, z in cores.values()], list(latin), list(filled), list(held)


def slot_fillings(spans_: DataFrame, filled: DataFrame, least_frames: int = 2, least_marks: int = 3, purity: float = 0.5) -> DataFrame:
    """f, mark, v, kind of every filling that is an unfilled slot.

    spans_: (t, f, bare, mark, v), a span per text; filled: (f), frames with ordinary fillings.
    A frame is aligned if another record fills it otherwise.  Variable names stand in at least
    `least_frames` aligned frames under at least `least_marks` marks; contents that hold a variable
    name and at most two words more are variables as well.  Slot marks hold variables in a share of
    at least `purity` of their spans.  A blank counts in an aligned frame if its symbol is blank in
    at least `least_frames` of them.
    """
    g = spans_.groupBy("f", "bare", "mark", "v").agg(F.count("*").alias("n"))
    # sides that grow with the collection are never broadcast
    frames = g.where("not bare").groupBy("f").agg(F.count("*").alias("kinds"))
    ordinary = frames.select("f").join(filled.select("f").distinct(), "f", "left_semi").withColumn("ordinary", F.lit(True)).hint("merge")
    aligned = frames.join(ordinary, "f", "left").where("ordinary or kinds > 1").select("f").withColumn("aligned", F.lit(True)).hint("merge")
    g = g.join(aligned, "f", "left")
    seen = g.where("aligned and not bare").groupBy("v").agg(F.count_distinct("f").alias("frames"), F.count_distinct("mark").alias("marks"), F.max(F.col("mark") == "blank").alias("is_blank"))
    names = seen.where((F.col("frames") >= least_frames) & (F.col("marks") >= least_marks) & ~F.col("is_blank")).select(F.col("v").alias("name"))
    symbols = seen.where((F.col("frames") >= least_frames) & F.col("is_blank")).select("v").withColumn("symbol", F.lit(True))
    # runs of words inside the contents, all but at most two of them
    length = lambda less: F.greatest(F.lit(1), F.size("w") - less)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda less: F.transform(
        F.sequence(F.lit(1), F.size("w") - length(less) + 1), lambda i: F.array_join(F.slice("w", i, length(less)), " "))))
    contents = g.where("mark != 'blank'").select("v").distinct().withColumn("w", F.split("v", " ")).select("v", F.explode(F.array_distinct(runs)).alias("name"))
    variables = contents.join(names, "name", "left_semi").select("v").distinct().withColumn("known", F.lit(True)).hint("merge")
    g = g.join(variables, "v", "left")
    marks = g.where("mark != 'blank'").groupBy("mark").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("good"))
    marks = marks.where((F.col("good") >= purity * F.col("all")) & (F.col("good") > 1)).select("mark").withColumn("slot_mark", F.lit(True))
    g = g.join(marks, "mark", "left").join(symbols, "v", "left")
    kind = F.when(F.col("known") & F.col("slot_mark"), "slot").when((F.col("mark") == "blank") & F.col("aligned") & F.col("symbol"), "blank")
    return g.withColumn("kind", kind).where("kind is not null").select("f", "mark", "v", "kind")


def page_templates(cores: DataFrame, need: DataFrame, excused: DataFrame, least_texts: int, least_pages: int, share: float, scratch: Scratch) -> DataFrame:
    """t, c: the statements of each text that are messages of hollow pages.

    cores: (t, c, a, z) statements of distinct texts with the hashes of their beginning and end; need:
    (t, n_statements); excused: (t, c) statements that hold slots or filler.
    """
    n = cores.groupBy("c").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.min("z").alias("z"))
    n = scratch.table(n)
    # only one statement can make up more than half of all that begin, or end, like it
    rigid = None
    for end in ("a", "z"):
        top = n.groupBy(end).agg(F.sum("n").alias("total"), F.max(F.struct("n", "c")).alias("top")).where(F.col("top.n") * 2 > F.col("total"))
        top = top.select(F.col("top.c").alias("c"), F.col("top.n").alias("n")).where(F.col("n") >= least_texts)
        rigid = top if rigid is None else rigid.unionByName(top)
    rigid = scratch.table(rigid.distinct())
    held = scratch.table(salted(cores.select("t", "c"), rigid, ["c"], "t").select("t", "c", "n"))
    counted = held.select("t", "c").unionByName(excused.select("t", "c")).distinct().groupBy("t").agg(F.count("*").alias("m"))
    hollow = counted.join(need.hint("merge"), "t").where("m = n_statements").select("t")
    pages = held.join(hollow.hint("merge"), "t", "left_semi").groupBy("c", "n").agg(F.count("*").alias("pages"))
    messages = pages.where((F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("n"))).select("c")
    out = scratch.table(salted(held.select("t", "c"), messages, ["c"], "t"))
    scratch.drop(n)
    return out


def findings(
    documents: DataFrame, least_texts: int = 3, least_pages: int = 2, share: float = 0.08, least_frames: int = 2, least_marks: int = 3, purity: float = 0.5,
) -> DataFrame:
    """doc_id, kind, n: kinds of residue (slot, blank, filler, page template) of every document that holds any, with their number.

    Null and empty texts hold none, nor does what stands in code, quotations, quote blocks or front
    matter.  Everything is counted over distinct texts, so copies of one text prove nothing about
    its statements, but all of them are reported.  What comes but once in the collection has
    nothing to be aligned with and is found only by slot marks and names learned elsewhere.  A null
    doc_id is reported as null; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "residue")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, xxhash.xxh3_128_digest(text), *scan(text)) for i, text in zip(b["doc_id"], b["text"], strict=True) if text]
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "t", "c", "a", "z", "latin", "filled", "spans"])
                out["spans"] = pd.Series([[dict(zip(("c", "f", "bare", "mark", "v"), x, strict=True)) for x in held] for held in out["spans"]], dtype=object)
                yield out

    # ids travel as strings: a batch with a null would make floats of numbers
    ids = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    scanned = ids.mapInPandas(run, f"doc_id string, t binary, {_ROW}")
    scanned = scratch.table(scanned.withColumn("doc_id", F.col("doc_id").cast(dict(documents.dtypes)["doc_id"])))
    texts = scratch.table(scanned.drop("doc_id").dropDuplicates(["t"]))
    spans_ = texts.select("t", F.explode("spans").alias("x")).select("t", "x.*")
    fillings = scratch.table(slot_fillings(spans_, texts.select(F.explode("filled").alias("f")), least_frames, least_marks, purity))
    slots = salted(spans_, fillings, ["f", "mark", "v"], "t").select("t", "c", "kind")
    filler = texts.select("t", F.explode("latin").alias("c")).withColumn("kind", F.lit("filler"))
    marked = scratch.table(slots.unionByName(filler).distinct())
    cores = texts.select("t", F.explode(F.arrays_zip("c", "a", "z")).alias("x")).select("t", "x.*")
    need = texts.select("t", F.size("c").alias("n_statements"))
    messages = page_templates(cores, need, marked, least_texts, least_pages, share, scratch).withColumn("kind", F.lit("page template"))
    kinds = marked.unionByName(messages).groupBy("t", "kind").agg(F.count("*").alias("n"))
    return salted(scanned.select("doc_id", "t"), kinds, ["t"], "doc_id").select("doc_id", "kind", "n")


def residue(documents: DataFrame) -> DataFrame:
    """doc_id of every document with residue."""
    return findings(documents).select("doc_id").distinct()


def clean(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns; those of null text or null doc_id are kept."""
    return documents.join(residue(documents), "doc_id", "left_anti")
