"""Problem 1: the same records, exactly or almost, in evaluation and training splits.

Records that are the same hold equal figures, months and negations on both sides and at least
one name in common, but for slips.  The names are joined by an edit-distance segment join:
those of evaluation records are cut into k + 1 segments, of which a name within k edits must
hold at least one unchanged and at one of few positions; names of training records are probed
for them, and the pairs that meet are verified with banded dynamic programming.  The equal
figures, months and negations are part of every segment's key, so no segment is common to many
records that differ in them.  Of the pairs that pass, names and words of both sides are
compared exactly.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.llm import record_text as R
from notegraph.llm.splits import normal_split
from notegraph.operators.joins import salted

#: Edits that a string of many words, the key of a record without names, may be away.
EDITS = 3
#: A word belongs to the shared vocabulary from this share of texts on, so it holds at most 1 / share times the words of a mean text.
VOCABULARY_SHARE = 0.001
EVALUATION = ("dev", "test")


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the k + 1 segments of a string: even sizes, the longer ones last."""
    small, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = small + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def edits_for(s: str) -> int:
    """Edits that may lie between a key string and a longer or shorter one: as many as two names of such lengths may differ by."""
    if " " in s:
        return EDITS
    return 0 if len(s) < 4 else max(R.slips(s), R.slips("x" * (len(s) + 2)))


def _hash(of: str, length: int, i: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{length}:{i}:{part}:{of}") - (1 << 63)


def segment_keys(s: str, of: str = "") -> set[int]:
    """The segments of an evaluation string; `of` is what must be equal besides."""
    return {_hash(of, len(s), i, s[at : at + size]) for i, (at, size) in enumerate(segments(len(s), edits_for(s)))}


def probe_keys(t: str, of: str = "") -> set[int]:
    """Segments that an evaluation string within its edits of t could have, at the positions where t would hold them.

    A swap of neighbours across the end of a segment is one edit and must not spoil two segments:
    a segment is therefore also probed with its last character as it was before such a swap.
    """
    out: set[int] = set()
    m = len(t)
    most = EDITS if " " in t else 2
    for length in range(max(0, m - most), m + most + 1):
        e = EDITS if " " in t else edits_for("x" * length)
        shift = m - length
        if abs(shift) > e:
            continue
        for i, (at, size) in enumerate(segments(length, e)):
            lo = max(0, at - i, at + shift - (e - i))
            hi = min(m - size, at + i, at + shift + (e - i))
            for p in range(lo, hi + 1):
                out.add(_hash(of, length, i, t[p : p + size]))
                if size and p + size < m and i < e:
                    out.add(_hash(of, length, i, t[p : p + size - 1] + t[p + size]))
    return out


def vocabulary(texts: DataFrame, share: float = VOCABULARY_SHARE) -> dict[str, bool]:
    """Words in at least `share` of all texts (and three), and whether they are names, over the whole collection.

    texts: (text_a, text_b).  Counted per batch first, then in one shuffle of words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            caps: Counter = Counter()
            trusty: Counter = Counter()
            n = 0
            for t in [*b["text_a"], *b["text_b"]]:
                if t is None:
                    continue
                n += 1
                found, trusted = R.tokens(t)
                seen.update({w for w, _ in found if w[0].isalpha()})
                if trusted:
                    trusty.update({w for w, _ in found})
                    caps.update({w for w, c in found if c})
            words = list(seen)
            yield pd.DataFrame({"w": ["", *words], "n": [n, *(seen[w] for w in words)], "caps": [0, *(caps[w] for w in words)], "trusty": [0, *(trusty[w] for w in words)]})

    counts = texts.select("text_a", "text_b").mapInPandas(count, "w string, n bigint, caps bigint, trusty bigint")
    total = counts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("caps").alias("caps"), F.sum("trusty").alias("trusty"))
    scratch = Scratch(texts.sparkSession, "vocabulary")
    kept = scratch.table(total)
    n = kept.where("w = ''").agg(F.sum("n")).first()[0] or 0
    rows = kept.where("w != ''").where(F.col("n") >= max(3, share * n)).collect()
    scratch.drop(kept)
    return {r["w"]: r["caps"] * 2 > r["trusty"] for r in rows}


def _links(records: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, train, fid) of the rows that take part, and (fe, ft), the pairs of forms that are the same record."""
    spark = records.sparkSession
    scratch = Scratch(spark, "overlaps")
    now = normal_split(records["split"])
    # ids travel as strings: a batch with a null would make floats of numbers
    rows = records.select(records[row_id].cast("string").alias("row_id"), "text_a", "text_b", F.when(now == "train", True).when(now.isin(*EVALUATION), False).alias("train"))
    rows = rows.where("row_id is not null and train is not null and text_a is not null and text_b is not null")
    known = spark.sparkContext.broadcast(vocabulary(rows))

    def canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = R.Vocabulary(known.value)
        for b in batches:
            out = []
            for i, train, ta, tb in zip(b["row_id"], b["train"], b["text_a"], b["text_b"], strict=True):
                x, y = sorted((R.side_form(ta, v), R.side_form(tb, v)))
                form = json.dumps([x, y], ensure_ascii=False, separators=(",", ":"))
                out.append((i, train, R.facts(x, y), R.key_strings(x, y, v), form, xxhash.xxh3_128_hexdigest(form)))
            yield pd.DataFrame(out, columns=["row_id", "train", "facts", "names", "form", "fid"])

    kind = dict(records.dtypes)[row_id]
    whole = rows.mapInPandas(canonical, "row_id string, train boolean, facts string, names array<string>, form string, fid string").withColumn("row_id", F.col("row_id").cast(kind))
    placed = scratch.table(whole.withColumn("facts_id", F.xxhash64("facts")))
    forms = placed.groupBy("fid", "train").agg(F.min("form").alias("form"), F.min("facts").alias("facts"), F.min("facts_id").alias("facts_id"), F.min("names").alias("names"))
    # forms whose figures, months and negations stand on the other side of the split as well
    both = forms.groupBy("facts_id").agg(F.min("train").alias("every"), F.max("train").alias("some")).where("some and not every").select("facts_id")
    forms = scratch.table(salted(forms, both, ["facts_id"], "fid"))
    keys = forms.select("train", "facts", F.explode("names").alias("name")).distinct()
    keys = scratch.table(keys.withColumn("kid", F.md5(F.concat_ws("\u0001", "facts", "name"))))

    def cut(f):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, names, hashes = [], [], []
                for i, s, of in zip(b["kid"], b["name"], b["facts"], strict=True):
                    h = f(s, of)
                    ids += [i] * len(h)
                    names += [s] * len(h)
                    hashes += h
                yield pd.DataFrame({"kid": ids, "name": names, "h": hashes})

        return run

    sides = keys.select("kid", "name", "facts", "train")
    parts = sides.where("not train").drop("train").mapInPandas(cut(segment_keys), "kid string, name string, h bigint")
    probes = sides.where("train").drop("train").mapInPandas(cut(probe_keys), "kid string, name string, h bigint")
    met = parts.select(F.col("kid").alias("ke"), F.col("name").alias("se"), "h").join(probes.select(F.col("kid").alias("kt"), F.col("name").alias("st"), "h"), "h")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[R.near(x, y, edits_for(x)) for x, y in zip(b["se"], b["st"], strict=True)], ["ke", "kt"]]

    close = met.mapInPandas(verify, "ke string, kt string").distinct()
    named = forms.select("fid", "train", F.explode("names").alias("name"), "facts").select("fid", "train", F.md5(F.concat_ws("\u0001", "facts", "name")).alias("k"))
    e = named.where("not train").select(F.col("k").alias("ke"), F.col("fid").alias("fe"))
    t = named.where("train").select(F.col("k").alias("kt"), F.col("fid").alias("ft"))
    pairs = close.join(e, "ke").join(t, "kt").select("fe", "ft").distinct()
    text = forms.select("fid", "form").distinct()
    texts = pairs.join(text.select(F.col("fid").alias("fe"), F.col("form").alias("xe")), "fe").join(text.select(F.col("fid").alias("ft"), F.col("form").alias("xt")), "ft")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[x == y or R.same_record(json.loads(x), json.loads(y)) for x, y in zip(b["xe"], b["xt"], strict=True)], ["fe", "ft"]]

    return placed.select("row_id", "train", "fid"), scratch.table(texts.mapInPandas(compare, "fe string, ft string"))


def overlaps(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row_eval, row_train of every pair of an evaluation row and a train row that are the same record.

    Rows with a null id, a null or another split, or null text_a or text_b take no part.  Exact copies
    and rows of one canonical form share one comparison.  A record without any name is held
    against others by all its words as one string, up to 3 edits away.  Empty tables give no rows.
    """
    placed, same = _links(records, row_id)
    e = placed.where("not train").select(F.col("fid").alias("fe"), F.col("row_id").alias("row_eval")).distinct()
    t = placed.where("train").select(F.col("fid").alias("ft"), F.col("row_id").alias("row_train")).distinct()
    return same.join(e, "fe").join(t, "ft").select("row_eval", "row_train")


def found(records: DataFrame) -> DataFrame:
    """row_id_a, row_id_b, the smaller first."""
    return overlaps(records).select(F.least("row_eval", "row_train").alias("row_id_a"), F.greatest("row_eval", "row_train").alias("row_id_b"))


def report(records: DataFrame) -> DataFrame:
    """split, source, n_rows, n_overlapping, n_pairs of every evaluation split and source (trimmed, lower case; null source kept).

    Pairs are counted by the sizes of the classes of equal form, never listed.
    """
    placed, same = _links(records, "row_id")
    size = placed.where("train").groupBy(F.col("fid").alias("ft")).agg(F.count("*").alias("m"))
    per_form = same.join(size, "ft").groupBy("fe").agg(F.sum("m").alias("n"))
    hits = salted(placed.where("not train").select("row_id", F.col("fid").alias("fe")), per_form, ["fe"], "row_id").select("row_id", "n")
    at = records.select("row_id", normal_split(records["split"]).alias("split"), F.lower(F.trim("source")).alias("source"))
    return (
        at.where(F.col("split").isin(*EVALUATION)).join(hits, "row_id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )
