"""Problem 4: sentences of prose blocks, by a linear-chain model trained on claims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm import chain

PROSE = ("paragraph", "bullet_item", "ordered_item", "block_quote")
#: Claims, each a single sentence, that the model is trained on at most.
TRAINING_CLAIMS = 6000
#: Longer claims, which are rarely one sentence, do not train the model.
LONGEST_CLAIM = 400


def train_model(claims: DataFrame, most: int = TRAINING_CLAIMS) -> dict[str, float]:
    """Weights from at most `most` distinct claim texts, taken by the order of their hash; without claims an empty model.

    An empty model ends sentences nowhere inside a block.
    """
    rows = claims.where(f"text is not null and trim(text) != '' and length(text) <= {LONGEST_CLAIM}").select("text", F.xxhash64("text").alias("h"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    # the hash range is cut first, so that what all tasks send stays near `most` rows however many tasks there are
    share = min(1.0, 1.3 * most / max(1, n))
    some = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(share * 1_000_003)).distinct()
    texts = [r["text"] for r in some.orderBy("h", "text").limit(most).collect()]
    return chain.train(texts) if texts else {}


def split_sentences(events: DataFrame, claims: DataFrame) -> DataFrame:
    """event_id, sent_no, sent_start, sent_end, sentence of every distinct event of a prose block type.

    Offsets are code points of the event's text, end exclusive, without outer blanks.  Repeated
    rows count once; null and blank texts have no sentences; other block types are left out.
    """
    weights = events.sparkSession.sparkContext.broadcast(train_model(claims))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = chain.Decoder(weights.value)
        for b in batches:
            out = [(i, k, s, e, t[s:e]) for i, t in zip(b["event_id"], b["text"], strict=True) for k, (s, e) in enumerate(decode(t))]
            yield pd.DataFrame(out, columns=["event_id", "sent_no", "sent_start", "sent_end", "sentence"])

    prose = events.where(F.col("block_type").isin(*PROSE) & F.col("text").isNotNull()).select("event_id", "text").dropDuplicates(["event_id", "text"])
    # ids travel as strings: a batch with a null would make floats of numbers
    found = prose.withColumn("event_id", F.col("event_id").cast("string")).mapInPandas(run, "event_id string, sent_no int, sent_start int, sent_end int, sentence string")
    return found.withColumn("event_id", F.col("event_id").cast(dict(events.dtypes)["event_id"]))


def document_sentences(events: DataFrame, claims: DataFrame) -> DataFrame:
    """The sentences with doc_id and doc_start, the place in documents.text of a sentence's first character.

    The block spans char_start to char_end with its marker in front, so the text begins
    (char_end - char_start) - length(trimmed text) characters after char_start.  Null offsets give null.
    """
    at = (
        events.where(F.col("text").isNotNull()).groupBy("event_id", "doc_id", "text").agg(F.max("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
        .withColumn("lead", F.length(F.regexp_extract("text", r"(?U)^\s*", 0)))
        .withColumn("size", F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")))
        .select("event_id", "doc_id", "lead", (F.col("char_start") + F.greatest(F.lit(0), F.col("char_end") - F.col("char_start") - F.col("size"))).alias("base"))
    )
    return split_sentences(events, claims).join(at, "event_id").select(
        "doc_id", "event_id", "sent_no", "sent_start", "sent_end", (F.col("base") + F.col("sent_start") - F.col("lead")).cast("int").alias("doc_start"), "sentence"
    )
