"""Problem 7: documents packed into containers of fixed capacity."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.llm.tokens import TOKENIZER, count_tokens

#: Open windows per partition and capacity, and items that one partition packs.
WINDOWS = 64
ITEMS_PER_PARTITION = 50_000


class BestFit:
    """Bounded-space best fit: at most `windows` open containers, the fullest emitted when none has room."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room, container), by room
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of this size (at most the capacity)."""
        i = bisect.bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, number = self.open.pop(i)
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)
            room, number = self.capacity, self.made
            self.made += 1
        if room > size or size == 0:
            bisect.insort(self.open, (room - size, number))
        return number


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the pieces of an item; only one longer than the capacity has several."""
    if size <= capacity:
        return [(0, size)]
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


def pack(
    documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, windows: int = WINDOWS, items: int = ITEMS_PER_PARTITION,
) -> DataFrame:
    """capacity_id, capacity_tokens, container, doc_id, piece, first_token, n_tokens: every document in every capacity.

    Documents are spread by the hash of their id over partitions of about `items` documents and
    packed there as a stream; what is open at the end of a partition is emitted as leftovers,
    at most `windows` per partition and capacity, which are packed together best-fit, fullest
    first, in streams of the same size until one stream holds what is left.  Only a document longer than the capacity is cut, into full containers and a rest.
    Null and empty texts have no tokens and lie in some container without taking room.  A null or
    non-positive capacity packs nothing.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    sizes = scratch.table(count_tokens(documents, "doc_id", tokenizer=tokenizer))
    caps = sorted((r["capacity_id"], r["capacity_tokens"]) for r in capacities.select("capacity_id", "capacity_tokens").distinct().collect() if r["capacity_id"] is not None and (r["capacity_tokens"] or 0) > 0)
    n = sizes.count()
    parts = max(1, min(n, -(-n // items)))
    kind = dict(sizes.dtypes)["doc_id"]
    slot = F.pmod(F.xxhash64(F.lit("pack"), "doc_id"), F.lit(parts)).cast("int")
    # one partition number per group of rows: the number, not Spark's partition, names the containers
    spread = sizes.withColumn("part", slot).repartition(parts, "part").sortWithinPartitions("part", F.xxhash64("doc_id"), "doc_id")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, {}

        def leftovers() -> list[tuple]:
            return [(c, f"{part}-{number}", None, None, None, cap - room) for (c, cap), fit in state.items() for room, number in fit.open]

        for b in batches:
            out: list[tuple] = []
            for p, i, size in zip(b["part"], b["doc_id"], b["n_tokens"], strict=True):
                if p != part:
                    if part is not None:
                        out += leftovers()
                    part, state = p, {x: BestFit(x[1], windows) for x in caps}
                for (c, cap), fit in state.items():
                    for k, (first, tokens) in enumerate(pieces(int(size), cap)):
                        out.append((c, f"{part}-{fit.place(tokens)}", i, k, first, tokens))
            yield pd.DataFrame(out, columns=columns)
        if part is not None:
            yield pd.DataFrame(leftovers(), columns=columns)

    columns = ["capacity_id", "container", "doc_id", "piece", "first_token", "n_tokens"]
    # ids travel as strings: a batch with a null would make floats of numbers
    streamed = spread.select("part", F.col("doc_id").cast("string").alias("doc_id"), "n_tokens").mapInPandas(stream, "capacity_id int, container string, doc_id string, piece int, first_token bigint, n_tokens bigint")
    placed = scratch.table(streamed.withColumn("doc_id", F.col("doc_id").cast(kind)))

    merged = _merge_leftovers(placed.where("piece is null").select("capacity_id", "container", "n_tokens"), dict(caps), windows, items, scratch)
    out = placed.where("piece is not null").join(merged, ["capacity_id", "container"], "left")
    return out.join(F.broadcast(capacities.select(F.col("capacity_id").cast("int").alias("capacity_id"), "capacity_tokens").distinct()), "capacity_id").select(
        "capacity_id", "capacity_tokens", F.coalesce("merged", "container").alias("container"), "doc_id", "piece", "first_token", "n_tokens"
    )


def _merge_leftovers(left: DataFrame, size_of: dict[int, int], windows: int, items: int, scratch: Scratch) -> DataFrame:
    """capacity_id, container, merged: the open containers of all partitions, packed into one another.

    They are packed like items, the fullest first, in streams of about `items` rows with `windows`
    open containers; what these leave open goes into another round.  A round leaves at most
    `windows` rows of each `items`, and the round that fits into one stream is the last.
    """
    columns = ["capacity_id", "container", "merged", "n_tokens"]
    name: DataFrame | None = None
    left = scratch.table(left)
    level = 0
    while True:
        n = left.count()
        parts = max(1, -(-n // items))
        last = parts == 1
        slot = F.pmod(F.xxhash64(F.lit("merge"), "capacity_id", "container"), F.lit(parts)).cast("int")
        spread = left.withColumn("part", slot).repartition(parts, "part").sortWithinPartitions("part", "capacity_id", F.desc("n_tokens"), "container")

        def stream(batches: Iterator[pd.DataFrame], level: int = level, last: bool = last) -> Iterator[pd.DataFrame]:
            at, fit = None, None

            def opened() -> list[tuple]:
                return [(at[1], None, f"m{level}-{at[0]}-{number}", size_of[at[1]] - room) for room, number in fit.open]

            for b in batches:
                out: list[tuple] = []
                for p, c, container, used in zip(b["part"], b["capacity_id"], b["container"], b["n_tokens"], strict=True):
                    if (p, c) != at:
                        if at is not None and not last:
                            out += opened()
                        # in the last round nothing is emitted early: there are at most `items` rows
                        at, fit = (p, c), BestFit(size_of[c], items + 1 if last else windows)
                    out.append((c, container, f"m{level}-{p}-{fit.place(int(used))}", None))
                yield pd.DataFrame(out, columns=columns)
            if at is not None and not last:
                yield pd.DataFrame(opened(), columns=columns)

        step = scratch.table(spread.select("part", "capacity_id", "container", "n_tokens").mapInPandas(stream, "capacity_id int, container string, merged string, n_tokens bigint"))
        into = step.where("container is not null").select("capacity_id", "container", "merged")
        if name is None:
            name = into
        else:
            next_ = into.select("capacity_id", F.col("container").alias("merged"), F.col("merged").alias("into"))
            name = name.join(next_, ["capacity_id", "merged"], "left").select("capacity_id", "container", F.coalesce("into", "merged").alias("merged"))
        if last:
            return name
        left = step.where("container is null").select("capacity_id", F.col("merged").alias("container"), "n_tokens")
        level += 1


def report(packed: DataFrame) -> DataFrame:
    """capacity_id, capacity_tokens, n_documents, n_containers, n_tokens, filled (share of all room in use), n_cut (documents cut)."""
    per = packed.groupBy("capacity_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    room = per.groupBy("capacity_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    docs = packed.groupBy("capacity_id").agg(F.count_if(F.col("piece") == 0).alias("n_documents"), F.count_if(F.col("piece") == 1).alias("n_cut"))
    return room.join(docs, "capacity_id").select(
        "capacity_id", "capacity_tokens", "n_documents", "n_containers", "n_tokens", "fullest",
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"), "n_cut",
    )
