"""Problem 8: documents of several sources combined to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.llm.tokens import TOKENIZER, count_tokens

#: Rows that one bucket of the prefix sums holds about, and buckets whose sums are accumulated in one task at most; beyond both, buckets grow.
BUCKET_ROWS, MOST_SLICES = 20_000, 1_000_000


def source_key(col: Column) -> Column:
    """The letters and digits of a source name in lower case; null where there are none."""
    key = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")
    return F.when(key == "", None).otherwise(key)


def _running(rows: DataFrame, scratch: Scratch, by: list[str], bucket: str, order: list, size: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `size` up to and with each row in (bucket, order), per `by`.

    Buckets are summed first and their sums, of which there are few, are accumulated; within a
    bucket a window does the rest, so no key is sorted in one task.
    """
    rows = scratch.table(rows)
    sums = rows.groupBy(*by, bucket).agg(F.sum(size).alias("_s"))
    keys = Window.partitionBy(*by).orderBy(bucket) if by else Window.partitionBy(F.lit(0)).orderBy(bucket)
    before = sums.withColumn("_before", F.sum("_s").over(keys) - F.col("_s")).drop("_s")
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, [*by, bucket]).withColumn(name, F.col("_before") + F.sum(size).over(inner)).drop("_before")


def fluid_limit(cap: dict[str, int], weight: dict[str, float], budget: float) -> float:
    """The virtual time at which sources that each flow at their weight until they run dry have given `budget` together."""
    dry = sorted((cap[s] / weight[s], s) for s in cap if weight[s] > 0 and cap[s] > 0)
    rate, given, at = sum(weight[s] for _, s in dry), 0.0, 0.0
    for end, s in dry:
        if rate <= 1e-15 or given + rate * (end - at) >= budget:
            break
        given += rate * (end - at)
        at = end
        rate -= weight[s]
    return at + (budget - given) / rate if rate > 1e-12 and given < budget else at


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, repeat_no, n_tokens, finish, mixed_tokens: the documents of the mixture in its order.

    Every source is shuffled by hash, its documents repeated as whole passes up to max_repeats.  A
    document's virtual finish time is the number of tokens of its source up to and with it,
    divided by the source's target share; all are ordered by it, and the order is cut where the
    running total `mixed_tokens` passes the budget (default: the tokens of all documents of
    target sources once).  A source that runs dry leaves its room to the others.  Documents of
    null or other sources, and sources with null or non-positive share or max_repeats, take no
    part; documents without tokens come along at no cost.  Source names are compared by letters.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    goals = targets.withColumn("key", source_key(F.col("source"))).where("key is not null and target_share > 0 and max_repeats > 0")
    goals = goals.groupBy("key").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"), F.min("source").alias("name"))
    plain = documents.select("doc_id", "text", source_key(F.col("source")).alias("key")).where("key is not null")
    wanted = plain.join(F.broadcast(goals.select("key")), "key", "left_semi")
    sized = scratch.table(count_tokens(wanted, "doc_id", "key", tokenizer=tokenizer))
    stats = {r["key"]: r for r in sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.max("n_tokens").alias("longest")).collect()}
    goal = {r["key"]: r for r in goals.collect()}
    whole = sum(g["share"] for g in goal.values()) or 1.0
    share = {k: goal[k]["share"] / whole for k in stats}
    tokens = sum(r["tokens"] for r in stats.values())
    budget = tokens if budget is None else budget
    cap = {k: stats[k]["tokens"] * goal[k]["repeats"] for k in stats}
    last = fluid_limit(cap, share, budget)
    # beyond the fluid limit only the longest document of each source can still come in before the cut
    slack = max((stats[k]["longest"] / share[k] for k in stats), default=0.0)
    plan = [(k, goal[k]["name"], share[k], int(goal[k]["repeats"]), int(stats[k]["tokens"]), max(1, stats[k]["n"] // bucket_rows), int(min(goal[k]["repeats"], -(-((last + slack) * share[k] + 1) // max(1, stats[k]["tokens"]))))) for k in sorted(stats)]
    rates = F.broadcast(spark.createDataFrame(plan, "key string, name string, share double, repeats int, total bigint, buckets int, passes int"))
    rows = sized.join(rates, "key").withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("passes"))))).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "pass"))
    spot = F.pmod(F.shiftright("h", 20), F.col("buckets"))
    rows = rows.withColumn("bucket", F.col("pass").cast("long") * F.col("buckets") + spot)
    rows = _running(rows, scratch, ["key"], "bucket", ["h", "doc_id"], "n_tokens", "used").withColumn("finish", F.col("used") / F.col("share"))
    rows = rows.where(F.col("finish") <= last + slack)
    n = sum(r["n"] * goal[k]["repeats"] for k, r in stats.items())
    wide = max(1.0, last + slack)
    grain = max(1, min(MOST_SLICES, n // bucket_rows))
    rows = rows.withColumn("slice", F.floor(F.col("finish") / F.lit(wide) * F.lit(grain)).cast("long"))
    rows = rows.select("doc_id", "key", "name", F.col("pass").alias("repeat_no"), "n_tokens", "finish", "slice")
    done = _running(rows, scratch, [], "slice", ["finish", "key", "repeat_no", "doc_id"], "n_tokens", "mixed_tokens").where(F.col("mixed_tokens") <= budget)
    return done.select("doc_id", F.col("name").alias("source"), "repeat_no", "n_tokens", "finish", "mixed_tokens")


def shares(mixed: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """source, target_share, reached_share, n_tokens, n_rows, n_documents, most_repeats for every target source, also those without documents."""
    got = mixed.groupBy(source_key(F.col("source")).alias("key")).agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_documents"), F.max("repeat_no").alias("most_repeats")
    )
    total = mixed.agg(F.sum("n_tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    goal = targets.withColumn("key", source_key(F.col("source"))).withColumn("one", F.lit(1))
    return (
        goal.join(got, "key", "left").join(F.broadcast(total), "one", "left")
        .select(
            "source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
