"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated up to ``cap`` times. An entry
of the queue has the virtual finish time *cumulative tokens of its source, this entry
included, divided by the target weight of the source*. Served by finish time, all queues
together keep the target proportions at every point; the mix ends where the total budget
is used up.

The running sums are never computed by one task per source. Documents are dealt by their
shuffle key into buckets of some thousand rows; a bucket's start is the sum of the
buckets before it. The cut at the budget is found the same way from a histogram of finish
times, and only the slice that holds the cut is put in exact order.

Rows with the same ``doc_id`` are told apart by an ordinal; those without an id count as one
such group and are numbered together, so a table should have ids in nearly all rows.

Defined cases: a null text has size 0, a null source is a source of its own that comes
last, a source without words gets target 0 and a document without words takes 0; rows
that repeat are documents of their own; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_or_empty
from tidemark.session import materialise

SEED = "mix"
WEIGHTS = (1, 2, 3)
CAP = 3

# Rows a bucket (or a slice of finish times) has on average.
BUCKET_ROWS = 4096

# Slices of finish times in a block.
BLOCK_SLICES = 4096

KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of the MD5 of seed and id; null ids count as an empty text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, shuffle key and the ordinal of the row among equal ids."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id", "source", n_words(text).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("h"),
        F.xxhash64(text).alias("body"),
    )
    return rows.withColumn("nth", F.row_number().over(same_id()))


def same_id():
    return Window.partitionBy("doc_id").orderBy("source", "size", "body")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``cap`` times its size.

    The excess of capped sources goes to the others by weight until none is above; each
    round is one aggregate over the table of sources, of which only totals come back.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.lit(list(weights)), (nth + 1).cast("int"))
    table = materialise(totals.select("source", "source_size", weight.alias("weight")), "sources")
    most = cap * F.col("source_size")
    level, budget = None, table.agg(F.sum("source_size")).head()[0] or 0
    while True:
        free = F.lit(True) if level is None else most > level * F.col("weight")
        fixed, shares = table.agg(
            F.sum(F.when(~free, most).otherwise(0)), F.sum(F.when(free, F.col("weight")).otherwise(0))
        ).head()
        now = (budget - fixed) / shares if shares else level
        if now == level or not budget:
            break
        level = now
    share = F.lit(float(level or 0)) * F.col("weight")
    target = F.least(most.cast("double"), share)
    return table.select("source", "source_size", target.alias("target"))


def queue(sizes: DataFrame, shares: DataFrame, n_rows: int, cap: int = CAP) -> DataFrame:
    """One row per document and repetition, with its virtual finish time."""
    n_buckets = max(1, -(-n_rows // BUCKET_ROWS))
    width = 2**KEY_BITS // n_buckets + 1
    dealt = sizes.withColumn("bucket", F.expr(f"h div {width}"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("start", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    )
    known = starts.join(shares.withColumnRenamed("source", "s2"), F.expr("s <=> s2")).drop("s2")
    within = (
        Window.partitionBy("source", "bucket")
        .orderBy("h", "doc_id", "nth")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = dealt.withColumn("upto", F.sum("size").over(within))
    placed = summed.join(known, F.expr("source <=> s AND bucket = b")).drop("s", "b")
    turns = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    finish = (F.col("turn") * F.col("source_size") + F.col("start") + F.col("upto")) / F.col("target")
    return placed.where("target > 0").withColumn("turn", turns).select(
        "doc_id", "nth", "source", "size", "h", "turn", finish.alias("finish")
    )


def _crossing(sums: DataFrame, by: str, budget: int, before: int):
    """First row of ``sums``, in order, whose running total passes the budget, and the total before it."""
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sums.withColumn("total", F.sum("n").over(upto) + F.lit(before))
    return totals.where(F.col("total") > budget).orderBy(by).limit(1).select(by, F.expr("total - n")).head()


def taken(entries: DataFrame, budget: int) -> DataFrame:
    """The entries, in order of finish time, that the budget covers."""
    n_slices = max(1, -(-entries.count() // BUCKET_ROWS))
    # Finish times reach at most cap / (least target per size); those beyond 2 share a slice.
    part = F.least(F.floor(F.col("finish") * n_slices), F.lit(2 * n_slices))
    dealt = entries.withColumn("part", part)
    sums = materialise(dealt.groupBy("part").agg(F.sum("size").alias("n")), "slices")
    block = F.floor(F.col("part") / BLOCK_SLICES).alias("block")
    cut = _crossing(sums.groupBy(block).agg(F.sum("n").alias("n")), "block", budget, 0)
    if cut is None:
        return dealt.drop("part")
    cut = _crossing(sums.where(block == cut[0]), "part", budget, cut[1])
    order = (
        Window.partitionBy("part")
        .orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "nth", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    edge = dealt.where(F.col("part") == cut[0]).withColumn("total", F.sum("size").over(order))
    inside = edge.where(F.col("total") <= budget - cut[1]).drop("total")
    return dealt.where(F.col("part") < cut[0]).unionByName(inside).drop("part")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all documents, targets of the sources, and the mix.

    The mix has a row for each time a document is taken (doc_id, nth, turn, finish, ...);
    ``mix.orderBy("finish", ...)`` is the order of service.
    """
    sizes = materialise(sized(docs, seed), "sizes")
    n_rows, budget = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    shares = targets(sizes, weights, cap)
    entries = materialise(queue(sizes, shares, n_rows, cap), "queue")
    return sizes, shares, taken(entries, budget)


def per_document(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: words of each document in the mix."""
    sizes, shares, chosen = mix(docs, weights, cap, seed)
    turns = chosen.groupBy("doc_id", "nth").agg(F.sum("size").alias("taken"))
    turns = turns.select(F.col("doc_id").alias("d"), F.col("nth").alias("n"), "taken")
    rows = sizes.join(turns, F.expr("doc_id <=> d AND nth = n"), "left")
    rows = rows.join(shares.withColumnRenamed("source", "s"), F.expr("source <=> s"))
    return rows.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as taken."""
    _, _, chosen = mix(docs, weights, cap, seed)
    times = chosen.groupBy(F.col("doc_id").alias("d"), F.col("nth").alias("n")).count()
    text = text_or_empty()
    rows = docs.select(
        F.struct("*").alias("_row"), "doc_id", "source", n_words(text).alias("size"), F.xxhash64(text).alias("body")
    ).withColumn("nth", F.row_number().over(same_id()))
    found = rows.join(times, F.expr("doc_id <=> d AND nth = n"))
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("_")).select("_row.*")
