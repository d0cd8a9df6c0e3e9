"""Logged conversations: snapshots that only begin a longer conversation are dropped, the rest is rendered.

Every turn carries the hash of all turns up to it (128 bits: exclusive-or of hashes of place, role and text). The hash
of a whole conversation that also ends a prefix of a longer one marks it as a snapshot. Equal conversations are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.session import scratch_path

TURN = "concat('<|', coalesce(role, ''), '|>\\n', coalesce(text, ''), '\\n<|end|>')"


def collapse_snapshots(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: n_turns, kept, kept_by (the conversation that holds it, else null), rendered (if kept).

    Turns are read by ``turn``, then role and text (nulls first). Of equal conversations the smallest id is kept and
    holds the others; a snapshot is held by the longest conversation that begins with it, of several by the smallest
    id. Null roles and texts are not equal to empty ones. Rows without an id are left out.
    """
    spark = turns.sparkSession
    source = turns.selectExpr(f"`{id}` AS id", f"`{turn}` AS turn", f"string(`{role}`) AS role", f"string(`{text}`) AS text").where("id IS NOT NULL")
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    placed = source.withColumn("place", F.row_number().over(order))
    marked = placed.selectExpr(
        "id", "place", "xxhash64(place, role IS NULL, role, text IS NULL, text) AS h1", "xxhash64('second', text, role, place, role IS NULL, text IS NULL) AS h2"
    )
    upto = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    path = scratch_path(spark, "prefixes")
    marked.select(
        "id", "place", F.expr("bit_xor(h1)").over(upto).alias("p1"), F.expr("bit_xor(h2)").over(upto).alias("p2"), F.count("*").over(Window.partitionBy("id")).alias("n")
    ).write.parquet(path)
    prefixes = spark.read.parquet(path)
    whole = prefixes.where("place = n").select("id", "n", "p1", "p2")
    first = whole.groupBy("n", "p1", "p2").agg(F.min("id").alias("first_id"))
    # the longest conversation beyond each prefix; equal prefixes meet in a map-side minimum
    longer = (
        prefixes.where("place < n")
        .groupBy(F.col("place").alias("n"), "p1", "p2")
        .agg(F.min(F.struct((-F.col("n")).alias("size"), "id")).alias("best"))
        .selectExpr("n", "p1", "p2", "best.id AS holder")
    )
    key = ["n", "p1", "p2"]
    judged = whole.join(first.join(longer, key, "left"), key).selectExpr(
        "id", "n AS n_turns", "holder IS NULL AND id = first_id AS kept", "coalesce(holder, CASE WHEN id <> first_id THEN first_id END) AS kept_by"
    )
    kept = judged.where("kept").select("id")
    rendered = (
        placed.join(kept, "id", "left_semi")
        .groupBy("id")
        .agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(place, {TURN} AS t))), x -> x.t), '\\n')").alias("rendered"))
    )
    return judged.join(rendered, "id", "left").withColumnRenamed("id", id)
