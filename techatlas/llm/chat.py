"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as
``assistant`` and all others as named users; ``system`` turns stay what they are. Messages are

    <|im_start|>ROLE[ name=SPEAKER]\\nTEXT<|im_end|>\\n

and only the assistant's text with its end mark is trained on; the mask is given as a range of
characters of the rendered dialogue.

Messages are ordered by turn, then speaker, then checksum of the text. A conversation may hold any share of all
rows: messages are sorted in ranges, positions and offsets are summed within a range and then over the
ranges of a conversation, so no task sees more than one range of it, and the dialogue stays one row per
message. Repeated rows stay. A null text is empty, a null turn comes first, a null conv_id is a
conversation of its own; a null speaker is an unnamed user and, like the system, no participant. A conversation
without participants has no perspective and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from techatlas.session import materialize

SYSTEM = "system"
BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"


def rotate(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation, perspective and message.

    conv_id, perspective, position (0 …), role, name, rendered, start (characters before it), trained,
    mask_start and mask_length (the trained range; null and 0 where nothing is trained).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(speaker).cast("string").alias("speaker"),
        body.alias("text"),
        F.md5(body.cast("binary")).alias("check"),
    )
    order = ["conv_id", "turn", "speaker", "check"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    rows = materialize(rows.drop("check"), "messages")

    people = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM))
    people = people.select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, rows["conv_id"].eqNullSafe(people["conv"])).drop("conv")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(~own & (F.col("speaker") != SYSTEM), F.col("speaker"))
    seen = seen.withColumn("role", role).withColumn("name", name)
    head = F.concat(F.lit(BEGIN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit(FINISH)))
    seen = seen.withColumn("size", F.length("rendered").cast("long"))

    group = ["conv_id", "perspective"]
    sums = seen.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("conv"),
        F.col("perspective").alias("who"),
        F.col("part").alias("range"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s_before"),
    )
    within = Window.partitionBy(*group, "part").orderBy("line")
    seen = seen.withColumn("n", F.row_number().over(within) - 1).withColumn(
        "s", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    same = (
        seen["conv_id"].eqNullSafe(sums["conv"])
        & (seen["perspective"] == sums["who"])
        & (seen["part"] == sums["range"])
    )
    start = F.col("s") + F.col("s_before")
    trained = F.col("role") == "assistant"
    return seen.join(sums, same).select(
        "conv_id",
        "perspective",
        (F.col("n") + F.col("n_before")).cast("long").alias("position"),
        "role",
        "name",
        "rendered",
        start.cast("long").alias("start"),
        trained.alias("trained"),
        F.when(trained, start + F.col("head")).cast("long").alias("mask_start"),
        F.when(trained, F.length("text") + len(FINISH) - 1).otherwise(0).cast("long").alias("mask_length"),
    )
