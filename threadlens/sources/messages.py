"""Message sources.

``read_messages`` reads a stored messages table (parquet/json/csv) with the
canonical schema; ``messages_from_conversations`` and ``messages_from_events``
adapt the generated test tables into that schema, so every query's work grows
with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

MESSAGE_SCHEMA = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("item_class", T.IntegerType()),
    T.StructField("sender", T.StringType()),
    T.StructField("sender_address", T.StringType()),
    T.StructField("cc", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("received_time", T.TimestampNTZType()),
    T.StructField("attachment_count", T.IntegerType()),
])
MESSAGE_COLUMNS = [f.name for f in MESSAGE_SCHEMA.fields]


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", folder: str | None = None,
                  **options) -> DataFrame:
    """Scan a messages table with the canonical schema.

    Text formats keep malformed rows in ``_corrupt_record`` (PERMISSIVE) so that
    ``split_rejects`` can set them aside; ``folder`` restricts the scan to one
    folder (pushed to the source as a filter).
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA.fields])
    else:
        schema = T.StructType(MESSAGE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = spark.read.schema(schema).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", "_corrupt_record")
        for k, v in options.items():
            reader = reader.option(k, v)
        df = reader.format(fmt).load(path)
    if folder is not None:
        df = df.filter(F.col("folder") == F.lit(folder))
    return df


def write_message_tree(messages: DataFrame, path: str) -> str:
    """Messages as ``<path>/folder=<name>/``: the mailbox's folders as directories.  Rows are dealt by ranges
    of (folder, id), so a large folder is written by many tasks and a small one by one or two."""
    messages.select(*MESSAGE_COLUMNS).repartitionByRange("folder", "message_id").write.mode("overwrite") \
        .partitionBy("folder").parquet(path)
    return path


def read_message_tree(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """S2 source: every directory ``folder=<name>`` below ``path`` is a folder (names are text, whatever they look
    like; a message without a folder lies in Spark's default directory).  Excluded folders (F1: exact,
    case-sensitive) are a filter on the directories, so their files are not opened."""
    df = spark.read.schema(MESSAGE_SCHEMA).parquet(path).select(*MESSAGE_COLUMNS)
    if excluded:
        df = df.filter(F.col("folder").isNull() | ~F.col("folder").isin(*excluded))
    return df


def _conv_expr() -> list[Column]:
    """The conversations -> messages mapping (fixture adapter), column by column."""
    e = F.expr
    return [
        e("conv_id * 100 + turn").alias("message_id"),
        e("lpad(cast(conv_id AS string), 8, '0') || '-conv'").alias("conversation_id"),
        e("CASE WHEN (conv_id * 3 + turn) % 11 = 3 THEN 'Customs' "
          "WHEN (conv_id * 3 + turn) % 11 = 7 THEN NULL ELSE 'Inbox' END").alias("folder"),
        e(f"CASE WHEN role = 'system' THEN 53 ELSE {C.MAIL_ITEM_CLASS} END").cast("int").alias("item_class"),
        e("role || '-' || cast((turn * 3 + conv_id) % 5 AS string)").alias("sender"),
        e("role || '-' || cast((turn * 3 + conv_id) % 5 AS string) || '@example.com'").alias("sender_address"),
        e("CASE WHEN turn % 3 = 0 THEN 'ops@example.com' END").alias("cc"),
        e("CASE (turn + conv_id) % 5 WHEN 0 THEN '' WHEN 1 THEN 'RE: ' WHEN 2 THEN 'Fwd: ' "
          "WHEN 3 THEN 'Re: FW: ' ELSE 'FWD:RE: ' END "
          "|| CASE conv_id % 4 WHEN 0 THEN 'Load/Unload: week ' WHEN 1 THEN 'CARE: order \"A\" <' "
          "WHEN 2 THEN 'A very long subject line that keeps going past fifty characters ' ELSE 'Plan ' END "
          "|| cast(conv_id % 17 AS string)").alias("subject"),
        e("CASE (conv_id + turn) % 6 WHEN 0 THEN 'Dear all,' || chr(10) "
          "WHEN 1 THEN 'Hi team,' || chr(10) || chr(10) ELSE '' END "
          "|| CASE (conv_id * 7 + turn * 3) % 13 "
          "WHEN 0 THEN 'This is URGENT. Please confirm the pickup?' || chr(10) "
          "WHEN 1 THEN 'The truck is delayed at the border.' || chr(10) "
          "WHEN 2 THEN 'Documents are missing. We are waiting for customs clearance.' || chr(10) "
          "WHEN 3 THEN 'Agreed. The decision is approved.' || chr(10) "
          "WHEN 4 THEN 'Could you send the template' || chr(10) "
          "WHEN 5 THEN 'There is a problem with the deadline. Pending your reply' || chr(10) "
          "WHEN 6 THEN 'Issue confirmed.No solution yet.' || chr(10) ELSE '' END "
          "|| text "
          "|| CASE (conv_id + turn) % 3 WHEN 0 THEN chr(10) || '-----' || chr(10) "
          "|| 'Best regards,' || chr(10) || 'J.' ELSE '' END").alias("body"),
        e("TIMESTAMP_NTZ '2024-01-01 08:00:00' + INTERVAL '1' MINUTE * cast((conv_id % 100) * 1440 "
          "+ (CASE WHEN conv_id % 6 = 0 THEN turn - turn % 2 ELSE turn END) "
          "* (1 + conv_id % 9) * 295 AS int)").alias("received_time"),
        e("CASE WHEN (conv_id + turn) % 4 = 0 THEN 2 ELSE 0 END").cast("int").alias("attachment_count"),
    ]


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages adapted from the ``conversations`` table (one row per turn)."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*_conv_expr())


def messages_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with faults: some messages lack a time, an id, a sender or a conversation."""
    m = messages_from_conversations(spark, sf_dir)
    i = F.col("message_id")
    return m.withColumns({
        "message_id": F.when(i % 29 != 7, i), "received_time": F.when(i % 23 != 5, F.col("received_time")),
        "sender": F.when(i % 31 != 9, F.col("sender")), "conversation_id": F.when(i % 37 != 11, F.col("conversation_id"))})


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-volume messages from ``events``: conversation = user, sender = event type, body = props."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        F.col("event_id").alias("message_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("conversation_id"),
        F.lit("Inbox").alias("folder"),
        F.lit(C.MAIL_ITEM_CLASS).cast("int").alias("item_class"),
        F.col("event_type").alias("sender"),
        F.concat(F.col("event_type"), F.lit("@example.com")).alias("sender_address"),
        F.lit(None).cast("string").alias("cc"),
        F.concat(F.lit("Event "), F.col("event_type")).alias("subject"),
        F.col("props").alias("body"),
        F.col("ts").cast("timestamp_ntz").alias("received_time"),
        F.lit(0).cast("int").alias("attachment_count"),
    )


def messages_from_busy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as busy threads: some twenty senders who each write several times, and bodies in which every
    capped list has more items than its cap."""
    e = F.expr
    return messages_from_events(spark, sf_dir).withColumns({
        "sender": e("concat(sender, '-', message_id % 4)"),
        "body": e("concat('Could you check order ', message_id, '?\n', CASE sender WHEN 'error' THEN 'This is urgent. ' "
                  "WHEN 'purchase' THEN 'There is a delay. ' ELSE '' END, 'The decision on ', sender, ' is approved. "
                  "We have an issue with the ', sender, ' deadline.\nPlease confirm ', message_id, '\n', body)")})


def split_rejects(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a scan into good rows and rejects (F5): a row that cannot be placed in
    time order or was malformed is set aside with a reason; the scan goes on."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed")) \
        if "_corrupt_record" in messages.columns else F.lit(None).cast("string")
    reason = F.coalesce(reason, F.when(F.col("received_time").isNull(), F.lit("no received_time")),
                        F.when(F.col("message_id").isNull(), F.lit("no message_id")))
    tagged = messages.withColumn("reject_reason", reason)
    good = tagged.filter(F.col("reject_reason").isNull()).select(*MESSAGE_COLUMNS)
    bad = tagged.filter(F.col("reject_reason").isNotNull())
    return good, bad


def messages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long multi-line multilingual bodies from ``documents``: conversation = source,
    sender = language, one message per document, an hour apart by id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("message_id"),
        F.col("source").alias("conversation_id"),
        F.lit("Inbox").alias("folder"),
        F.lit(C.MAIL_ITEM_CLASS).cast("int").alias("item_class"),
        F.col("lang").alias("sender"),
        F.concat(F.col("lang"), F.lit("@example.com")).alias("sender_address"),
        F.lit(None).cast("string").alias("cc"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("subject"),
        F.col("text").alias("body"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * cast(doc_id AS int)").alias("received_time"),
        F.lit(0).cast("int").alias("attachment_count"),
    )
