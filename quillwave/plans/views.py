"""Feature sequences, templates, queries and signals derived from the tables that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.sources.actions import ACTIONS
from quillwave.sources.pcm import sounded_blocks

THRESHOLD = 0.192
SECONDS_PER_ACCEPT = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(vector: Column, n: Column | int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1), lambda i: F.slice(vector, i * width + 1, F.lit(width)))


def sequences(spark: SparkSession, sf_dir: str, shape: str = "fixed") -> DataFrame:
    """(vec_id, command_id, template_id, created_at, truth, condition, duration_ms, features, frame_count)."""
    v = F.col("embedding")
    features = {"fixed": lambda: frames(v, 8, 8), "ragged": lambda: frames(v, (5 + F.col("vec_id") % 4).cast("int"), 8), "wide": lambda: frames(v, 4, 16), "long": lambda: frames(v, 16, 4)}[shape]()
    command = F.concat(F.lit("c"), F.col("label").cast("string"))
    condition = F.element_at(F.array(*[F.lit(c) for c in ("NORMAL", "TIRED", "ILL", "OTHER")]), (F.floor(F.col("vec_id") / 10) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        command.alias("command_id"),
        F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("template_id"),
        F.col("vec_id").alias("created_at"),
        F.when(F.col("label") <= 7, command).alias("truth"),
        condition.alias("condition"),
        (400 + 10 * (F.col("vec_id") % 50)).alias("duration_ms"),
        "label",
        features.alias("features"),
    ).withColumn("frame_count", F.size("features"))


def queries(seq: DataFrame) -> DataFrame:
    return seq.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")


def templates(seq: DataFrame) -> DataFrame:
    return seq.where("vec_id % 10 <> 0 AND label <= 7")


def single_templates(seq: DataFrame) -> DataFrame:
    """The template of each command with the lowest id."""
    rows = templates(seq)
    return rows.join(rows.groupBy("command_id").agg(F.min("vec_id").alias("vec_id")), ["command_id", "vec_id"], "left_semi")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a, _ in ACTIONS]), (F.col("label") % len(ACTIONS) + 1).cast("int"))
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("command_id"), F.concat(F.lit("command "), F.col("label").cast("string")).alias("label"), action.alias("action"))


def small_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a signal of 64 samples at 1 kHz."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("samples"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.col("value").alias("level"))


def loop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings for the listening loop; a signup puts a template of its value, which goes at the device's next error."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), (F.col("event_id") * 50).alias("at"), F.col("value").cast("float").alias("v"), "event_type", "event_id")
    after = Window.partitionBy("device_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    puts = events.withColumn("gone", F.min(F.when(F.col("event_type") == "error", F.col("at"))).over(after)).where("event_type = 'signup'")
    nothing = {"samples": "array<float>", "change": "string", "template_id": "string", "command_id": "string", "created_at": "long", "features": "array<array<float>>"}
    row = lambda at, **told: ["device_id", at.alias("at"), at.alias("upto"), *[told.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in nothing.items()]]
    named = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    put = row(F.col("at"), change=F.lit("put"), template_id=named, command_id=F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")), created_at=F.col("event_id"), features=F.array(F.array("v")))
    return events.select(*row(F.col("at"), samples=F.array("v"))).union(puts.select(*put)).union(puts.where("gone IS NOT NULL").select(*row(F.col("gone"), change=F.lit("drop"), template_id=named)))


def long_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording a label: the vectors of the label in order, each a chunk of 64 samples at 1 kHz."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), (nth * 64).cast("long").alias("at"), F.col("embedding").cast("array<float>").alias("samples"))


TONE_MS, PAD_MS = 200, 100


def recordings(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """Each vector as a recording at 16 kHz: a sweep whose pitch follows the label and the vector's first two values.

    Labels over 7 are negatives; of the others every tenth vector is asked and the rest enrol.  `only` some kinds are made at all.
    """
    v = lambda i: F.col("embedding")[i].cast("double")
    seq, f0 = F.col("vec_id").cast("long"), 300.0 + 150.0 * F.col("label") + 100.0 * v(0)
    kind = F.when(F.col("label") > 7, "negative").when(F.col("vec_id") % 10 == 0, "positive").otherwise("enrol")
    truth = F.when(F.col("label") <= 7, F.concat(F.lit("c"), F.col("label").cast("string")))
    condition = F.when(F.col("vec_id") % 20 == 0, "TIRED").otherwise("NORMAL")
    specs = table(spark, sf_dir, "embeddings").select(seq.alias("seq"), kind.alias("kind"), truth.alias("truth"), condition.alias("condition"), f0.alias("f0"), (f0 + 400.0 * v(1)).alias("f1"), F.lit(0.3).alias("amp"), F.lit(0.0).alias("noise"))
    return sounded_blocks(specs.where(only).repartition(spark.sparkContext.defaultParallelism, "seq"), TONE_MS, PAD_MS)
