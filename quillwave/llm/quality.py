"""Quality: a compression classifier with zstandard dictionaries of good and of bad text.

Two dictionaries are trained on pieces of labelled texts.  A text is cut into pieces of `PIECE` characters, all of
them; each is compressed with either dictionary.  The piece sizes are summed, and the difference of the sums over
their total, positive where the good dictionary fits better, is calibrated by isotonic regression on labelled
texts that the dictionaries have not seen.  Cutting keeps a long text from drowning the dictionaries' effect.

Bounds: `SAMPLE_PER_CLASS` labelled rows a class, `PIECES_PER_CLASS` pieces of them in a dictionary's training.
Scoring reads every whole text once.  Null and empty texts have difference 0 and its calibrated score.  Rows with
a null id are scored and count as not held out; repeated rows give a row each.  Without labelled rows of both
classes every score is the smoothed share of good rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm import common
from quillwave.llm.toxicity import labelled_rows

SAMPLE_PER_CLASS = 4000
PIECES_PER_CLASS = 4000
PIECE = 1200
DICTIONARY_BYTES = 96 << 10
LEVEL = 3
THRESHOLD = 0.3


def _pieces(text: str) -> list[bytes]:
    return [text[at : at + PIECE].encode("utf-8", "surrogatepass") for at in range(0, len(text), PIECE)]


class Scales:
    """Both dictionaries, ready to compress."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for raw in (good, bad):
            ready = zstandard.ZstdCompressionDict(raw)
            ready.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: str | None) -> float:
        pieces = _pieces(text or "")
        good, bad = (sum(len(side(p)) for p in pieces) for side in self.sides)
        return (bad - good) / (bad + good) if pieces else 0.0


def with_difference(df: DataFrame, dictionaries: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    """`keep` columns and `difference double` of each whole text."""

    def run(batches):
        scales = Scales(*dictionaries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([scales.difference(t) for t in part.column(0).to_pylist()], pa.float64())], names=[*keep, "difference"])

    chosen = df.select(F.col("text").alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(common.tidy(run), f"{schema}, difference double")


def train_dictionary(rows: DataFrame) -> bytes:
    """A dictionary of a bounded sample of pieces of `rows.text`."""
    pieces = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE)), lambda i: F.substring("text", (i * PIECE + 1).cast("int"), F.lit(PIECE)))).alias("piece"))
    some = [r.piece.encode("utf-8", "surrogatepass") for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(PIECES_PER_CLASS).collect()]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, some)) // 8))
    try:
        return zstandard.train_dictionary(size, some, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few pieces to choose from: the text itself serves
        return b"".join(some)[:size]


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None
    calibration: object
    share: float

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` columns and `score double`."""
        if self.dictionaries is None:
            return df.select(*keep, F.lit(self.share).alias("score"))
        scored = self.calibration.transform(with_difference(df, self.dictionaries, keep))
        return scored.select(*keep, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    rows = common.stash(labelled_rows(documents, labels, label_col, per_class).where(F.length("text") > 0), "quality-sample")
    found = {(r.part, r.label): r.n for r in rows.groupBy((F.col("fold") >= 6).alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    good, total = sum(n for (_, label), n in found.items() if label == 1), sum(found.values())
    if any(found.get((part, label), 0) < 1 for part in (False, True) for label in (0, 1)):
        return Model(None, None, (good + 0.5) / (total + 1))
    dictionaries = tuple(train_dictionary(rows.where((F.col("fold") < 6) & (F.col("label") == label))) for label in (1, 0))
    # The sample has up to `per_class` rows of each class; weights bring back the classes' own shares.
    shares = {r.label: r.n for r in labels.where(F.col(label_col).isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, shares[1] / max(1, good)).otherwise(shares[0] / max(1, total - good))
    seen = with_difference(rows.where("fold >= 6"), dictionaries, ["label"]).withColumn("weight", weight).withColumn("label", F.col("label").cast("double"))
    return Model(dictionaries, IsotonicRegression(featuresCol="difference", labelCol="label", weightCol="weight").fit(common.stash(seen, "quality-differences")), 0.5)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `documents`."""
    scored = train(documents, labels).score(documents, ["doc_id"])
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
