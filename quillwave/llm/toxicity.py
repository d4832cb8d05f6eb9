"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Three steps, each a Spark job:

1. A lexicon of words and of word beginnings is learned from one fold of labelled rows: counts of documents a
   (hashed) word are summed by Spark, and those far more frequent in toxic documents are kept.
2. Dense features of whole texts are computed in Arrow batches: lexicon densities (plain, by beginning and
   after undoing digit and symbol disguises), proximity of lexicon words to second-person words, capitals,
   punctuation and obfuscation rates.  Boosted trees (Spark ML) are fitted on a second fold.
3. Isotonic regression on a third fold turns the trees' probability into the score.

Trees and calibration weigh each sampled row by the labelled rows of its class that it stands for, so a score means
the same on tables of any size.

Bounds: `SAMPLE_PER_CLASS` labelled rows a class train the model; `LEXICON_SIZE` entries form the lexicon. Scoring
reads every whole text once.  Null and empty texts have all-zero features and get a score like any other; rows
with a null id are scored and count as not held out; repeated ids give a row each.  Without labelled rows of both
classes every score is the smoothed share of toxic rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import common
from quillwave.llm import textkernel as tk

SAMPLE_PER_CLASS = 6000
LEXICON_SIZE = 4096
LEXICON_MIN_DOCS = 3
LEXICON_MIN_RATIO = 12.0
THRESHOLD = 0.5
PREFIX_BYTES = (4, 5, 6)
NEAR_WORDS = 4
TREES, DEPTH = 24, 4
#: The share of the second fold that the trees are fitted on; the rest calibrates them.
TRAINED = 0.6

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
#: Characters that stand for letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LEET = np.arange(256, dtype=np.uint8)
for _shown, _meant in LOOKALIKES.items():
    _LEET[ord(_shown)] = ord(_meant)
_LEET_WORD = tk.ALNUM.copy()
_LEET_WORD[[ord("@"), ord("$")]] = True
_SYMBOL = tk.byte_class(b"@$*#%&!._-^~+=|")
_LETTER = tk.byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])

FEATURES = ["log_words", "lexicon_density", "log_lexicon", "prefix_density", "log_prefix", "disguised_density", "log_disguised", "near_second_person", "second_person_density", "capital_rate", "punctuation_rate", "exclamation_rate", "symbol_rate", "digit_rate", "obfuscated_rate", "mean_word_bytes"]


@dataclass(frozen=True)
class Lexicon:
    """Sorted 64-bit hashes of words, and of word beginnings by length in bytes."""

    words: np.ndarray
    prefixes: dict[int, np.ndarray]


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte Latin-1 capitals."""
    low = tk.lower(data)
    if len(low) > 1:
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def _isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _sorted_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(tk.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_YOU = _sorted_hashes(SECOND_PERSON)


def _prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than `size` bytes, and the hash of each one's first `size` bytes."""
    longer = np.flatnonzero(ends - starts > size)
    return longer, tk.span_hashes(data, starts[longer], starts[longer] + size)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features for each text."""
    n = len(offsets) - 1
    low = _fold(data)
    starts, ends, rows = tk.word_bounds(low, offsets, tk.ALNUM)
    hashes = tk.span_hashes(low, starts, ends)
    words = np.bincount(rows, minlength=n).astype(float)
    size = np.diff(offsets).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)

    def rowsum(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    hit = _isin(hashes, lexicon.words)
    begins = np.zeros(len(hashes), dtype=bool)
    for k, known in lexicon.prefixes.items():
        if len(known):
            longer, first = _prefix_hashes(low, starts, ends, k)
            begins[longer] |= _isin(first, known)
    leet = _LEET[low]
    l_starts, l_ends, l_rows = tk.word_bounds(low, offsets, _LEET_WORD)
    changed = leet != low
    if changed.any():
        seen = np.concatenate([[0], np.cumsum(changed)])
        some = seen[l_ends] > seen[l_starts]
        l_starts, l_ends, l_rows = l_starts[some], l_ends[some], l_rows[some]
        disguised = _isin(tk.span_hashes(leet, l_starts, l_ends), lexicon.words)
    else:
        l_rows, disguised = l_rows[:0], np.zeros(0, bool)
    you = _isin(hashes, _YOU)
    any_hit = hit | begins
    near = np.zeros(len(hashes), dtype=bool)
    for k in range(1, NEAR_WORDS + 1):
        if len(hashes) > k:
            same = rows[k:] == rows[:-k]
            near[k:] |= any_hit[k:] & you[:-k] & same
            near[:-k] |= any_hit[:-k] & you[k:] & same
    symbol = _SYMBOL[data]
    inner = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        inner[1:-1] = (symbol[1:-1] | ((data[1:-1] >= 0x30) & (data[1:-1] <= 0x39))) & _LETTER[low[:-2]] & _LETTER[low[2:]]
        some = offsets[1:] > offsets[:-1]
        inner[offsets[:-1][some]] = inner[offsets[1:][some] - 1] = False  # its neighbour is another text's
    capital = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    mark = tk.byte_class(b"!?.,;:")[data]
    n_hit = np.bincount(rows[hit], minlength=n).astype(float)
    n_begin = np.bincount(rows[begins], minlength=n).astype(float)
    n_dis = np.bincount(l_rows[disguised], minlength=n).astype(float)
    out = np.stack([
        np.log1p(words), n_hit / per_word, np.log1p(n_hit), n_begin / per_word, np.log1p(n_begin), n_dis / per_word, np.log1p(n_dis),
        np.bincount(rows[near], minlength=n) / per_word, np.bincount(rows[you], minlength=n) / per_word,
        rowsum(capital) / per_byte, rowsum(mark) / per_byte, rowsum(data == 0x21) / per_byte, rowsum(symbol) / per_byte, rowsum(digit) / per_byte,
        rowsum(inner) / per_word, (np.bincount(rows, weights=ends - starts, minlength=n) / per_word),
    ], axis=1)
    return out


def _count_words(batches):
    """(kind, hash, toxic documents, other documents) for each batch of (text, label)."""
    for batch in batches:
        for lo, hi in tk.slices(batch.column(0)):
            data, offsets = tk.text_bytes(batch.column(0).slice(lo, hi - lo))
            label = np.asarray(batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = _fold(data)
            starts, ends, rows = tk.word_bounds(low, offsets, tk.ALNUM)
            for kind in (0, *PREFIX_BYTES):
                if kind:
                    at, h = _prefix_hashes(low, starts, ends, kind)
                    r = rows[at]
                else:
                    h, r = tk.span_hashes(low, starts, ends), rows
                h, r = _distinct(h, r)
                known, place = np.unique(h, return_inverse=True)
                toxic = np.bincount(place, weights=label[r], minlength=len(known)).astype(np.int64)
                total = np.bincount(place, minlength=len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), kind, np.int32)), pa.array(known.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], names=["kind", "hash", "n_toxic", "n_other"])


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if not len(h):
        return h, r
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    return h[first], r[first]


def learn_lexicon(labelled: DataFrame, size: int = LEXICON_SIZE) -> Lexicon:
    """`labelled`: (text, label). Keeps at most `size` words and word beginnings by smoothed ratio of document rates."""
    n_toxic, n_all = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    counted = labelled.select("text", F.col("label").cast("long")).mapInArrow(common.tidy(_count_words), "kind int, hash long, n_toxic long, n_other long").groupBy("kind", "hash").agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o"))
    ratio = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("o") + 0.5) / (n_all - n_toxic + 1))
    top = counted.where((F.col("t") >= LEXICON_MIN_DOCS) & (ratio >= LEXICON_MIN_RATIO)).orderBy(F.desc(F.col("t") * F.log(ratio)), "kind", "hash").limit(size).collect()
    pick = lambda kind: np.sort(np.array([r.hash for r in top if r.kind == kind], dtype=np.int64).view(np.uint64))
    return Lexicon(pick(0), {k: pick(k) for k in PREFIX_BYTES})


def with_features(df: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns and `features array<double>` of each whole text."""

    def run(batches):
        for batch in batches:
            for lo, hi in tk.slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                dense = features(*tk.text_bytes(part.column(0)), lexicon)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, dense.shape[1], dtype=np.int32)), pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], flat], names=[*keep, "features"])

    chosen = df.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(common.tidy(run), f"{schema}, features array<double>")


def labelled_rows(documents: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> DataFrame:
    """(text, label, weight, fold) of a bounded sample of labelled rows that aren't held out; fold is 0 to 9.

    The weights of a class sum to about the number of its labelled rows.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    ids = common.bounded_sample(usable, "label", "doc_id", per_class, weight="weight")
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label", "weight", F.pmod(common.id_hash(F.col("doc_id"), 5), F.lit(10)).alias("fold"))


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: object
    calibration: object
    share: float

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` columns and `score double`."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias("score"))
        dense = with_features(df, self.lexicon, keep).withColumn("features", array_to_vector("features"))
        raw = self.trees.transform(dense).select(*keep, vector_to_array("probability")[1].alias("raw"))
        return self.calibration.transform(raw).select(*keep, _unit(F.col("prediction")).alias("score"))


def _unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def train(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    rows = common.stash(labelled_rows(documents, labels, label_col, per_class), "toxicity-sample")
    found = {(r.part, r.label): r for r in rows.groupBy((F.col("fold") >= 5).alias("part"), "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    toxic, total = sum(r.weight for r in found.values() if r.label == 1), sum(r.weight for r in found.values())
    share = (toxic + 0.5) / (total + 1)
    if any((part, label) not in found or found[part, label].n < 2 for part in (False, True) for label in (0, 1)):
        return Model(None, None, None, share)
    lexicon = learn_lexicon(rows.where("fold < 5").select("text", "label"))
    second = common.stash(with_features(rows.where("fold >= 5"), lexicon, ["label", "weight", "fold"]), "toxicity-features").withColumnRenamed("features", "dense")
    # Of each class the last two fifths in a fixed order are for calibration; it has two rows at least, so both parts have one.
    nth = F.percent_rank().over(Window.partitionBy("label").orderBy("fold", F.xxhash64("dense")))
    second = common.stash(second.withColumn("nth", nth), "toxicity-parts").withColumn("features", array_to_vector("dense"))
    ends = second.where(f"nth < {TRAINED}"), second.where(f"nth >= {TRAINED}")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(ends[0])
    raw = trees.transform(ends[1]).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"), "weight")
    return Model(lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw), share)


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, whose text isn't rejected, null ids like others; texts stay where they are, their hashes are scored."""
    keyed = documents.select("doc_id", "text", common.text_key(F.col("text")).alias(common.TEXT_KEY))
    scored = train(documents, labels).score(keyed, ["doc_id", common.TEXT_KEY])
    return common.without(documents, common.stash(scored.where(F.col("score") >= THRESHOLD).drop("score"), "toxic"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `documents`."""
    model = train(documents, labels)
    return model.score(documents, ["doc_id"]).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
