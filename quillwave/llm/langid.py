"""Language identification of code-switched text: a conditional random field labels words by forward-backward.

Words are runs of letters.  Training takes windows of `WINDOW` words of a bounded sample of documents whose `lang`
is known; every second training sequence is spliced from two windows of different languages, which is what the
transitions are learned from.  A text's language is the one with the largest sum of word posteriors; the score is
its share of that sum.

Bounds: `DOCS_PER_LANG` documents a language and `WINDOWS_PER_DOC` windows of each, `WINDOWS` windows in all,
`LEXICON_SIZE` words in the lexicon.  All languages are learned; training time grows with the square of their number.  Prediction reads every whole text once.

Null texts and texts without letters are `und` with score 0.  Without any labelled document all texts are `und`.
Repeated rows give a row each; rows with a null id are predicted and count as not held out.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm import common, crf
from quillwave.llm import textkernel as tk

DOCS_PER_LANG = 500
WINDOW = 32
WINDOWS_PER_DOC = 3
#: Windows in all; with very many languages each has fewer, but `LEAST_WINDOWS` where it has as many.
WINDOWS, LEAST_WINDOWS = 20_000, 30
LEXICON_SIZE = 4096
LEXICON_MIN_COUNT = 8
NO_LANGUAGE = "und"


def _has_letter(text: str | None) -> bool:
    return any(ch.isalpha() for ch in text or "")


def _distinct(column: pa.Array):
    """Words of the texts: each one's distinct number, the first word of each text, and the distinct ones' bytes."""
    data, offsets = tk.text_bytes(column)
    low = crf.fold(data)
    starts, ends, rows = tk.word_bounds(low, offsets, crf.LETTERS)
    hashes = tk.span_hashes(low, starts, ends)
    known, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return low, starts[first], ends[first], known, number, np.searchsorted(rows, np.arange(len(offsets)))


def train(documents: DataFrame, seed: int = 11) -> crf.Crf | None:
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    # Windows are cut where the documents are; only they come here.
    rows = common.bounded_sample(usable.select("doc_id", "lang", "text"), "lang", "doc_id", DOCS_PER_LANG).select("doc_id", "lang", "text").mapInArrow(common.tidy(_windows), "doc_id long, lang string, words string").orderBy("doc_id", "words").collect()
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r.words)
    if not by_lang:
        return None
    labels = sorted(by_lang)
    most = max(LEAST_WINDOWS, WINDOWS // len(labels))
    texts = [(w, i) for i, lang in enumerate(labels) for w in by_lang[lang][:: -(-len(by_lang[lang]) // most)]]
    low, starts, ends, known, number, cut = _distinct(pa.array([t for t, _ in texts]))
    count = np.bincount(number, minlength=len(known))
    often = np.flatnonzero(count >= LEXICON_MIN_COUNT)
    lexicon = np.sort(known[often[np.argsort(-count[often], kind="stable")][:LEXICON_SIZE]])
    whole = [i for i in range(len(texts)) if cut[i + 1] - cut[i] == WINDOW]
    rng = np.random.default_rng(seed)
    sequences = []
    for turn, i in enumerate(whole):
        ids, gold = number[cut[i] : cut[i + 1]].copy(), np.full(WINDOW, texts[i][1])
        j = whole[int(rng.integers(len(whole)))]
        if turn % 2 and texts[j][1] != texts[i][1]:
            lo = int(rng.integers(4, WINDOW - 4))
            ids[lo:] = number[cut[j] : cut[j + 1]][lo:]
            gold[lo:] = texts[j][1]
        sequences.append((ids, gold))
    if not sequences:
        return None
    return crf.fit(sequences, *crf.word_features(low, starts, ends, known, lexicon), len(known), labels, lexicon)


def _windows(batches):
    """Up to WINDOWS_PER_DOC windows of WINDOW words, spread over the text; a shorter text is repeated to fill one."""
    for batch in batches:
        for first, upto in tk.slices(batch.column(2)):
            out = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.slice(first, upto - first).columns), strict=True):
                low = crf.fold(np.frombuffer(text.encode(), np.uint8))
                starts, ends, _ = tk.word_bounds(low, np.array([0, len(low)]), crf.LETTERS)
                n = len(starts)
                if not n:
                    continue
                for at in sorted({int(x) for x in np.linspace(0, max(0, n - WINDOW), WINDOWS_PER_DOC)}):
                    words = [low[starts[i % n] : ends[i % n]].tobytes().decode("utf-8", "replace") for i in range(at, at + WINDOW)]
                    out.append((doc, lang, " ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "lang", "words"])


def _predict(shared):
    def run(batches):
        model: crf.Crf = shared.value
        k = len(model.labels)
        # Each segment has a matrix of labels by labels.
        most = min(tk.SLICE_BYTES, tk.SLICE_BYTES * crf.FULL_SLICE_LABELS**2 // k**2)
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1), most):
                part = batch.slice(lo, hi - lo)
                low, starts, ends, known, number, cut = _distinct(part.column(1))
                scores = crf.emissions(model.weights, *crf.word_features(low, starts, ends, known, model.lexicon), len(known))
                p = crf.posteriors(scores[number], model.transitions, cut)
                sums = np.concatenate([np.zeros((1, k)), np.cumsum(p, axis=0)])
                total = sums[cut[1:]] - sums[cut[:-1]]
                words = np.diff(cut)
                best = total.argmax(axis=1)
                share = np.clip(total[np.arange(len(best)), best] / np.maximum(words, 1), 0, 1)
                mark = p.argmax(axis=1)
                turns = np.zeros(len(mark) + 1, np.int64)
                if len(mark):
                    row = np.repeat(np.arange(len(words)), words)
                    turns[1:] = np.cumsum(np.concatenate([[False], (mark[1:] != mark[:-1]) & (row[1:] == row[:-1])]))
                lang, score, mix = [], [], []
                texts = part.column(1).to_pylist()
                for i in range(len(words)):
                    sure = words[i] > 0 and _has_letter(texts[i])
                    lang.append(model.labels[best[i]] if sure else NO_LANGUAGE)
                    score.append(float(share[i]) if sure else 0.0)
                    mix.append(",".join(f"{model.labels[j]}:{total[i, j] / words[i]:.3f}" for j in np.argsort(-total[i], kind="stable") if total[i, j] >= 0.0005 * words[i]) if sure else "")
                n_turns = turns[cut[1:]] - turns[np.minimum(cut[:-1] + 1, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(words), pa.array(n_turns), pa.array(mix)], names=["doc_id", "lang_pred", "score", "n_words", "n_switches", "shares"])

    return run


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches and shares of every row of `documents`."""
    model = train(documents)
    held = common.held_out(F.col("doc_id")).alias("held_out")
    if model is None:
        return documents.select("doc_id", held, F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches"), F.lit("").alias("shares"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    found = documents.select("doc_id", "text").mapInArrow(common.tidy(_predict(shared)), "doc_id long, lang_pred string, score double, n_words long, n_switches long, shares string")
    return found.select("doc_id", held, "lang_pred", "score", "n_words", "n_switches", "shares")
