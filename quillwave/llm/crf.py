"""A linear-chain conditional random field over words, in numpy, for use inside tasks.

Emissions of a word are sums of hashed feature weights: its byte n-grams with edge marks, its beginnings and ends
of four bytes, and the word itself where the lexicon has it.  Inference is exact forward-backward.  Long texts are
cut into segments of `SEGMENT` words; products of each segment's transfer matrices carry the chain over segments,
so all segments of a slice advance together, and a text of any length costs memory in proportion only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillwave.llm import textkernel as tk

TABLE_BITS = 16
SEGMENT = 64
#: Up to so many labels slices of texts have their full size.
FULL_SLICE_LABELS = 32
#: Training works on so many posteriors at a time.
FIT_CELLS = 1 << 22
_U = np.uint64
LETTERS = tk.byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # 2^TABLE_BITS x labels
    transitions: np.ndarray  # labels x labels, log potentials
    lexicon: np.ndarray  # sorted word hashes


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte Latin-1 capitals."""
    low = tk.lower(data)
    if len(low) > 1:
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the word each belongs to."""
    n = len(starts)
    size = ends - starts
    # Words one after another, each between two edge marks.
    begin = np.cumsum(size + 2) - (size + 2)
    owner = np.repeat(np.arange(n), size + 2)
    inside = np.arange(len(owner)) - begin[owner]
    edge = (inside == 0) | (inside == size[owner] + 1)
    text = np.full(len(owner), 1, dtype=np.uint64)
    text[~edge] = data[starts[owner[~edge]] + inside[~edge] - 1]
    numbers, words = [], []
    for k in (1, 2, 3, 4):
        if len(text) < k:
            continue
        gram = np.zeros(len(text) - k + 1, dtype=np.uint64)
        for i in range(k):
            gram = gram * _U(257) + text[i : len(text) - k + 1 + i]
        same = owner[: len(gram)] == owner[k - 1 :]
        if k == 4:  # beginnings and ends only
            same &= edge[: len(gram)] | edge[k - 1 :]
        numbers.append(gram[same] * _U(8) + _U(k))
        words.append(owner[: len(gram)][same])
    if len(lexicon) and n:
        at = np.searchsorted(lexicon, hashes)
        at[at == len(lexicon)] = 0
        known = np.flatnonzero(lexicon[at] == hashes)
        numbers.append(hashes[known])
        words.append(known)
    number = np.concatenate([*numbers, np.zeros(0, np.uint64)])
    return (tk.mix(number) >> _U(64 - TABLE_BITS)).astype(np.int64), np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)


def emissions(crf_weights: np.ndarray, number: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, crf_weights.shape[1]))
    for label in range(crf_weights.shape[1]):
        out[:, label] = np.bincount(word, weights=crf_weights[number, label], minlength=n)
    return out


def segments(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, length) of segments of up to SEGMENT words, in order."""
    words = np.diff(cut)
    each = -(-words // SEGMENT)
    row = np.repeat(np.arange(len(words)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    first = cut[row] + nth * SEGMENT
    return row, first, np.minimum(SEGMENT, cut[row + 1] - first)


def _unit(x: np.ndarray, axis) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def posteriors(log_emissions: np.ndarray, transitions: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(label of each word | its text), words x labels.  `cut`: first word of each text, and the number of words."""
    n, k = log_emissions.shape
    if not n:
        return log_emissions
    a = np.exp(transitions - transitions.max())
    e = np.exp(log_emissions - log_emissions.max(axis=1, keepdims=True))
    row, first, length = segments(cut)
    m = len(row)
    steps = int(length.max())
    at = np.minimum(first[None, :] + np.arange(steps)[:, None], n - 1)
    live = np.arange(steps)[:, None] < length[None, :]
    em = np.where(live[:, :, None], e[at], 1.0)  # steps x segments x labels
    # Each segment's product of transfer matrices.
    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(steps):
        some = np.flatnonzero(live[t])
        moved = (product[some].reshape(-1, k) @ a).reshape(-1, k, k) * em[t, some][:, None, :]
        product[some] = moved / moved.sum(axis=(1, 2), keepdims=True)
    # Over the segments of each text: what enters from the left, and from the right.
    nth = np.arange(m) - np.searchsorted(row, row, side="left")
    left, right = np.full((m, k), 1.0 / k), np.full((m, k), 1.0 / k)
    by_nth = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
    for j in range(1, len(bounds) - 1):
        some = by_nth[bounds[j] : bounds[j + 1]]
        left[some] = _unit(np.einsum("mi,mij->mj", left[some - 1], product[some - 1]), 1)
    for j in range(len(bounds) - 2, 0, -1):
        some = by_nth[bounds[j] : bounds[j + 1]]
        right[some - 1] = _unit(np.einsum("mij,mj->mi", product[some], right[some]), 1)
    forward = np.empty((steps, m, k))
    state = left
    for t in range(steps):
        state = np.where(live[t][:, None], _unit((state @ a) * em[t], 1), state)
        forward[t] = state
    out = np.empty((n, k))
    state = right
    for t in range(steps - 1, -1, -1):
        some = np.flatnonzero(live[t])
        out[at[t, some]] = _unit(forward[t, some] * state[some], 1)
        state = np.where(live[t][:, None], _unit((em[t] * state) @ a.T, 1), state)
    return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], number: np.ndarray, word: np.ndarray, n_words: int, labels: list[str], lexicon: np.ndarray, rounds: int = 40, l2: float = 1e-6) -> Crf:
    """Maximum likelihood by Adam on all sequences at once.

    `sequences`: (distinct-word numbers, label numbers) of each, all of one length; `number`, `word`: features of the distinct words.
    """
    k = len(labels)
    ids = np.stack([s[0] for s in sequences])
    gold = np.stack([s[1] for s in sequences])
    rows, steps = ids.shape
    cut = np.arange(rows + 1) * steps
    weights, transitions = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k))
    # Counts of gold labels a distinct word, and of gold transitions, don't change.
    gold_words = np.zeros((n_words, k))
    np.add.at(gold_words, (ids.ravel(), gold.ravel()), 1)
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    total = rows * steps
    at_once = max(1, FIT_CELLS // (steps * k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for t in range(1, rounds + 1):
        word_scores = emissions(weights, number, word, n_words)
        expected_words, pairs = np.zeros((n_words, k)), np.zeros((k, k))
        for lo in range(0, rows, at_once):
            some = ids[lo : lo + at_once]
            p, met = _expected(word_scores[some], transitions)
            pairs += met
            for label in range(k):
                expected_words[:, label] += np.bincount(some.ravel(), weights=p[:, :, label].ravel(), minlength=n_words)
        diff = (gold_words - expected_words) / total
        grad = np.stack([np.bincount(number, weights=diff[word, label], minlength=1 << TABLE_BITS) for label in range(k)], axis=1) - l2 * weights
        grad_t = (gold_steps - pairs) / total - l2 * transitions
        for i, (param, g) in enumerate(((weights, grad), (transitions, grad_t))):
            m1, m2 = moments[2 * i], moments[2 * i + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            param += 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return Crf(labels, weights, transitions, lexicon)


def _expected(log_e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words and expected transition counts of sequences of one length."""
    rows, steps, k = log_e.shape
    a = np.exp(transitions - transitions.max())
    e = np.exp(log_e - log_e.max(axis=2, keepdims=True))
    forward, backward = np.empty((steps, rows, k)), np.empty((steps, rows, k))
    state = np.full((rows, k), 1.0 / k)
    for t in range(steps):
        state = _unit((state @ a) * e[:, t], 1)
        forward[t] = state
    state = np.full((rows, k), 1.0 / k)
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        backward[t] = state
        right = e[:, t] * state
        if t:
            # The sum over rows of forward x a x right, each row's brought to 1.
            before = forward[t - 1]
            pairs += a * ((before / ((before @ a) * right).sum(axis=1, keepdims=True)).T @ right)
        state = _unit(right @ a.T, 1)
    p = _unit(forward * backward, 2).transpose(1, 0, 2)
    return p, pairs
