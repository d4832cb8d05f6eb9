"""Prefix trie, phrases and repeated substrings against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillwave.llm import phrases, prefixtrie, substrings
from quillwave.llm import textkernel as tk

DOCS = "doc_id long, text string, lang string, source string, packed string, runs long, n long, at long"
TURNS = "conv_id long, turn long, role string, text string, key string, sizes long, node long"


@pytest.fixture
def spread_out(spark):
    """Many small partitions, so that groups and paths cross their borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


# Prefix trie


def _fingerprint(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def _plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _fingerprint(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)


def _trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(spread_out, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(-20, 180):
        if seed == 3 and conv > 40:
            turns = [("user", "hello"), ("bot", "hi")] * (conv % 3)
        else:
            turns = [(rnd.choice(["user", None]), rnd.choice(["a", "bé", "", None])) for _ in range(rnd.choice([1, 2, 3, 9, 30]))]
        rows += [(conv, k if rnd.random() < 0.9 else None, *t) for k, t in enumerate(turns)]
    rnd.shuffle(rows)
    assert _trie_rows(prefixtrie.prefix_trie(_conversations(spread_out, rows))) == _plain_trie(rows)


def test_a_hot_conversation_crosses_ranges(spread_out):
    """Most conversations are copies of one, and all the others start with its first turn."""
    rows = [(c, t, "user", x) for c in range(0, 3000, 5) for t, x in enumerate(["start", "go on", "end"] if c % 3 else ["start", f"own {c}"])]
    assert _trie_rows(prefixtrie.prefix_trie(_conversations(spread_out, rows))) == _plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 2, "user", "x" * 200_000), (9, 1, "user", "tie"), (9, 1, "user", "tie"), (9, 1, "bot", "tie")]
    assert _trie_rows(prefixtrie.prefix_trie(_conversations(spark, rows))) == _plain_trie(rows)
    assert prefixtrie.prefix_trie(_conversations(spark, rows).where("conv_id = -1")).collect() == []


def test_common_turns():
    block = [bytes([i]) * prefixtrie.KEY for i in range(4)]
    join = lambda *i: b"".join(block[k] for k in i)
    cases = [((0, 1, 2), (0, 1, 2), 3), ((0, 1), (0, 1, 2), 2), ((0, 1, 2), (0, 2, 2), 1), ((1,), (0,), 0), ((), (0,), 0)]
    assert [prefixtrie.common_turns(join(*a), join(*b)) for a, b, _ in cases] == [n for *_, n in cases]


# Phrases


def _plain_phrases(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p in f if len(p) > 1 and f[p] >= 10]
        found = []
        for p in candidates:
            if any(len(q) > len(p) and 100 * f[q] >= 50 * f[p] and p in [q[i : i + len(p)] for i in range(len(q))] for q in candidates):
                continue
            score, _, left, right = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:2000])]
    return sorted(out)


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "p", 1, 2, 3) for i, (t, lang) in enumerate(rows)], DOCS)


def test_phrases_equal_brute_force(spread_out):
    rnd = random.Random(3)
    words = ["New", "york", "City", "é", "ß", "aa", "b\x00c", "the", "of", " ", "日本"]
    rows = []
    for i in range(400):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ", ", ".", " \n", " "]) for _ in range(rnd.randint(0, 40)))
        rows.append((text + rnd.choice(["new york city", " new  york", "!"]), rnd.choice(["en", "en", "fr", None])))
    rows += [(None, "en"), ("", "de"), (" \t", "de"), ("same line again\n" * 50, "de"), ("a " * 5000, "es")]
    assert sorted(tuple(r) for r in phrases.collocations(_documents(spread_out, rows)).collect()) == _plain_phrases(rows)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(_documents(spark, [("a b", "en")]).where("doc_id < 0")).collect() == []


def test_more_phrases_than_are_reported(spark):
    rows = [(". ".join(f"x{i} y{i}" for i in range(2300)), "en")] * 10 + [("x7 y7", "en")]
    got = sorted(tuple(r) for r in phrases.collocations(_documents(spark, rows)).collect())
    assert got == _plain_phrases(rows) and len(got) == 2000


def test_scores_are_exact(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        a = rnd.randint(10, 10**15)
        rows.append((a, rnd.randint(a, 10**16 - 1), rnd.randint(a, 10**16 - 1)))
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1_000_000 * x.a**2 // (x.l * x.r) for x in got)


def test_folding_keeps_weights():
    table = pa.table({"lang": ["en", "fr", "en"], "piece": ["a b a b", "a b", "é a b"], "weight": pa.array([2, 3, 4], pa.int64())})
    got = Counter()
    for _, grams in phrases.folded(table, pa.array(["en", "fr"])):
        for row in grams.to_pylist():
            got[["en", "fr"][row["lang"]], row["gram"]] += row["weight"]
    assert got["en", "a b"] == 8 and got["fr", "a b"] == 3 and got["en", "b a b"] == 2 and got["en", "é"] == 4 and got["en", "a"] == 8


# Repeated substrings


def _plain_repeats(rows):
    rows = {(i is not None, i or 0, x): x for i, x in rows}  # rows equal in both are one document
    texts = {key: re.findall(r"[^\x20\x09-\x0D]+", x or "") for key, x in rows.items()}
    seen, out = {}, {}
    for key in sorted(texts, key=lambda k: k[:2]):
        words = texts[key]
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.setdefault(window, (key, p))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[key] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def _check_repeats(spark, rows):
    got = substrings.without_repeats(spark.createDataFrame([(i, x, "en", "s", "p", 1, 2, 3) for i, x in rows], DOCS)).collect()
    want = _plain_repeats(rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)) == sorted((i is not None, i or 0, *want[i is not None, i or 0, x]) for i, x in rows)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spread_out, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([2, 5, 50, 4000][seed])] + ["é", "日本"]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 70))) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 8))]
        rows.append((i * 7 % 120 - 30, rnd.choice([" ", "\n", "  \t"]).join(parts)))
    _check_repeats(spread_out, rows)


def test_repeats_on_the_edge_of_a_window(spark):
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, f"x {word('p', 20)} y"), (2, f"u {word('p', 20)} v"), (3, f"k {word('p', 19)} l"), (4, f"{word('q', 40)} {word('q', 40)}"), (5, word("q", 25)), (6, f"p3 {word('p', 20)} {word('q', 21)}")]
    removed = {r.doc_id: r.n_removed for r in _check_repeats(spark, rows)}
    assert removed == {1: 0, 2: 20, 3: 0, 4: 40, 5: 25, 6: 41}


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"word{i % 977} more{i % 31}" for i in range(30_000))
    rows = [(None, "a b " * 15), (1, None), (2, ""), (3, " \n"), (4, long), (5, "z " * 100), (6, "z " * 100), (6, "z " * 100), (7, "tail " + long), (8, " " * 30)]
    _check_repeats(spark, rows)
    assert substrings.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_rows_that_share_an_id_keep_their_own_text(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, one + " " + two), (2, two)]
    got = substrings.without_repeats(spark.createDataFrame([(i, x, "en", "s", "p", 1, 2, 3) for i, x in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) in ([(1, 30, 0), (1, 60, 30), (2, 30, 30)], [(1, 30, 30), (1, 60, 0), (2, 30, 30)])


def test_pieces_of_a_long_text_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    text = " ".join(f"w{i % 53}" for i in range(700))
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int64()), pa.array([9], pa.int64()), pa.array([text])], names=["doc", "twin", "text"])
    seen = Counter()
    for out in substrings._seeds([batch]):
        rows = out.to_pydict()
        for kind, at, n in zip(rows["kind"], rows["at"], rows["n"], strict=True):
            seen.update((at & 0xFFFFFFFF) + k for k in range(n) if kind != substrings.NOTICE)
    assert seen == Counter(range(681))


def test_kernel_helpers():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 60, 200).astype(np.uint64)
    for width in (1, 2, 3, 8, 13):
        assert (tk.sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()
    words = np.concatenate([x[:50], x[10:40], x[:50]])
    h = tk.sequence_hashes(words, np.array([10, 50, 80]), np.array([40, 80, 110]))
    assert h[0] == h[1] != h[2]
    grams = tk.gram_hashes(words, 8)
    assert grams[10] == grams[50] != grams[11] and len(grams) == len(words) - 7
