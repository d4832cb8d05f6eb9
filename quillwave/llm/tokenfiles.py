"""Token-ID output: whole texts to files of compressed ids in ascending document order, and back.

Documents are sorted by range of their id, so each task tokenises and writes one stretch of the order as one file
of sections (see `rans`).  A section closes after `SECTION_IDS` ids at a document's end, so memory follows the
section.  Files go to the shared folder under a name of the attempt's own; the manifest, a table that Spark
commits, lists one finished file a stretch, so retried or lost attempts leave nothing that a reader sees.  Readers
take sections, any number in parallel, check their checksums and decode them.

The tokenizers library encodes texts.  Where its pipeline never looks across ASCII white space, each distinct piece
between white space is encoded once in a worker's bounded memory (`MEMO` pieces a half) and texts are put together
from their pieces' ids.  Where it folds case, texts in Latin letters alone are lower-cased first, so more pieces are
alike, and a lower-case word, with or without a comma or full stop, is asked of the tokenizer's model directly.
Probes of the tokenizer at hand tell which of these hold; one for which none holds gets whole texts.

Null and empty texts have the end id alone.  Null ids come first; rows that share an id are
ordered by a hash of the text, by which ranges may cut them too.  An empty table makes no file and no
row.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import rans
from quillwave.llm.common import TEXT_KEY, fresh_path, stash, text_key, tidy

END_ID = 1
SECTION_IDS = 1 << 19
#: Pieces in either half of a worker's memory; a full young half becomes the old one, from which what is met again comes back.
MEMO = 250_000
ENCODE_TOGETHER = 512
#: Sections that a reading task decodes, one after another.
SECTIONS_A_TASK = 8
_SEPARATOR = "~"
_MARKS = b",", b"."
#: Latin characters whose lower case and composition are the same in any library.
_LATIN = re.compile("[\x00-\x7f\xa0-\xff]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_PROBES = ["word", "thestreet", "stra\xdfe", "\xe9t\xe9", "ni\xf1o", "\xaa\xb5", "qzxv"]
_CAPITALS = ["Word", "WORD", "aBc", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *(chr(c) for c in range(0xC0, 0xDF)), "\xc9T\xc9", "NI\xd1O"]
_SPACED = "one two\tthree,\r\n four. it's 5 !? \xe9t\xe9  don't\x0b\x0cA-b c_d (e) ~ f"


class Encoder:
    """Texts to u2 ids through the tokenizers library, with a memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores; threads of its own would only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alone = self._ids([_SEPARATOR])[0]
        self.cut = alone[0] if len(alone) == 1 else None
        self.pieces = self._ids([_SPACED])[0] == [i for ids in self._ids(_SPACED.split()) for i in ids] and not any(re.search(r"\s", t) for t in self.added)
        self.folds = self.pieces and self._ids(_CAPITALS) == self._ids([p.lower() for p in _CAPITALS])
        # A lower-case Latin word is one pre-token; where the tokenizer agrees, its model is asked directly.
        self.direct = self.pieces and [self._word(w.encode()) for w in _PROBES] == [self._packed(ids) for ids in self._ids(_PROBES)]
        self.marks = {m: self._packed(self._ids([m.decode()])[0]) for m in _MARKS}
        marked = [(w, m) for w in _PROBES for m in _MARKS]
        if self._ids([w + m.decode() for w, m in marked]) != [ids + self._ids([m.decode()])[0] for (_, m), ids in zip(marked, self._ids([w for w, _ in marked]), strict=True)]:
            self.marks = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_LETTERS)
        return self._packed([t.id for t in self.model.tokenize(text)])

    def _folded(self, text: str) -> str:
        """The text with fewer distinct pieces and the same ids."""
        if not self.folds or not _LATIN.fullmatch(text):
            return text
        low = text.lower()
        # Added tokens are looked for in the text as it is.
        return text if any(t in low and low.count(t) != text.count(t) for t in self.added) else low

    def _direct(self, pieces: list[bytes]) -> list[bytes]:
        """Adds lower-case Latin words, with a mark at their end or not, to the memory; returns the other pieces."""
        left, memo, marks, tokenize = [], self.memo, self.marks, self.model.tokenize
        for p in pieces:
            end = marks.get(p[-1:])
            stem = p if end is None else p[:-1]
            if stem.isalpha() and stem.islower():
                text = stem.decode()
            elif not stem.isascii() and (text := stem.decode()).isalpha() and text.islower() and _LATIN.fullmatch(text):
                text = stem.decode("latin-1").translate(_BYTE_LETTERS)
            else:
                left.append(p)
                continue
            ids = memo.get(stem)
            if ids is None:
                ids = memo[stem] = array("H", [t.id for t in tokenize(text)]).tobytes()
            if end is not None:
                memo[p] = ids + end
        return left

    def _learn(self, pieces: list[bytes]) -> None:
        memo = self.memo
        left = self._direct(pieces) if self.direct else pieces
        texts = [p.decode() for p in left]
        joint = [i for i, t in enumerate(texts) if self.cut is not None and _SEPARATOR not in t]
        single = [i for i, t in enumerate(texts) if self.cut is None or _SEPARATOR in t]
        for lo in range(0, len(joint), ENCODE_TOGETHER):
            group = joint[lo : lo + ENCODE_TOGETHER]
            ids = np.array(self._ids([f" {_SEPARATOR} ".join([texts[i] for i in group])])[0], dtype=np.int64)
            bounds = np.flatnonzero(ids == self.cut)
            if len(bounds) != len(group) - 1:
                single += group
                continue
            packed, begin = ids.astype("<u2").tobytes(), 0
            for i, end in zip(group, [*bounds.tolist(), len(ids)], strict=True):
                memo[left[i]] = packed[2 * begin : 2 * end]
                begin = end + 1
        for i, ids in zip(single, self._ids([texts[i] for i in single]), strict=True):
            memo[left[i]] = self._packed(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, without the end id."""
        if not self.pieces:
            return [self._packed(ids) for ids in self._ids([t or "" for t in texts])]
        split = [self._folded(t or "").encode().split() for t in texts]
        out, lo = [], 0
        while lo < len(split):
            if len(self.memo) > MEMO:
                self.old, self.memo = self.memo, {}
            met, hi = set(), lo
            while hi < len(split) and (hi == lo or len(met) < MEMO // 4):
                met.update(split[hi])
                hi += 1
            memo, fresh = self.memo, []
            for p in met:
                if p not in memo:
                    if (ids := self.old.get(p)) is None:
                        fresh.append(p)
                    else:
                        memo[p] = ids
            self._learn(fresh)
            get = memo.__getitem__
            out += [b"".join(map(get, words)) for words in split[lo:hi]]
            lo = hi
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, path: str):
    end = np.array([END_ID], dtype="<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rans"
        sections, stream, at = [], None, 0
        doc_ids, packed, size = [], [], 0

        def close():
            nonlocal stream, at, doc_ids, packed, size
            if stream is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name}")
            raw = rans.encode(doc_ids, np.array([len(p) // 2 for p in packed]), np.frombuffer(b"".join(packed), "<u2"))
            stream.write(raw)
            sections.append((len(sections), at, len(raw), size))
            at += len(raw)
            doc_ids, packed, size = [], [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 512):
                for doc, ids_of in zip(ids[lo : lo + 512], encoder(path).encode(texts.slice(lo, 512).to_pylist()), strict=True):
                    doc_ids.append(doc)
                    packed.append(ids_of + end)
                    size += len(packed[-1]) // 2
                    if size >= SECTION_IDS:
                        close()
        if doc_ids:
            close()
        if stream is not None:
            stream.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(sections), pa.int32()), pa.array([name] * len(sections)), *(pa.array(c, pa.int64()) for c in zip(*sections, strict=True))], names=["part", "file", "section", "at", "bytes", "ids"])

    return run


def write_files(documents: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the files and returns the manifest: part, file, section, at, bytes, ids and start, a row a section."""
    order = F.col("doc_id").asc_nulls_first(), F.col(TEXT_KEY).asc()
    keyed = documents.select("doc_id", "text", text_key(F.col("text")).alias(TEXT_KEY))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = stash(ordered.mapInArrow(tidy(_write(folder, tokenizer)), "part int, file string, section long, at long, bytes long, ids long"), "manifest")
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("_ids"))
    before = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("_in", within).join(before, F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("_in")).drop("_in", "_before", "_part")


def _read(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    section = rans.decode(source.read_at(row["bytes"], row["at"]))
                ends = np.cumsum(section.lengths)
                starts = ends - section.lengths
                crc = [zlib.crc32(section.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(section.doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(section.lengths), pa.array(crc, pa.int64()), pa.array([row["file"]] * len(crc))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return run


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of each document, from the files."""
    # The manifest is tiny but each of its rows is a section to decode, so the number of tasks is asked for.
    spread = manifest.select("file", "at", "bytes", "start").repartition(-(-manifest.count() // SECTIONS_A_TASK) or 1)
    return spread.mapInArrow(tidy(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes all documents' ids into `folder` (a fresh shared one by default) and returns what its files hold."""
    folder = folder or fresh_path(documents.sparkSession, "token-ids")
    manifest = stash(write_files(documents, folder, tokenizer or default_tokenizer()), "manifest")
    return read_files(manifest, folder)
