"""Hierarchical multi-length packing.

Documents (their ids and an end id) are cut freely. Windows of the longest tier are cut off first; the
rest of a document is routed to the smallest tier that holds it. Each tier's windows are packed from
the largest rest down, gaps are filled with the largest rests of shorter tiers that fit, and a
gap that none fits takes a cut-off part of the shortest. What is left at the end of a task is cut into
powers of two, so that no sequence has padding. Step groups hold sequences of one tier and are numbered over
the whole table: the tokens of a tier, task after task, are cut into as many groups as hold ``STEP_TOKENS``
each, all equal to within a sequence.

A task packs the rows of its own partition, without a shuffle; it holds the ids of ``PENDING`` rests
at most. The pieces are written to the shared folder, as groups need the sums of all tasks: a number for each task and
tier, added up in a window over those alone. A lost task is packed again as a whole. Nulls and empty texts are documents of
the end id alone; a null id keeps its pieces; a long text gives as many windows as it fills; repeated
rows are documents of their own; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import Memo, cut, held, trim, written
from gridloom.llm.bpe import byte_alphabet

#: Context sizes, the longest first; tokens of a step group; rests that a task holds before it packs them.
TIERS, STEP_TOKENS, PENDING = (4096, 2048, 1024, 512, 256), 65_536, 4096
#: Bits of a sequence's number inside its task; sums of tasks that are broadcast, beyond them pieces are shuffled.
TASK_BITS, BROADCAST_SUMS = 36, 500_000
#: Entries of a generation of a worker's memo of words, and of its memo of their parts.
MEMO = 300_000
#: Python splits at these, the tokenizer's \s does not.
ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Fixed value: the tokenizer's pattern, as it reads on lower-case printable characters below LATIN_END, which composition leaves alone.
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ſ²³¹¼½¾]+")
LATIN_END = "\u0180"
BYTE_CHARACTERS = {b: c for c, b in byte_alphabet().items() if b > 0x7F}


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space; each distinct word is encoded once.

    The tokenizer's normaliser and splits never look past white space, so a text's ids are those of
    its words in a row; texts with characters that Python alone takes for white space go to the tokenizer
    as they are, and so do words that may hold an added token or have a character from LATIN_END on. Other words are
    split by the same pattern, and the tokenizer's model encodes each distinct part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Memo(MEMO), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token; the model reads its bytes as characters."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if "<|" in word or not word.isprintable() or not (word.isascii() or (max(word) < LATIN_END and "İ" not in word)):
            return self._whole(word)
        known, out = self.parts, []
        for part in LATIN_PARTS.findall(word.lower()):
            ids = known.get(part)
            if ids is None:
                ids = known[part] = self._part(part)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.parts) > MEMO:
            self.parts = {}
        memo, out = self.words.turn(), []
        for text in texts:
            if text and ODD_SPACES.search(text):
                out.append(self._whole(text))
                continue
            words = text.split() if text else []
            if new := set(words).difference(memo):
                for w in self.words.missing(new):
                    memo[w] = self._word(w)
            out.append(b"".join([memo[w] for w in words]))
        return out


@held
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker, whose memo outlives a task, but not the operator's stage."""
    return WordEncoder(path)


class Packer:
    """Packs documents one by one; finished pieces are taken with ``take``."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.task, self.sequences, self.steps = tiers, task, 0, {}
        self.pending: list[tuple[int, int, int, np.ndarray]] = []  # length, number, start, ids of the rest
        self.docs: list[tuple[object, int]] = []
        self.pieces: list[tuple] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        at, longest = len(self.docs) - 1, self.tiers[0]
        for start in range(0, len(ids) - longest + 1, longest):
            self._sequence([(at, start, ids[start : start + longest])])
        if rest := len(ids) % longest:
            self.pending.append((rest, at, len(ids) - rest, ids[len(ids) - rest :]))
        if len(self.pending) >= PENDING:
            self._pack(last=False)

    def _sequence(self, parts: list[tuple[int, int, np.ndarray]]) -> None:
        size = sum(len(x) for _, _, x in parts)
        tier = next((t for t in reversed(self.tiers) if t >= size), size)
        before, offset = self.steps.get(tier, 0), 0
        self.steps[tier] = before + size
        for at, start, ids in parts:
            doc_id, tokens = self.docs[at]
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.task << TASK_BITS | self.sequences, offset, tier, before))
            offset += len(ids)
        self.sequences += 1

    def _pack(self, last: bool) -> None:
        held = sorted(self.pending, key=lambda x: (x[0], -x[1]))
        while held:
            size, at, start, ids = held.pop()
            parts = [(at, start, ids)]
            gap = next(t for t in reversed(self.tiers) if t >= size) - size
            while gap and held:
                fit = bisect.bisect_right(held, gap, key=lambda x: x[0]) - 1
                n, at, start, ids = held.pop(max(fit, 0))
                if n > gap:  # none fits: the shortest is cut
                    bisect.insort(held, (n - gap, at, start + gap, ids[gap:]), key=lambda x: x[0])
                    ids = ids[:gap]
                parts.append((at, start, ids))
                gap -= len(ids)
            if not gap:
                self._sequence(parts)
            elif last:
                self._powers(parts)
            else:  # waits for more documents
                self.pending = [(len(x), at, start, x) for at, start, x in parts]
                return
        self.pending = []

    def _powers(self, parts: list[tuple[int, int, np.ndarray]]) -> None:
        """The last window, which nothing is left to fill, as sequences of powers of two."""
        left = sum(len(x) for _, _, x in parts)
        while left:
            need, now = 1 << (left.bit_length() - 1), []
            left -= need
            while need:
                at, start, ids = parts[0]
                now.append((at, start, ids[:need]))
                parts[:1] = [(at, start + need, ids[need:])] if len(ids) > need else []
                need -= len(now[-1][2])
            self._sequence(now)

    def take(self, last: bool = False) -> list[tuple]:
        if last:
            self._pack(last=True)
        out, self.pieces = self.pieces, []
        return out


def tokenizer_file_is_ascii_safe(path: str) -> bool:
    """Whether the file's normaliser and splits never look past white space (those that ``WordEncoder`` relies on)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    return kinds == ["NFC", "Replace", "Lowercase"] and split["invert"] and split["behavior"] == "Removed" and not any(a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (from 0 in each tier)."""
    if not tokenizer_file_is_ascii_safe(tokenizer_path):
        raise ValueError("the tokenizer looks past white space; its words can't be encoded apart")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "before"]
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, id_type = word_encoder(tokenizer_path), Packer(TaskContext.get().partitionId(), tiers), None

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            if taken := packer.take(last):
                columns = [*zip(*taken)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                few = batch.slice(i, 256)
                for doc_id, ids in zip(few.column(0).to_pylist(), encoder.encode(few.column(1).to_pylist())):
                    packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
            yield from rows(last=False)
        yield from rows(last=True)
        del packer
        trim()

    pieces = written(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])), "pieces")
    return grouped(pieces).withColumnRenamed("id", id_col)


def grouped(pieces: DataFrame) -> DataFrame:
    """``pieces`` with step_group in place of before, the tokens that the task had put into the tier before the sequence."""
    task = F.shiftright("sequence_id", TASK_BITS).alias("task")
    sums = pieces.groupBy(task, "tier").agg(F.sum("length").alias("tokens"))
    so_far = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("task", "tier", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("base"), F.sum("tokens").over(Window.partitionBy("tier")).alias("all"))
    sums = cut(sums)
    if sums.count() <= BROADCAST_SUMS:
        sums = F.broadcast(sums)
    groups = F.greatest(F.lit(1), F.round(F.col("all") / STEP_TOKENS)).cast("long")
    group = F.floor(((F.col("base") + F.col("before")) / F.col("all")) * groups)
    return pieces.withColumn("task", task).join(sums, ["task", "tier"]).select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.cast("long").alias("step_group"))
