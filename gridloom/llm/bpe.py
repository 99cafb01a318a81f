"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of neighbours inside a word are
looked up by binary search in the sorted array of pair keys, which gives their ranks; every word then
merges the leftmost occurrences of its lowest-ranked pair, all words at once, until no pair has
a rank. A word of LONG bytes or more is merged by itself: a heap gives the lowest rank, and a round
looks only at that rank's pairs and at those which the merges make, so a round costs what it merges. Only distinct pre-tokens are merged, a bounded memo keeps their ids in each worker.

Nulls and empty texts encode to no ids; a null id keeps its row; texts are whole, whatever their
length; repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.base import held

#: Fixed value: the pattern that splits text before byte-level merges.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Entries of a worker's memo of merged pre-tokens, emptied when full; symbols merged in one flat array.
MEMO, FLAT = 600_000, 1 << 20
#: Texts whose new pre-tokens are merged together; bytes from which a word is merged by itself.
TOGETHER, LONG = 512, 2048
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.added)) if self.added else None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [self._merge_long(w) if len(w) >= LONG else np.empty(0, "<u4") for w in words]
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        begin, held = 0, 0
        for end, i in enumerate(short, 1):
            held += len(words[i])
            if held >= FLAT or end == len(short):
                for j, ids in zip(short[begin:end], self._merge([words[j] for j in short[begin:end]])):
                    out[j] = ids
                begin, held = end, 0
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search over the sorted pair keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(word, np.uint8)]
        n = len(ids)
        # Symbols are linked, with a stop on either side; a symbol's rank is that of its pair with the next one.
        after, before, rank = np.arange(1, n + 2), np.arange(-1, n), np.full(n + 1, NO_RANK)
        rank[: n - 1] = self._ranks(ids[:-1], ids[1:])
        ids = np.r_[ids, -1]
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NO_RANK]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            found = waiting.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[rank[at] == r]  # those that no merge has changed since
            if not len(at):
                continue
            # Of pairs in a row ("aaa"), every second is taken, from the left.
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            gone = after[at]
            ids[at], rank[gone], ids[gone] = self.into[r], NO_RANK, -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            changed = np.unique(np.r_[at, before[at][before[at] >= 0]])
            last = after[changed] >= n
            rank[changed] = np.where(last, NO_RANK, self._ranks(ids[changed], ids[np.minimum(after[changed], n)]))
            wait(changed)
        return ids[:n][ids[:n] >= 0].astype("<u4")

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_of = [], []
        while len(ids):
            rank = np.full(len(ids), NO_RANK)
            if len(ids) > 1:
                key = ids[:-1] << 32 | ids[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank[:-1] = np.where((self.keys[at] == key) & (of[:-1] == of[1:]), self.rank[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            lengths = np.diff(np.r_[starts, len(of)])
            lowest = np.minimum.reduceat(rank, starts)
            live = np.repeat(lowest < NO_RANK, lengths)
            done_ids.append(ids[~live])
            done_of.append(of[~live])
            chosen = (rank == np.repeat(lowest, lengths)) & live
            # Of chosen positions in a row ("aaa"), every second is taken, from the left.
            where = np.flatnonzero(chosen)
            if len(where):
                run = np.flatnonzero(np.r_[True, np.diff(where) != 1])
                place = np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))
                where = where[place % 2 == 0]
                ids[where] = self.into[rank[where]]
                live[where + 1] = False
            ids, of = ids[live], of[live]
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(of, minlength=len(words)))[:-1])


class Encoder:
    """Encodes and decodes whole texts, with a memo of pre-tokens."""

    def __init__(self, path: str):
        self.bpe, self.memo = ByteBpe(path), {}

    def _parts(self, text: str) -> Iterable[str]:
        """The text's pre-tokens; strings of added tokens stand alone."""
        special, begin = self.bpe.special, 0
        if special is None or not any(s in text for s in self.bpe.added):
            return PRE_TOKEN.findall(text)
        out: list[str] = []
        for m in special.finditer(text):
            out += [*PRE_TOKEN.findall(text[begin : m.start()]), m[0]]
            begin = m.end()
        return out + PRE_TOKEN.findall(text[begin:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, out = self.memo, []
        memo |= {s: int(i).to_bytes(4, "little") for s, i in self.bpe.added.items()}
        for i in range(0, len(texts), TOGETHER):
            parts = [self._parts(text) if text else [] for text in texts[i : i + TOGETHER]]
            fresh = [p for p in set().union(*parts) if p not in memo]
            memo |= zip(fresh, (x.tobytes() for x in self.bpe.merge([p.encode() for p in fresh])))
            out += [b"".join([memo[p] for p in x]) for x in parts]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bpe.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@held
def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker, whose memo outlives a task."""
    return Encoder(path)


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """id, ids (array of ints), n_tokens, ids_sha256, decoded_sha256 of every row; ``keep`` False leaves the ids out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in (whole.slice(i, 2 * TOGETHER) for whole in batches for i in range(0, whole.num_rows, 2 * TOGETHER)):
            encoded = encoder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in encoded]), pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in encoded])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32()))] * keep, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep).withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()])], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
