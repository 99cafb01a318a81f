"""Token counts by the whole-token shortcut, for byte-fallback piece BPE models.

Offline, once: every vocabulary string that the library encodes alone as its one token is proved to be
a whole token. Text is then cut at places no piece spans: before a run of the space mark that
follows another character, and on both sides of a character that occurs in no piece of several
characters. Pre-tokens that are whole tokens count one; the rest are merged by the library, once for
each distinct pre-token and worker (a bounded memo), and added up.

Nulls and empty texts have 0 tokens; a null id keeps its row; texts are whole, whatever
their length; repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Entries of a worker's memo of merged pre-tokens; it is emptied when full.
MEMO = 600_000
#: Texts whose new pre-tokens are merged together.
TOGETHER = 512
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def prove(model_path: str) -> tuple[frozenset[str], str]:
    """(strings proved to be whole tokens when they stand as pre-tokens, characters inside longer pieces).

    Raises ValueError when the model has a piece that spans a cut, as then pre-tokens could merge.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {i: model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces.values()):
        raise ValueError("a piece holds a space mark after another character")
    starting = [(i, p) for i, p in pieces.items() if p[0] == SPACE]
    encoded = model.encode([p[1:].replace(SPACE, " ") for _, p in starting], num_threads=1)
    whole = frozenset(p for (i, p), ids in zip(starting, encoded) if ids == [i])
    if model.encode("\n") == [next(i for i, p in starting if p == SPACE), *model.encode("\n")[1:]]:
        whole |= {SPACE}  # the library gives nothing for an empty text, so this one is proved before a barrier
    return whole, "".join(sorted({c for p in pieces.values() if len(p) > 1 for c in p}))


class Counter:
    """Counts tokens of texts; holds the model, the proved set and the memo of a worker."""

    def __init__(self, model_path: str, whole: frozenset[str], inside: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.whole, self.memo = whole, dict.fromkeys(whole, 1)
        self.barrier = "\n" not in inside  # a line break is in no longer piece and costs its one byte

    def parts(self, text: str | None) -> tuple[int, list[str]]:
        """Tokens known without a look, and the text's pre-tokens. One that starts with a line break stands
        for what follows a line break without a space."""
        if not text:
            return 0, []
        text = SPACE + text.replace(" ", SPACE)
        lines = text.split("\n") if self.barrier else [text]
        out: list[str] = []
        for i, line in enumerate(lines):
            if i and line and line[0] != SPACE:
                first, _, line = line.partition(SPACE)
                out.append("\n" + first)
                line = _ and SPACE + line
            if not line:
                continue
            out += RUNS.findall(line) if SPACE * 2 in line else [SPACE + w for w in line.split(SPACE)[1:]]
        return len(lines) - 1, out

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > MEMO + len(self.whole):
            self.memo = dict.fromkeys(self.whole, 1)
        memo, out = self.memo, []
        for i in range(0, len(texts), TOGETHER):
            split = [self.parts(t) for t in texts[i : i + TOGETHER]]
            fresh = [w for w in set().union(*(x for _, x in split)) if w not in memo]
            # The library puts a space mark before a text; before a line break it is a token, and so is the break.
            asked = [w if w[0] == "\n" else w[1:].replace(SPACE, " ") for w in fresh]
            memo |= zip(fresh, (len(ids) - 2 * (w[0] == "\n") for w, ids in zip(fresh, self.model.encode(asked, num_threads=1))))
            out += [n + sum([memo[w] for w in x]) for n, x in split]
        return out


_counters: dict[str, Counter] = {}


def worker_counter(model_path: str, whole: frozenset[str], inside: str) -> Counter:
    """The counter of this worker, whose memo outlives a task."""
    if model_path not in _counters:
        _counters.clear()
        _counters[model_path] = Counter(model_path, whole, inside)
    return _counters[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row, tokens as the library gives them for the whole text."""
    whole, inside = prove(model_path)
    proved = docs.sparkSession.sparkContext.broadcast((whole, inside))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(model_path, *proved.value)
        for batch in (whole.slice(i, 2 * TOGETHER) for whole in batches for i in range(0, whole.num_rows, 2 * TOGETHER)):
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
