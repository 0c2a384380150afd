"""Token counts: batch encoding in Arrow functions, lengths only.

``count_tokens`` returns one row per input row. Rows travel in Arrow batches;
inside a task texts are gathered into groups of about ``group_bytes`` UTF-8
bytes (never by row count, so a few very long texts do not make one group
huge). Every text is split at *safe boundaries*: a single space between two
characters that are neither a space nor the piece marker U+2581. The model
turns a space into the marker, no piece of its vocabulary has a marker after
another character (checked when the model is loaded), so no merge can cross
such a place and the counts of the parts add up to the count of the whole
text. Equal parts of a group are encoded once; a bounded table remembers the
counts of parts across groups of a task.

Defined cases: null text counts as empty (0 bytes, 0 tokens); an empty text
has 0 tokens; a text without any safe boundary is encoded in one piece;
repeated rows each get their row; an empty table gives no rows; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARKER = "▁"
_SAFE = re.compile(f"(?<=[^ {MARKER}]) (?=[^ {MARKER}])")

_models: dict[str, object] = {}


def _model(name: str):
    """The sentencepiece model of a file of ``public_tokenizers``, once per worker."""
    if name not in _models:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        for i in range(sp.get_piece_size()):
            if MARKER in sp.id_to_piece(i).lstrip(MARKER):
                raise ValueError(f"{name}: piece {i} joins words; spaces are no safe boundaries")
        _models[name] = sp
    return _models[name]


def split_safely(text: str) -> list[str]:
    """Parts whose token counts add up to the count of ``text``."""
    if not text:
        return []
    if "  " in text or MARKER in text or text[0] == " " or text[-1] == " ":
        return _SAFE.split(text)
    return text.split(" ")


class _Counter:
    def __init__(self, model: str, remember: int):
        self.sp = _model(model)
        self.remember = remember
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [split_safely(t) for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        new = list({p for ps in parts for p in ps if p not in known})
        if new:
            known.update(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        return [sum([known[p] for p in ps]) for ps in parts]


def count_tokens(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = 2 << 20,
    remember: int = 300_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; over_limit: n_tokens > limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(model, remember)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.array(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
            group = np.cumsum(sizes) // group_bytes
            cuts = np.flatnonzero(np.diff(group)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                if lo == hi:
                    continue
                counts = counter([t or "" for t in texts[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(sizes[lo:hi], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([c > limit for c in counts], pa.bool_()),
                    ],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
