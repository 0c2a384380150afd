"""Small helpers shared by the operators: shared folder, tables, words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a private folder only where it
    is unset (tests on one machine). Also points ``checkpoint()`` at it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="marketlens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe
    from then on against lost executors (its lineage is the files)."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(column: str) -> Column:
    """crc32 of the id written as decimal text (null id: crc32 of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PLACES = np.random.default_rng(11).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.array([chr(i).isalnum() or i == 95 or i >= 128 for i in range(256)])[:256]
# Punctuation beyond ASCII, as lead bytes of UTF-8: no-break space to inverted
# question mark, general punctuation, CJK punctuation.
# Scripts written without spaces, as ranges of code points: there every
# character is a word. Thai, Lao, Myanmar and Khmer; kana; ideographs. Their
# UTF-8 has three bytes, of which the first two tell the script (four bytes,
# three of them, for the rarer ideographs).
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF))
_MARKS = ((b"\xc2", 0xC2, None, 2), (b"\xe2\x80", 0xE2, 0x80, 3), (b"\xe2\x81", 0xE2, 0x81, 3), (b"\xe3\x80", 0xE3, 0x80, 3))


@dataclass
class Words:
    """The words of several texts: hash and number of bytes of each, and the
    place of the first word of each text (with the total at the end)."""

    hashes: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i + 1]]


def word_table(texts: list[str | None]) -> Words:
    """Words are runs of ASCII letters, digits and underscores and of characters
    beyond ASCII other than the punctuation in ``_MARKS``, lower-cased; each
    character of a script without spaces (``SINGLE``) is a word of its own. Array
    operations over the bytes of all texts; whole texts, no word is left out."""
    data = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = b"\n".join(data) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[raw]
    for mark, first, second, width in _MARKS:
        if mark in joined:
            if second is None:
                at = np.flatnonzero((raw[:-1] == first) & (raw[1:] >= 0xA0))
            else:
                at = np.flatnonzero((raw[:-1] == first) & (raw[1:] == second))
            for k in range(width):
                inside[at + k] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    begin, end = edges[::2], edges[1::2]  # the last byte is a line break: every word ends
    single, width = _single_characters(raw)
    if len(single):
        # Cut before and after each of these characters.
        cuts = np.unique(np.concatenate([begin, single, single + width]))
        begin = cuts[inside[cuts]]
        ends = np.unique(np.concatenate([end, begin]))
        end = ends[np.searchsorted(ends, begin, "right")]
    sizes = end - begin
    text_ends = np.cumsum([len(d) + 1 for d in data])
    starts = np.concatenate([[0], np.searchsorted(begin, text_ends)]).astype(np.int64)
    if not len(begin):
        return Words(np.empty(0, np.uint64), sizes, starts)
    at = np.flatnonzero(inside)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    mixed = (raw[at] + np.uint64(1)) * _PLACES[place & 4095]
    return Words(mix64(np.add.reduceat(mixed, firsts) + sizes.astype(np.uint64)), sizes, starts)


def _single_characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and widths of the characters of ``SINGLE`` in UTF-8 bytes."""
    three = np.flatnonzero((raw >= 0xE0) & (raw <= 0xE9))
    four = np.flatnonzero((raw >= 0xF0) & (raw <= 0xF0))
    code = np.concatenate(
        [
            ((raw[three] & 15).astype(np.int32) << 12) | ((raw[three + 1] & 63).astype(np.int32) << 6) | (raw[three + 2] & 63),
            ((raw[four + 1] & 63).astype(np.int32) << 12) | ((raw[four + 2] & 63).astype(np.int32) << 6) | (raw[four + 3] & 63),
        ]
    )
    at = np.concatenate([three, four])
    width = np.repeat([3, 4], [len(three), len(four)])
    ok = np.zeros(len(at), bool)
    for low, high in SINGLE:
        ok |= (code >= low) & (code <= high)
    order = np.argsort(at[ok], kind="stable")
    return at[ok][order], width[ok][order]


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hash of every run of ``n`` words, by position.

    A text of 1 to n-1 words has one shingle, all its words; an empty text
    has none.
    """
    if len(word_hashes) == 0:
        return np.empty(0, np.uint64)
    n = min(n, len(word_hashes))
    count = len(word_hashes) - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + word_hashes[i : i + count]
    return mix64(out)


def ship_code(spark: SparkSession) -> None:
    """Give the workers this package, once per session (as ``--py-files`` would)."""
    shared_folder(spark)
    context = spark.sparkContext
    if getattr(context, "_marketlens_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves this file to the executors for as long as it runs.
    path = os.path.join(tempfile.mkdtemp(prefix="marketlens-code-"), "marketlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._marketlens_shipped = True
