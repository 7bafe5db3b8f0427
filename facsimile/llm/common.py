"""What several operators of this subpackage share.

Texts cross into Python as Arrow binary, so one document is one ``bytes``
object and is never decoded. A null text counts as an empty one. Words are runs
of bytes other than space and tab to carriage return; ``bytes.split()`` cuts at
just these, and ``bytes.lower()`` changes A-Z alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = np.empty(0, np.uint64)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so no other column of the input can clash."""
    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of the frame has, whatever its spelling."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mapped(rows: DataFrame, run) -> DataFrame:
    """``rows.mapInArrow(run, rows.schema)`` for columns of any names, dots among them; ``run`` goes by places."""
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*rows.columns)


# --- 64-bit hashes -------------------------------------------------------------

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                         0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash by word; bounded, since a full table starts anew."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, in order; fewer words give none."""
    n = len(words) - k + 1
    if n <= 0:
        return EMPTY
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mixed(words[j:j + n] + _MULTIPLIERS[j % 8] * np.uint64(j // 8 + 1))  * _MULTIPLIERS[(j + 3) % 8]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
