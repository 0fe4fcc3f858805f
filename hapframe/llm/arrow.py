"""Arrow helpers for Python stages: words of many texts at once, and groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, offsets, dictionary): words of text i are dictionary[codes[offsets[i]:offsets[i + 1]]].

    Words are runs of anything but space and \\x09-\\x0D; only A-Z are lowered; null is the empty text.
    """
    texts = pc.fill_null(texts, "")  # as it is: ascii_lower() misreads a slice that was cast to large_string
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.split_pattern_regex(texts, r"[ \t\n\x0b\f\r]+")
    coded = split.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    dictionary = coded.dictionary.to_pylist()
    if "" in dictionary:
        real = codes != dictionary.index("")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, dictionary


def fixed(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def groups(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The rows of each value of column ``key`` of a partition that is sorted by it."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        values = rows.column(key)
        at = [0, *(np.flatnonzero(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy()) + 1)] if carry is None or values[0] != values[-1] else [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield rows.slice(a, b - a)
        carry = rows.slice(at[-1])
    if carry is not None:
        yield carry
