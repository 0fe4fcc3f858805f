"""Positional Burrows-Wheeler order of haplotypes.

Before each site haplotypes stand in the order of their earlier alleles, the last site first; ties keep the original order.
Blocks, groups and archetypes have orders of their own. The recurrence is sequential in the sites of one such key and
parallel over keys: rows are dealt by key, sorted by site, and streamed with one permutation as state, so memory is one
permutation and not the matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hapframe.operators.vectors import byte_views, cells, slices
from hapframe.schema import RARE


def advance(order: np.ndarray, permuted: np.ndarray) -> np.ndarray:
    """Stable partition of the order by the symbols that stand in it."""
    return order[np.argsort(permuted, kind="stable")]


class Orders:
    """The order of the current key, one for each of ``stride`` lanes; sites come sorted by key and id."""

    def __init__(self, stride: int = 1):
        self.stride, self.key, self.orders = stride, None, []

    def step(self, key: tuple, kind: str, gt: np.ndarray, inverse: bool = False) -> np.ndarray:
        """The vector in the order before its site (or back from it); the order then moves on."""
        if key != self.key:
            self.key, self.orders = key, [np.arange(len(gt[k :: self.stride])) for k in range(self.stride)]
        made, moves = np.empty(len(gt), np.uint8), kind != "2mc" or np.count_nonzero(gt == 1) >= RARE
        for k, order in enumerate(self.orders):
            lane, own = gt[k :: self.stride], made[k :: self.stride]
            if inverse:
                seen = lane
                own[order] = lane
            else:
                seen = own[:] = lane[order]
            if moves:
                self.orders[k] = advance(order, seen)
        return made


def keys(reset: bool) -> list[str]:
    return (["block_id"] if reset else []) + ["group_id", "archetype"]


def dealt(sites: DataFrame, by: list[str]) -> DataFrame:
    """Sites of a key in one task, in their order."""
    return sites.repartition(*by).sortWithinPartitions(*by, "site_id")


def keyed(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, str]]:
    """(key, archetype) of each row."""
    yield from zip(zip(*(batch.column(k).to_pylist() for k in by), strict=True), batch.column("archetype").to_pylist(), strict=True)


def _stream(sites: DataFrame, by: list[str], inverse: bool, stride: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(stride)
        for batch in (part for whole in batches for part in slices(whole)):
            made = [orders.step(key, kind, gt, inverse).tobytes() for (key, kind), gt in zip(keyed(batch, by), byte_views(batch.column("gt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], batch.schema.names)

    ready = dealt(sites, by).select(*(c for c in sites.columns if c != "gt"), "gt")
    return ready.mapInArrow(run, ready.schema)


def permute(sites: DataFrame, *, reset: bool = True, stride: int = 1) -> DataFrame:
    """``gt`` in the order before each site. ``stride`` keeps one order for each haplotype of an individual."""
    return _stream(sites, keys(reset), False, stride)


def restore(sites: DataFrame, *, reset: bool = True, stride: int = 1) -> DataFrame:
    """The inverse of ``permute``."""
    return _stream(sites, keys(reset), True, stride)


def order_texts(sites: DataFrame, *, reset: bool = True) -> DataFrame:
    """``site_id, order``: the haplotypes as they stand before each site, comma-separated."""
    by = keys(reset)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders()
        for batch in batches:
            out = []
            for (key, kind), data in zip(keyed(batch, by), batch.column("gt").to_pylist(), strict=True):
                gt = np.frombuffer(data, np.uint8)
                before = orders.orders[0] if orders.key == key else np.arange(len(gt))
                out.append(",".join(map(str, before.tolist())))
                orders.step(key, kind, gt)
            yield pa.RecordBatch.from_arrays([batch.column("site_id"), pa.array(out, pa.string())], ["site_id", "order"])

    return dealt(sites, by).select(*by, "site_id", "gt").mapInArrow(run, "site_id int, order string")


def explode_vectors(sites: DataFrame, position: str = "hap") -> DataFrame:
    """One row an allele."""
    return cells(sites, position)
