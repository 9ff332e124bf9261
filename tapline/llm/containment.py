"""Short test items inside long documents: size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of the item's
distinct five-word shingles occur in the document's set.

* Items and documents are partitioned by the size of their shingle sets.  An
  item can only be contained in documents of partitions whose upper size bound
  reaches the shingles it needs, so other partitions are never probed with it.
* An item's signature is the bottom of its MinHash order: its q - need + 1
  smallest shingle hashes, where ``need`` is the number of shingles a containing
  document must share.  By the pigeonhole principle every containing document
  holds at least one of them, so no leak is lost however long the document is.
  (A fixed number of MinHash bands would be blind here: an item of 30 shingles
  in a document of 10,000 has a Jaccard similarity of 0.003.)
* Candidates are verified by exact containment of the full shingle sets, in the
  task that holds the document: the search needs no shuffle at all.

Items are a query set.  They are sent to the tasks in blocks whose size is
checked (``BLOCK_SHINGLES``), one pass over the documents per block, so any
number of items works.  Very frequent shingles cost at most a verification.

Rows: a null or empty document contains nothing; an item without words is
contained in nothing; an item of fewer than five words is one shingle (its
whole sequence), found only as a whole text; repeated items and documents are
reported as often as they occur; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcols as T

#: Shingles of the items that one broadcast block may hold (16 bytes each).
BLOCK_SHINGLES = 4_000_000
#: Size partitions double: partition p holds sets of 2**p to 2**(p+1) - 1 shingles.
SHINGLE_WORDS, THRESHOLD = 5, 0.75


def size_partition(n: np.ndarray) -> np.ndarray:
    """Index of the size partition; empty sets get -1."""
    return np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), -1)


class ItemIndex:
    """MinHash signatures and full sets of a block of items, grouped by size partition."""

    def __init__(self, ids: list, flat: np.ndarray, offs: np.ndarray, threshold: float):
        self.ids, self.flat, self.offs = ids, flat, offs
        self.size = np.diff(offs)
        self.need = np.maximum(1, np.ceil(threshold * self.size - 1e-9).astype(np.int64))
        part = size_partition(self.size)
        #: per item partition: (least shingles needed by its items, sorted signature hashes, their items)
        self.classes = []
        for p in np.unique(part[part >= 0]):
            members = np.flatnonzero(part == p)
            keys = [flat[offs[i]:offs[i] + self.size[i] - self.need[i] + 1] for i in members]  # sets are sorted: the smallest
            owner = np.repeat(members, [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self.classes.append((int(self.need[members].min()), keys[order], owner[order]))

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of all items contained in a sorted distinct set."""
        if len(shingles) == 0:
            return []
        upper = (2 << int(size_partition(np.array([len(shingles)]))[0])) - 1
        out = []
        for need, keys, owner in self.classes:
            if upper < need:
                continue
            lo = np.searchsorted(keys, shingles, side="left")
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == shingles))
            if not len(hit):
                continue
            hi = np.searchsorted(keys, shingles[hit], side="right")
            items = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo[hit], hi)]))
            for i in items.tolist():
                full = self.flat[self.offs[i]:self.offs[i + 1]]
                at = np.minimum(np.searchsorted(shingles, full), len(shingles) - 1)
                shared = int(np.count_nonzero(shingles[at] == full))
                if shared >= self.need[i]:
                    out.append((i, shared))
        return out


def item_blocks(items: DataFrame, id_column: str, text_column: str, threshold: float, k: int) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size; the driver holds one block's texts at a time."""
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for row in items.select(id_column, text_column).orderBy(id_column, text_column).toLocalIterator():
        flat, _ = T.shingle_sets(pa.array([row[1]], pa.string()), k)
        if held and held + len(flat) > BLOCK_SHINGLES:
            yield ItemIndex(ids, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), threshold)
            ids, sets, held = [], [], 0
        ids.append(row[0])
        sets.append(flat)
        held += len(flat)
    if ids:
        yield ItemIndex(ids, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), threshold)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS,
          id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All leaks: (doc_id, item_id, n_shared, n_item) with n_shared >= threshold * n_item."""
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    item_type = items.schema[item_id].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, n_shared long, n_item long"
    source = docs.select(id_column, text_column)
    out = None
    for block in item_blocks(items, item_id, item_text, threshold, k):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                rows, found, shared = [], [], []
                for lo, hi in T.steps(batch.column(1)):
                    flat, offs = T.shingle_sets(batch.column(1).slice(lo, hi - lo), k)
                    for r in range(hi - lo):
                        for item, n in index.search(flat[offs[r]:offs[r + 1]]):
                            rows.append(lo + r)
                            found.append(item)
                            shared.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[i] for i in found], batch_type(item_type)),
                     pa.array(shared, pa.int64()), pa.array([int(index.size[i]) for i in found], pa.int64())],
                    names=["doc_id", "item_id", "n_shared", "n_item"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def batch_type(spark_type) -> pa.DataType:
    """Arrow type of an id column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS,
          text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that contain no item, with all their columns; a filter inside the scan, without a join or shuffle."""
    at, schema = docs.columns.index(text_column), docs.schema
    for block in item_blocks(items, item_id, item_text, threshold, k):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, hi in T.steps(batch.column(at)):
                    flat, offs = T.shingle_sets(batch.column(at).slice(lo, hi - lo), k)
                    for r in range(hi - lo):
                        keep[lo + r] = not shipped.value.search(flat[offs[r]:offs[r + 1]])
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
