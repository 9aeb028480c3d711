"""Columns of hashes and places packed as one row a bucket.

Rows of a block of documents travel as a few long binary values instead of one
Spark row each.  Values are laid out byte by byte over all rows, so that the
shuffle's compression finds the equal high bytes of sorted values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


PACKED = "bucket int, kind int, x binary, y binary, doc binary, place binary, n binary"
FOUND = "kind int, doc_id long, place long, n long, shard long"
SEGMENT, WINDOW, SPAN = 0, 1, 2


def first_of_equal(x: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lead, first): rows by (x, y, doc, place); lead of a group, and the index of the lead for each."""
    order = np.lexsort((place, doc, y, x))
    x, y = x[order], y[order]
    lead = np.ones(len(x), bool)
    lead[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, lead, np.maximum.accumulate(np.where(lead, np.arange(len(x)), 0))


def strung(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first place, how many) of stretches of neighbouring places."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], place[first], np.diff(np.append(first, len(doc)))


def packed_rows(bucket: np.ndarray, kind: int, x: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """One packed row a bucket; columns stay in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), kind, planes(x[part]), planes(y[part]), planes(doc[part]), planes(place[part].astype(np.int64)), planes(n[part].astype(np.int32))


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "kind", "x", "y", "doc", "place", "n"])


def deal(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> np.uint64(32)).astype(np.int64) * parts >> 32).astype(np.int32)


def found(kind: int, doc: np.ndarray, place: np.ndarray, n: np.ndarray, shard: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int32), "doc_id": doc, "place": place, "n": n.astype(np.int64), "shard": np.broadcast_to(np.asarray(shard, np.int64), doc.shape)})


def column(rows: pd.DataFrame, name: str, dtype: str) -> np.ndarray:
    """A packed column of several rows as one array."""
    return np.concatenate([unplanes(v, dtype) for v in rows[name]]) if len(rows) else np.zeros(0, dtype)
