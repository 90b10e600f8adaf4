"""Shuffle of many small rows as packed columns: key blocks.

Rows (key, columns...) of a record batch are packed, per block of keys, into one row of binary
columns; a block gathers the parts of all tasks and numpy sorts them.  A task sends a key at most
once per batch into its block (``first``) and passes its other rows of that key by, marked: so a
block's rows of one key are bounded by the number of batches and no hot key is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import give_back
from spanwise.llm.textgrams import mix


def pack(key: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """One batch's rows; the first row of each key goes to the key's block, the rest pass by."""
    if not len(key):
        return None
    order = np.argsort(key, kind="stable")
    columns = {"key": key[order], **{c: x[order] for c, x in columns.items()}}
    key = columns["key"]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    columns["shared"] = ~(first & np.concatenate((first[1:], [True])))
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    out: dict[str, list] = {"bucket": [], "aside": [], **{c: [] for c in columns}}
    for aside, rows in ((False, np.flatnonzero(first)), (True, np.flatnonzero(~first))):
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(bucket[rows])) + 1) if len(rows) else []:
            out["bucket"].append(int(bucket[part[0]]))
            out["aside"].append(aside)
            for c, x in columns.items():
                out[c].append(x[part].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("aside", pa.bool_())] + [(c, pa.binary()) for c in columns]))


def in_blocks(df: DataFrame, make: Callable, types: dict[str, type], buckets: int, finish: Callable, schema: str) -> DataFrame:
    """``make(batch)`` yields (key, columns) of a record batch, all of them numpy arrays;
    ``finish(key, columns, shared, aside)`` gets the rows that passed by (aside, as they come) and
    each block's rows sorted by key, and yields record batches of ``schema``."""

    def send(batches):
        for batch in batches:
            for key, columns in make(batch):
                if (out := pack(key, columns, buckets)) is not None:
                    yield out

    def receive(batches):
        kinds = {"key": np.uint64, **types, "shared": bool}
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for r in batch.to_pylist():
                part = {c: np.frombuffer(r[c], dtype=t) for c, t in kinds.items()}
                if r["aside"]:
                    yield from finish(part.pop("key"), part, part.pop("shared"), True)
                else:
                    held.append(list(part.values()))
        if held:
            part = dict(zip(kinds, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
            held.clear()
            order = np.argsort(part["key"], kind="stable")
            part = {c: x[order] for c, x in part.items()}
            yield from finish(part.pop("key"), part, part.pop("shared"), False)
            del part, order
        give_back()

    sent = "bucket long, aside boolean, key binary, " + "".join(f"{c} binary, " for c in types) + "shared binary"
    return df.mapInArrow(send, sent).repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(receive, schema)


def repeated(key: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Mask of a block's rows whose key occurs more than once in the data."""
    same = key[1:] == key[:-1]
    return shared | np.concatenate(([False], same)) | np.concatenate((same, [False]))
