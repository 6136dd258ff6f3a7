"""Nearest vectors by cosine, all queries against all rows, as products of blocks: the work is quadratic, a task's memory is two blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most vectors of a block of rows and of a block of queries (parameters).
ROWS, QUERIES = 4096, 512


def _packed(vectors: DataFrame, most: int, prefix: str) -> DataFrame:
    """Blocks of at most `most` vectors of a length: ids, entries. Those that are null or hold a null have length -1 and no entries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, parts = held.pop(d)
            entries = np.concatenate(parts).tobytes() if parts else b""
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([d], pa.int32()), pa.array([entries], pa.binary())], names=names)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = v.is_valid and v.values.null_count == 0
                d = len(v.values) if whole else -1
                ids, parts = held.setdefault(d, ([], []))
                ids.append(i)
                if whole:
                    parts.append(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if len(ids) >= most:
                    yield block(d)
        for d in list(held):
            yield block(d)

    names = [f"{prefix}_{x}" for x in ("ids", "length", "entries")]
    return vectors.select("vec_id", "embedding").mapInArrow(pack, f"{names[0]} array<long>, {names[1]} int, {names[2]} binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity to six digits, rn) of the k nearest vectors of each query, other ids only; ties by id. Vectors are
    (vec_id, embedding). The similarity of a vector that is null, holds a null or has another length is null and comes last;
    that of one without a length is NaN and, as NaN is the largest, comes first."""
    parts = max(1, -(-queries.count() // QUERIES))
    pairs = _packed(vectors, ROWS, "e").crossJoin(_packed(queries.repartition(parts), QUERIES, "q"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {name: b.column(name)[r].as_py() for name in b.schema.names}
                out = _best(x["q_ids"], x["q_length"], x["q_entries"], x["e_ids"], x["e_length"], x["e_entries"], k)
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "similarity"])

    found = pairs.mapInArrow(best, "query_id long, vec_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "vec_id"))
    return found.withColumn("rn", place).where(F.col("rn") <= k)


def _best(q_ids: list, q_length: int, q_entries: bytes, e_ids: list, e_length: int, e_entries: bytes, k: int) -> list[tuple]:
    """The k nearest of a block's vectors for each of a block's queries."""
    ids, out = np.array(e_ids, np.int64), []
    known = q_length == e_length and q_length > 0
    if known:
        q, e = (np.frombuffer(x, np.float64).reshape(-1, q_length) for x in (q_entries, e_entries))
        with np.errstate(all="ignore"):
            sims = np.round(q @ e.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(e, axis=1)), 6)
        sims[np.isnan(sims)] = np.inf
    for i, own in enumerate(q_ids):
        row = np.where(ids == own, -np.inf, sims[i]) if known else np.where(ids == own, -np.inf, 0.0)
        n = min(k, int((ids != own).sum()))
        if n:
            at = np.flatnonzero((row >= np.partition(row, len(row) - n)[len(row) - n]) & (ids != own))
            at = at[np.lexsort((ids[at], -row[at]))][:n]
            out += [(own, int(ids[j]), None if not known else float("nan") if np.isinf(row[j]) else float(row[j])) for j in at.tolist()]
    return out
