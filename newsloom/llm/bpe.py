"""Byte-level BPE as a tree of joins: halves are encoded apart and neighbours joined by re-encoding a growing window."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import read_table, small_batches

#: Bytes up to which part of a piece is merged directly; longer ones are halved.
LEAF = 16
#: Parts of a text that are concatenated at once at the leaves of its tree.
FAN = 256
#: Bytes beyond which windows are merged by a heap, and characters beyond which a piece isn't kept in the memo.
LONG = 128
#: Entries of a task's memos of pieces and of token pairs; they start anew beyond them. A task of some 25 MB of text has 400,000 different pieces, and
#: what a smaller memo loses costs most of its time.
MEMO, PAIRS = 500_000, 200_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a tiktoken rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def concatenated(parts: list[bytes]) -> bytes:
    """The parts' bytes, FAN parts at a time up the tree."""
    while len(parts) > FAN:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return b"".join(parts)


class Codec:
    """Encodes pieces of text and decodes ids.

    A sequence of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of theirs. So two
    encoded halves are joined by re-encoding the last and first k tokens: the result stands once the window's ends fit the
    tokens outside, else k doubles. With k past both halves the whole is encoded anew, so a join always ends.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.packed: dict[str, tuple[bytes, bytes]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none has a rank."""
        rank = self.rank
        if data in rank:
            return [rank[data]]
        if len(data) > LONG:
            return self.merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.tokens)
        ranks = [rank.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """merge() by a heap of (rank, start, length), for windows of runs that never stabilise."""
        n, rank = len(data), self.rank
        ends = list(range(1, n + 1))  # end of the part at each start; 0 once it is part of another
        before = list(range(-1, n - 1))

        def pair(i: int) -> None:
            if (j := ends[i]) < n and (r := rank.get(data[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            pair(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : ends[i]]])
            i = ends[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return found

    def fits(self, a: int, b: int) -> bool:
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        window, k = self.pair(left[-1], right[0]), 1
        if window == [left[-1], right[0]]:
            return left + right
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2
            window = self.merge(self.decode(left[max(0, len(left) - k) :] + right[:k]))

    def tree(self, data: bytes) -> list[int]:
        known = self.rank.get(data)
        if known is not None:
            return [known]
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            ids = self.tree(text.encode())
            if len(text) <= LONG:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Pieces of the pattern never merge with each other, so their join is concatenation."""
        out: list[int] = []
        for p in self.split(text):
            out += self.piece(p)
        return out

    def pack(self, text: str) -> tuple[bytes, bytes]:
        """A piece's ids as 32-bit numbers, and the bytes that they decode to."""
        ids = self.tree(text.encode())
        found = struct.pack(f"<{len(ids)}i", *ids), self.decode(ids)
        if len(text) <= LONG:
            if len(self.packed) >= MEMO:
                self.packed.clear()
            self.packed[text] = found
        return found

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded bytes of a text. Pieces never merge with each other, so up the tree both are concatenated."""
        get, pack = self.packed.get, self.pack
        parts = [get(p) or pack(p) for p in self.split(text)]
        return concatenated([a for a, _ in parts]), concatenated([b for _, b in parts])

    def decode(self, ids: Sequence[int]) -> bytes:
        return concatenated(list(map(self.tokens.__getitem__, ids)))


def _codec(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank table is read on the driver and broadcast: it is as large as the vocabulary, whatever the corpus."""
    import public_tokenizers

    tokens = spark.sparkContext.broadcast(load_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    pattern = pattern or public_tokenizers.PATTERN
    return lambda: Codec(tokens.value, pattern)


def _mapped(docs: DataFrame, column: str, schema: str, each) -> DataFrame:
    """docs with the columns of `schema` after its own, made by each(values) -> arrays, in batches of rows."""
    small_batches(docs.sparkSession)
    own = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            arrays, fields = work(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *arrays], names=[*batch.schema.names[:own], *fields])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, {schema}")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `ids` (array<int>) of every whole text, and with `decoded` (binary) made from these ids if it is named.

    Null texts are empty and have no ids. Rows are independent: nothing is shuffled and any partition can be made again. Memory
    is bounded by a batch of texts; very long ones are encoded whole. The other columns, repeated rows and empty tables go through
    unchanged; columns of docs that have the new names are replaced.
    """
    docs = docs.drop(*[c for c in (ids, decoded) if c])
    codec = _codec(docs.sparkSession, path, pattern)

    def each():
        own = codec()

        def work(texts: pa.Array):
            offsets, parts, back = [0], [], []
            for t in texts:
                packed, data = own.round_trip(t.as_py() or "")
                parts.append(packed)
                offsets.append(offsets[-1] + len(packed) // 4)
                back.append(data)
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
            return (arrays + [pa.array(back, pa.binary())], [ids, decoded]) if decoded else (arrays, [ids])

        return work

    return _mapped(docs, column, f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else ""), each)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with `decoded` (binary): the tokens' bytes, concatenated. Null ids give empty bytes; a column of that name is replaced."""
    df = df.drop(decoded)
    codec = _codec(df.sparkSession, path, None)

    def each():
        own = codec()
        return lambda found: ([pa.array([own.decode(x.as_py() or ()) for x in found], pa.binary())], [decoded])

    return _mapped(df, ids, f"`{decoded}` binary", each)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encode() and of what its ids decode to, for every row of documents."""
    out = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
