"""SentencePiece BPE encoding with the place of every piece in the original bytes, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.bpe import concatenated
from newsloom.llm.common import read_table, small_batches

#: The sign for a space within pieces, and what the unknown piece decodes to (fixed values).
SPACE_SIGN, UNKNOWN_SURFACE = "▁", " ⁇ "
#: Types of pieces (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters beyond which a chunk is merged by a heap and not kept in the memo.
LONG = 64
#: Entries of a worker's memo of chunks; beyond them it becomes the older one, which is asked next, and a new one starts.
MEMO = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a serialised protocol message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: a double array over the sources' UTF-8 bytes, then their replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.memo: dict[int, str] = {}

    def longest(self, data: bytes, start: int) -> tuple[int, str] | None:
        """Length and replacement of the longest prefix of data[start:] that the map holds."""
        if not self.units:
            return None
        units, at, found = self.units, 0, None
        at ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(start, len(data)):
            at ^= data[i]
            if at >= len(units):
                break
            unit = units[at]
            if unit & 0x800000FF != data[i]:
                break
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - start, units[at] & 0x7FFFFFFF
        if found is None:
            return None
        length, place = found
        if place not in self.memo:
            self.memo[place] = self.texts[place : self.texts.index(b"\0", place)].decode()
        return length, self.memo[place]


class PieceModel:
    """Normaliser, encoder and decoder of one model file.

    Encoding: the longest prefixes that the character map holds are replaced and the rest is kept character by character, while the
    place that each character came from is recorded; then neighbours of the best score are merged, leftmost first. Chunks between
    which no piece of the vocabulary reaches are merged apart, since neither can change the other.
    Decoding: pieces are concatenated, runs of byte pieces are read as UTF-8, the leading space sign that the normaliser put is taken away.
    """

    def __init__(self, data: bytes):
        pieces, spec = [], {1: b"identity"}
        kind, fallback, self.unknown_surface, suffix = 1, False, UNKNOWN_SURFACE, 0
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, fallback, suffix = trainer.get(3, 1), bool(trainer.get(35, 0)), trainer.get(24, 0)
                self.unknown_surface = trainer[44].decode() if 44 in trainer else UNKNOWN_SURFACE
            elif number == 3:
                spec = dict(_fields(value))
        if kind != 2 or suffix or any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
            raise ValueError("only BPE models with a prefix space sign and without user-defined or unused pieces are supported")
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.map = CharacterMap(spec.get(2, b""))
        self.pieces, self.types = [p for p, _, _ in pieces], [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        order = {s: k for k, s in enumerate(sorted({s for _, s, t in pieces if t == NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, s, t in pieces if t == NORMAL}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        of_byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.of_byte = [of_byte[b] for b in range(256)] if fallback and len(of_byte) == 256 else None
        self.byte_of = {i: b for b, i in of_byte.items()}
        self.surface = [self._surface(i) for i in range(len(pieces))]
        self.chunks = self._splitter()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.widths = np.array([1 if t == BYTE else len(p) for p, t in zip(self.pieces, self.types)], np.int64)
        self.continues = np.array([0x80 <= self.byte_of.get(i, 0) < 0xC0 for i in range(len(pieces))])

    def _splitter(self):
        """Cuts normalised text where no piece of the vocabulary has such neighbours: between letters, digits, space signs and the rest
        if it keeps to that, else before runs of space signs if it keeps to that, else nowhere."""

        def kind(c: str) -> str:
            return "s" if c == SPACE_SIGN else "o" if c in odd or re.match(r"[\W_]", c) else "d" if re.match(r"\d", c) else "l"

        pairs, odd = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}, ""
        odd = "".join(sorted({a if kind(a) == "l" else b for a, b in pairs if {kind(a), kind(b)} == {"l", "o"}}))  # superscripts, say
        met = {kind(a) + kind(b) for a, b in pairs}
        if met <= {"ss", "sl", "ll", "so", "oo"}:
            letter, rest = rf"[^\W\d_{re.escape(odd)}]", rf"(?:(?!{SPACE_SIGN})[\W_{re.escape(odd)}])"
            return re.compile(rf"{SPACE_SIGN}*{letter}+|{SPACE_SIGN}*{rest}+|{SPACE_SIGN}*\d|{SPACE_SIGN}+", re.DOTALL).findall
        if not met & {"ls", "ds", "os"}:
            return re.compile(f"{SPACE_SIGN}*[^{SPACE_SIGN}]+|{SPACE_SIGN}+", re.DOTALL).findall
        return lambda text: [text] if text else []

    def _surface(self, i: int) -> bytes:
        """A piece's text; a byte piece's byte. Control pieces have a byte that no text has, since they part runs of byte pieces."""
        if self.types[i] in (CONTROL, BYTE):
            return bytes([self.byte_of[i]]) if self.types[i] == BYTE else b"\xff"
        return (self.unknown_surface if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE_SIGN, " ")).encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte of the original UTF-8 text that it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            starts = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) if not text.isascii() else np.arange(len(text))
            source = np.append(starts, len(text.encode()) if not text.isascii() else len(text))
            plain = text.replace(" ", SPACE_SIGN)
            return (SPACE_SIGN + plain, np.append(0, source)) if self.dummy else (plain, source)
        return self._normalise_mapped(text)

    def _prefix(self, data: bytes, i: int) -> tuple[int, str]:
        found = self.map.longest(data, i)
        if found:
            return found
        n = 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
        return n, data[i : i + n].decode()

    def _normalise_mapped(self, text: str) -> tuple[str, np.ndarray]:
        data, i = text.encode(), 0
        if self.squeeze:  # leading spaces go
            while i < len(data):
                n, found = self._prefix(data, i)
                if found != " ":
                    break
                i += n
            if i == len(data):
                return "", np.array([i])
        out, source = [], []
        sign = SPACE_SIGN if self.escape else " "
        if self.dummy:
            out, source = [sign], [i]
        after_space = self.squeeze
        while i < len(data):
            n, found = self._prefix(data, i)
            if after_space:
                found = found.lstrip(" ")
            if found:
                out += found.replace(" ", sign)
                source += [i] * len(found)
                after_space = found.endswith(" ")
            i += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:  # trailing ones too
            while out and out[-1] == sign:
                out.pop()
                i = source.pop()
        return "".join(out), np.array([*source, i])

    def merge(self, chunk: str) -> list[str]:
        """The definition: merge the pair of best score, leftmost first, until no pair is a piece."""
        if len(chunk) > LONG:
            return self._merge_long(chunk)
        rank, none = self.rank, len(self.pieces)
        parts = list(chunk)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
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
        return parts

    def _merge_long(self, chunk: str) -> list[str]:
        """merge() by a heap of (rank, start, end), in n log n."""
        n, rank = len(chunk), self.rank
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if (j := ends[i]) < n and (r := rank.get(chunk[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(chunk[i : ends[i]])
            i = ends[i]
        return out

    def pack(self, chunk: str) -> bytes:
        """A chunk's ids as 32-bit numbers."""
        found = self.older.get(chunk)
        if found is None:
            ids = []
            for part in self.merge(chunk):
                i = self.ids.get(part)
                if i is not None:
                    ids.append(i)
                elif self.of_byte:
                    ids += [self.of_byte[b] for b in part.encode()]
                else:
                    ids += [self.unknown] * len(part)
            found = array("i", ids).tobytes()
        if len(chunk) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[chunk] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and the first and the last byte (exclusive) of each in it. Of a character that falls back to bytes, the
        piece of the last byte covers it; neighbouring unknown pieces are one."""
        plain, source = self.normalise(text)
        parts = []
        for chunks in _portions(self.chunks(plain)):
            get, pack = self.memo.get, self.pack
            parts += [get(c) or pack(c) for c in chunks]
        ids = np.frombuffer(concatenated(parts), "<i4")
        if not len(ids):
            return ids, source[:0], source[:0]
        widths = self.widths[ids]
        if self.of_byte:
            widths[:-1][self.continues[ids[1:]]] = 0
        else:
            widths[ids == self.unknown] = 1
        ends = np.cumsum(widths)
        begins = ends - widths
        if not self.of_byte:
            again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            first, last = np.append(True, ~again), np.append(~again, True)
            return ids[first], source[begins[first]], source[ends[last]]
        return ids, source[begins], source[ends]

    def plain(self, ids: Sequence[int]) -> bytes:
        """The concatenated pieces. In a run of byte pieces every byte that is no part of a UTF-8 character becomes U+FFFD; a run that
        is whole reads as part of the whole."""
        raw = concatenated(list(map(self.surface.__getitem__, ids)))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            out = []
            for kind, run in groupby(ids, self.types.__getitem__):
                text = b"" if kind == CONTROL else concatenated([self.surface[i] for i in run])
                out.append(_readable(text) if kind == BYTE else text)
            return concatenated(out)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The text of ids in UTF-8. The first piece that gives any text loses its leading space sign, or all of them where the
        normaliser squeezes spaces."""
        k = 0
        while k < len(ids) and self.types[ids[k]] == CONTROL:
            k += 1
        head = b""
        if k < len(ids) and self.types[ids[k]] == NORMAL and (self.dummy or self.squeeze):
            head = self.surface[ids[k]]
            while head.startswith(b" "):
                head = head[1:]
                if not self.squeeze:
                    break
            k += 1
            if not head:  # a piece without text: the next one is the first
                return self._after_empty(ids[k:])
        return head + self.plain(ids[k:])

    def _after_empty(self, ids: Sequence[int]) -> bytes:
        return self.decode(ids) if self.squeeze else self.plain(ids)


def _readable(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            n = 1 if run[i] < 128 else 2 if run[i] < 224 else 3 if run[i] < 240 else 4
            try:
                out.append(run[i : i + n].decode().encode())
                i += n
            except UnicodeDecodeError:
                out.append("�".encode())
                i += 1
        return b"".join(out)


def _portions(chunks: list[str]) -> Iterator[list[str]]:
    """Parts after which the memo may have changed hands."""
    return (chunks[i : i + MEMO] for i in range(0, len(chunks), MEMO))


def _model(spark: SparkSession, path: str | None):
    """The model file is read on the driver and broadcast: it is as large as the vocabulary, whatever the corpus."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    return lambda: PieceModel(data.value)


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode(docs: DataFrame, path: str | None = None, column: str = "text", ids: str = "ids", begins: str = "begins", ends: str = "ends", decoded: str | None = None) -> DataFrame:
    """docs with `ids`, `begins` and `ends` (array<int>) of every whole text: the pieces, and the bytes of the text's UTF-8 form that each
    came from, end exclusive; the sign that the normaliser puts first covers none. With `decoded` (string), also what the ids decode to.

    Null texts are empty and have no ids. Rows are independent: nothing is shuffled, any partition can be made again, and memory is
    bounded by a batch of texts; very long ones are encoded whole. Other columns, repeated rows and empty tables go through unchanged;
    columns of docs that have the new names are replaced. Offsets are 32-bit, as lengths of texts in Arrow are.
    """
    docs = docs.drop(*[c for c in (ids, begins, ends, decoded) if c])
    small_batches(docs.sparkSession)
    model, own = _model(docs.sparkSession, path), len(docs.columns)
    names = [ids, begins, ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model()
        for batch in batches:
            offsets, columns, back = [0], ([], [], []), []
            for t in batch.column(batch.schema.get_field_index(column)):
                found = coder.encode(t.as_py() or "")
                for kept, part in zip(columns, found):
                    kept.append(part.astype(np.int32, copy=False))
                offsets.append(offsets[-1] + len(found[0]))
                if decoded:
                    back.append(coder.decode(found[0].tolist()))
            flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int32), pa.int32()) for c in columns]
            arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), f) for f in flat]
            if decoded:
                arrays.append(pa.array(back, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *arrays], names=[*batch.schema.names[:own], *names, *([decoded] if decoded else [])])

    added = ", ".join(f"`{n}` array<int>" for n in names) + (f", `{decoded}` string" if decoded else "")
    return docs.mapInArrow(run, _schema(docs) + added)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with `decoded` (string): the text of the ids. Null ids give an empty text; a column of that name is replaced."""
    df = df.drop(decoded)
    small_batches(df.sparkSession)
    model, own = _model(df.sparkSession, path), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model()
        for batch in batches:
            texts = [coder.decode(x.as_py() or ()).decode() for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(texts, pa.string())], names=[*batch.schema.names[:own], decoded])

    return df.mapInArrow(run, f"{_schema(df)}`{decoded}` string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encode() and of what its ids decode to, for every row of documents; covered_bytes counts the bytes that pieces came
    from, which are all of a text's where its normaliser drops none."""
    out = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.when(F.size("ids") > 0, F.element_at("ends", -1) - F.element_at("begins", 1)).otherwise(0).cast("long").alias("covered_bytes"),
    )
