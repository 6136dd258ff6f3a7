"""N-gram Jaccard join: prefix filters under several global token orders, intersected before exact verification.

Shingles are 64-bit hashes of five words. Under any global order of the tokens, two sets of Jaccard similarity t or more share a
token among the first n - ceil(t n) + 1 of each, and so many that what stands after the prefix that ends first can make up the
needed overlap. The first order puts the corpus's heavy tokens last and is the index: postings (token, set) meet by token. Each
set also carries a sketch, its prefixes under the further orders. A pair is a candidate if its prefixes share enough under the
first order and under every other one; only then are the two texts fetched and compared exactly.

Groups of copies never become all pairs. Equal texts are one class before anything else. A first round compares each set with
the one that leads most of its posting lists. What one component then holds is not compared again: only
members of different components whose sizes and places in the list allow a link are, in lists of a bounded length all at once, in
longer ones a bounded number of leaders against the list a round. No step holds a list in one task: postings of heavy tokens are
salted, what is known of a list as a whole is aggregated and joined back, and the pairs of a class that meets many are dealt in parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import Scratch, broadcast_if, read_table, small_batches, small_messages
from newsloom.llm.features import mix

#: Words of a shingle; similarity, as a fraction, of which pairs link.
WORDS, NUM, DEN = 5, 4, 5
#: Further token orders under which prefixes must meet.
ORDERS = (11, 12)
#: Counters of hashed tokens. Their sums over all documents tell which tokens are heavy; they bound memory and the broadcast.
#: Results are the same for any counts.
COUNTERS, CHUNKS = 1 << 22, 64
#: Texts that a task remembers in order to give a copy's sketch and postings once.
MOST_MET = 1_000_000
#: Posting lists up to this length are compared pair by pair; of longer ones, so many leaders a round.
LIST = 1024
#: Tokens counted 2^HOT times beyond chance or oftener are dealt by token and salt, each salt about so many postings.
HOT = 12
#: Classes up to which those whose texts a round needs are broadcast; beyond it the join is shuffled.
MOST_BROADCAST = 200_000
#: A class of more candidate pairs than this is compared in parts.
PAIRS = 64


def prefix_length(n):
    """n - ceil(t n) + 1, for ints, arrays and columns of longs."""
    return n - (n * NUM + DEN - 1) // DEN + 1


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of all words as one if there are fewer than WORDS."""
    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    if len(h) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 1)], np.uint64)
    out = h[: len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        out = mix(out, k) ^ h[k : len(h) - WORDS + 1 + k]
    return np.unique(mix(out, WORDS))


def prefix(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first tokens in the index's order: by the class of their frequency, then by hash."""
    p = prefix_length(len(tokens))
    own = classes[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return tokens[np.argsort(own, kind="stable")[:p]] if own.any() else tokens[:p]


def sketch(tokens: np.ndarray) -> bytes:
    """The upper halves of the first tokens under each further order, ascending, one order after the other."""
    p = prefix_length(len(tokens))
    orders = [np.sort(np.partition(mix(tokens, seed), p - 1)[:p]) >> np.uint64(32) for seed in ORDERS]
    return np.concatenate(orders).astype("<u4").tobytes()


def may_meet(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Under every further order the prefixes of sets of n and m tokens share enough for a link. Shared tokens up to the end of the
    prefix that ends first stand in both prefixes; after it, that set has no more than its rest. Upper halves of hashes may be
    equal by chance, which only lets more pairs pass."""
    needed = -(-NUM * (n + m) // (NUM + DEN))
    for x, y in zip(np.split(np.frombuffer(a, "<u4"), len(ORDERS)), np.split(np.frombuffer(b, "<u4"), len(ORDERS)), strict=True):
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        rest = n - len(x) if x[-1] < y[-1] else m - len(y) if y[-1] < x[-1] else max(n - len(x), m - len(y))
        if shared + rest < needed:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The Jaccard similarity is at least NUM / DEN."""
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= NUM * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signature(text: str) -> tuple[int, int]:
    """128 bits of the words, which equal texts and texts that differ in spaces or case share."""
    data = b" ".join(text.encode().lower().split())
    return xxhash.xxh64_intdigest(data, 2), xxhash.xxh64_intdigest(data, 3)


class Counts:
    """Counters of hashed tokens over all documents of a task, each up to 255."""

    def __init__(self):
        self.counts, self.waiting, self.size = np.zeros(COUNTERS, np.uint8), [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size >= 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            at, n = np.unique((np.concatenate(self.waiting) & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
            self.counts[at] = np.minimum(self.counts[at] + n, 255)
            self.waiting, self.size = [], 0

    def chunks(self) -> list[bytes]:
        self.flush()
        return [zlib.compress(x.tobytes(), 1) for x in np.split(self.counts, CHUNKS)]


def scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: 0, a document with its text's hash h, its signature, set size and, where a task meets the text first, its
    sketch; 1, a chunk (n) of a task's counters, with the task's number in h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = Counts(), set()
        names = ["kind", "doc_id", "h", "sig", "sig2", "n", "data"]
        for b in batches:
            sizes, sigs, sketches = [], [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                tokens = shingles(t)
                counts.add(tokens)
                sizes.append(len(tokens))
                sigs.append(_signature(t))
                sketches.append(sketch(tokens) if len(tokens) and sigs[-1][0] not in met else None)
                if len(met) < MOST_MET:
                    met.add(sigs[-1][0])
            k = len(sizes)
            both = np.array(sigs, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), b.column("doc_id"), b.column("h"), _signed(both[:, 0].copy()), _signed(both[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=names
            )
        none, task = pa.nulls(CHUNKS, pa.int64()), pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(CHUNKS, np.int32)), none, task, none, none, pa.array(range(CHUNKS), pa.int64()), pa.array(counts.chunks(), pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, doc_id long, h long, sig long, sig2 long, n long, data binary")


def frequency_classes(chunks: DataFrame) -> np.ndarray:
    """A byte for each counter: 0 for what chance gives, else the logarithm of what exceeds it. chunks: (n, task, data) of all
    tasks. They are summed up a tree, 64 tasks at a time by chunk and then by chunk; the sums, COUNTERS numbers in all, come to the
    driver, which keeps them compressed and unpacks one chunk at a time: as arrays of doubles they take tens of megabytes each."""

    def summed(dtype: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for b in batches:
                for n, task, data in zip(b.column("n").to_pylist(), b.column("task").to_pylist(), b.column("data"), strict=True):
                    one = np.frombuffer(zlib.decompress(data.as_py()), dtype).astype(np.uint32)
                    sums[n, task] = sums[n, task] + one if (n, task) in sums else one
            keys = [pa.array([k[i] for k in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["n", "task", "data"])

        return run

    schema = "n long, task long, data binary"
    some = chunks.select("n", F.shiftright("task", 6).alias("task"), "data").repartition("n", "task").mapInArrow(summed(np.uint8), schema)
    all_ = some.select("n", F.lit(0).cast("long").alias("task"), "data").repartition("n").mapInArrow(summed(np.uint32), schema)
    step = COUNTERS // CHUNKS
    sums = {r.n: bytes(r.data) for r in all_.collect()}
    unpacked = lambda n: np.frombuffer(zlib.decompress(sums[n]), np.uint32)
    mean = sum(int(unpacked(n).sum()) for n in sums) / COUNTERS
    classes = np.zeros(COUNTERS, np.uint8)
    for n in sums:
        above = np.maximum(unpacked(n) - (mean + 4 * np.sqrt(mean) + 8), 0)
        classes[n * step : (n + 1) * step] = np.where(above > 0, 1 + np.log2(np.maximum(above, 1)), 0)
    return classes


def postings(docs: DataFrame, classes) -> DataFrame:
    """(token, salt, hot, sig, n, pos) for the prefix of every document's set; a task gives a text that it meets again only once. The
    postings of a heavy token (hot) have salts by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class, met = classes.value, set()
        for b in batches:
            found, sigs, sizes, places = [], [], [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                sig = _signature(t)[0]
                if sig in met:
                    continue
                if len(met) < MOST_MET:
                    met.add(sig)
                tokens = shingles(t)
                p = prefix(tokens, by_class)
                found.append(p)
                sigs.append(np.full(len(p), sig, np.uint64))
                sizes.append(np.full(len(p), len(tokens), np.int64))
                places.append(np.arange(len(p), dtype=np.int64))
            if found:
                token, sig = np.concatenate(found), np.concatenate(sigs)
                bits = np.maximum(by_class[(token & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64) - HOT, 0)
                salt = (mix(sig, 3) & np.uint64(0xFFFFFF)).astype(np.int64) & ((1 << bits) - 1)
                columns = [_signed(token), pa.array(salt), pa.array(bits > 0), _signed(sig), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "salt", "hot", "sig", "n", "pos"])

    return docs.mapInArrow(run, "token long, salt long, hot boolean, sig long, n long, pos long")


def may_link(shared: Column, n: Column, m: Column) -> Column:
    """The sizes allow the similarity, and so do the shared prefix tokens: of two sets, what stands after the prefix that ends
    first is all that can be shared besides."""
    rest = lambda x: F.floor((x * NUM + DEN - 1) / DEN) - 1
    needed = F.ceil(NUM * (n + m) / (NUM + DEN) - 1e-9)
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (shared + F.greatest(rest(n), rest(m)) >= needed)


def reaches(n: Column, pos: Column, m: Column) -> Column:
    """If two sets first meet in a token that stands at pos of n tokens, they share the n - pos from there at most; a partner of m
    tokens needs (n + m) t / (1 + t) of them."""
    return (NUM + DEN) * (n - pos) >= NUM * (n + m)


def meeting(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, n_a, n_b) whose prefixes share enough under all orders. prefixes: (sig, tokens, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [may_meet(x.as_py(), y.as_py(), n.as_py(), m.as_py()) for x, y, n, m in zip(*(b.column(c) for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(on, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    one = prefixes.select(F.col("sig").alias("a"), F.col("tokens").alias("tokens_a"), F.col("sketch").alias("sketch_a"))
    two = prefixes.select(F.col("sig").alias("b"), F.col("tokens").alias("tokens_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.where(may_link(F.size(F.array_intersect("tokens_a", "tokens_b")), F.col("n_a"), F.col("n_b")))
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def wanted_of(candidates: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sig, rep, h, parts) of the classes that the candidates name: one of their rows, and in how many parts to deal the pairs of
    each. A class of m pairs has about sqrt(m / PAIRS), so that neither a part nor the copies of its text pile up in a task.
    classes: (sig, rep, h), the id and text hash of one of its rows."""
    named = candidates.select(F.col("a").alias("sig")).union(candidates.select(F.col("b").alias("sig"))).groupBy("sig").count()
    parts = F.ceil(F.sqrt(F.col("count") / F.lit(PAIRS))).cast("int").alias("parts")
    return scratch.keep(named.join(classes, "sig").select("sig", "rep", "h", parts), f"{name}-wanted")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(sig, part, text) of the wanted classes, once for each part."""
    named = broadcast_if(wanted, wanted.count(), MOST_BROADCAST)
    found = docs.where("text is not null").join(named, docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["h"] == wanted["h"]))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return found.select("sig", parts, "text").dropDuplicates(["sig", "part"])


def dealt(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pairs with the parts part_a and part_b of their classes that hold them."""
    many = wanted.where("parts > 1")
    many = broadcast_if(many, many.count(), MOST_BROADCAST)
    for x, other in (("a", "b"), ("b", "a")):
        parts = many.select(F.col("sig").alias(x), "parts")
        part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
        pairs = pairs.join(parts, x, "left").withColumn(f"part_{x}", part).drop("parts")
    return pairs


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, part_a, part_b) that link, by their whole texts. texts: (sig, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def of(sig: int, text: pa.Scalar) -> np.ndarray:
            if sig not in memo:
                if len(memo) >= 256:
                    memo.clear()
                memo[sig] = shingles(text.as_py())
            return memo[sig]

        for b in batches:
            cols = [b.column(c) for c in ("a", "b", "text_a", "text_b")]
            on = [linked(of(x.as_py(), s), of(y.as_py(), t)) for x, y, s, t in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(on, pa.bool_())) for c in cols[:2]], names=["a", "b"])

    one = texts.select(F.col("sig").alias("a"), F.col("part").alias("part_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("sig").alias("b"), F.col("part").alias("part_b"), F.col("text").alias("text_b"))
    return pairs.join(one, ["a", "part_a"]).join(two, ["b", "part_b"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sig, comp): the least node of each node's component. Labels go along the edges and are then followed to their own labels,
    so that long chains shorten by half a round; each round is a table in the shared folder."""
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy(F.col("a").alias("sig")).agg(F.min("b").alias("b")).select("sig", F.least("sig", "b").alias("comp")), f"{name}-0")
    k = 0
    while True:
        # Both joins look up labels by sig, so one exchange serves them; a node's own label comes with its neighbours' in one grouping.
        of_node = labels.select(F.col("sig").alias("b"), F.col("comp").alias("near"))
        near = both.join(of_node, "b").select(F.col("a").alias("sig"), F.lit(None).cast("long").alias("old"), F.col("near").alias("comp"))
        step = labels.select("sig", F.col("comp").alias("old"), "comp").union(near).groupBy("sig").agg(F.max("old").alias("old"), F.min("comp").alias("comp"))
        jump = labels.select(F.col("sig").alias("comp"), F.col("comp").alias("further"))
        k += 1
        new = scratch.keep(step.join(jump, "comp", "left").select("sig", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), f"{name}-{k}")
        changed = new.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("sig", "comp")
        if not changed:
            scratch.drop(f"{name}-both")
            return labels


def leaders_of(lists: DataFrame) -> DataFrame:
    """(token, sig, no) of the first LIST members of each list, by place, in two steps: of each part first, so that neither holds
    more of a list of m members than about sqrt(m * LIST)."""
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.sqrt(F.col("members") / F.lit(LIST))))
    own = Window.partitionBy("token", "part").orderBy("pos", "sig")
    some = lists.withColumn("part", part).withColumn("no", F.row_number().over(own)).where(F.col("no") <= LIST)
    return some.withColumn("no", F.row_number().over(Window.partitionBy("token").orderBy("pos", "sig"))).where(F.col("no") <= LIST).select("token", "sig", "no")


def near_duplicates(docs: DataFrame, text_hash: str | None = None, group: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: the size of its set of shingles and the smallest doc_id that links
    of Jaccard similarity NUM / DEN or more reach.

    Null texts and texts without words have no shingles and link with nothing. Rows with a null doc_id are compared like others
    but cannot name a component. Repeated rows have equal results; rows that repeat a doc_id with other texts are compared each
    by its own text, and `text_hash` names a column with xxhash64(text) that tells them apart. `group` names a column that is equal
    for the rows of a component, whatever their ids, and null without shingles. An empty table gives none. Very long texts count
    whole; a batch of texts and their shingles is in memory. Other columns of docs are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    small_messages(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    seen = scratch.keep(scan(docs), "scan")
    own = seen.where("kind = 0").drop("kind", "data")
    # A class is known by one row: the least id, unless all are null, and of the rows that repeat it the least hash of a text.
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h"))
    classes_of_counts = spark.sparkContext.broadcast(frequency_classes(seen.where("kind = 1").select("n", F.col("h").alias("task"), "data")))
    classes = own.where("n > 0").groupBy("sig", "sig2").agg(least.alias("x"))
    classes = scratch.keep(classes.select("sig", "sig2", F.col("x.doc_id").alias("rep"), F.col("x.h").alias("h")), "classes")

    # Posting lists with two sets or more; those of heavy tokens are taken to have them.
    over = Window.partitionBy("token", "salt")
    lists = postings(docs.select("text"), classes_of_counts).withColumn("low", F.min("sig").over(over)).withColumn("high", F.max("sig").over(over))
    lists = lists.where("low <> high or hot").groupBy("token", "salt", "sig").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    lists = scratch.keep(lists.select("token", "sig", "n", "pos"), "lists")

    # A row of prefixes is as long as a text's own.
    sketches = seen.where("kind = 0 and data is not null").groupBy("sig").agg(F.first("data").alias("sketch"))
    prefixes = scratch.keep(lists.groupBy("sig").agg(F.collect_list("token").alias("tokens")).join(sketches, "sig"), "prefixes")

    # Members with the set that has the list's token earliest: those that share enough lists nearly all link. In a group of
    # copies that is the text with the fewest words of its own.
    low = lists.groupBy("token").agg(F.min(F.struct("pos", "sig", "n")).alias("low"))
    fits = reaches(F.col("n"), F.col("pos"), F.col("low.n")) & reaches(F.col("low.n"), F.col("low.pos"), F.col("n"))
    first = lists.join(low, "token").where((F.col("low.sig") != F.col("sig")) & fits)
    first = first.groupBy(F.col("sig").alias("b"), F.col("low.sig").alias("a")).agg(F.count(F.lit(1)).alias("shared"), F.first("low.n").alias("n_a"), F.first("n").alias("n_b"))
    first = first.groupBy("b").agg(F.max(F.struct("shared", "a", "n_a", "n_b")).alias("x")).select("x.a", "b", "x.n_a", "x.n_b")
    candidates = scratch.keep(meeting(first, prefixes), "candidates")
    wanted = wanted_of(candidates, classes, scratch, "first")
    links = scratch.keep(verify(dealt(candidates, wanted), texts_of(wanted, docs)), "links")
    comps = components(links, scratch, "comps")

    k = 0
    while True:
        left = lists.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        left = scratch.keep(left, f"named-{k}")
        whole = left.groupBy("token").agg(F.min("n").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
        left = left.join(whole, "token").where(reaches(F.col("n"), F.col("pos"), F.col("least")))
        left = scratch.keep(left.select("token", "sig", "n", "pos", "comp", "members"), f"left-{k}")
        names = ("sig", "n", "pos", "comp")
        fits = reaches(F.col("n_a"), F.col("pos_a"), F.col("n_b")) & reaches(F.col("n_b"), F.col("pos_b"), F.col("n_a")) & (F.col("comp_a") != F.col("comp_b"))
        side = lambda df, x, *more: df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in (*names, *more)])
        short, long_ = left.where(F.col("members") <= LIST), left.where(F.col("members") > LIST)
        met = side(short, "a").join(side(short, "b"), "token").where((F.col("sig_a") < F.col("sig_b")) & fits).select("sig_a", "sig_b", "n_a", "n_b")
        rest = None
        if long_.limit(1).count():
            leaders = scratch.keep(leaders_of(long_), f"leaders-{k}")
            ranked = scratch.keep(long_.join(leaders, ["token", "sig"], "left"), f"ranked-{k}")
            after = (F.col("no_b").isNull() | (F.col("no_a") < F.col("no_b"))) & fits
            met = met.union(side(ranked.where("no is not null"), "a", "no").join(side(ranked, "b", "no"), "token").where(after).select("sig_a", "sig_b", "n_a", "n_b"))
            rest = ranked.where("no is null").select("token", "sig", "n", "pos")
        swap = F.col("sig_a") > F.col("sig_b")
        ordered = [F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")) for c in ("sig", "n")] + [F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in ("sig", "n")]
        met = met.select(*[c.alias(x) for c, x in zip(ordered, ("a", "n_a", "b", "n_b"), strict=True)]).distinct()
        candidates = scratch.keep(meeting(met, prefixes), f"candidates-{k}")
        wanted = wanted_of(candidates, classes, scratch, f"round-{k}")
        found = scratch.keep(verify(dealt(candidates, wanted), texts_of(wanted, docs)), f"links-{k}")
        if found.limit(1).count():
            links = scratch.keep(links.union(found), f"all-{k}")
            comps = components(links, scratch, f"comps-{k}")
        k += 1
        if rest is None or not rest.limit(1).count():
            break
        lists = rest

    named = classes.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", F.col("sig")))
    by_comp = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = scratch.keep(named.join(by_comp, "comp").select("sig", "sig2", "comp", "component_id"), "named")
    out = own.join(of_class, ["sig", "sig2"], "left")
    more = ([F.col("h").alias(text_hash)] if text_hash else []) + ([F.when(F.col("n") > 0, F.col("comp")).alias(group)] if group else [])
    return out.select("doc_id", *more, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of every row of documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
