"""Articles of a stream join events that earlier ones founded: vectors before titles, within a horizon, headlines that evolve.

Whether an article joins an event depends on what became of all before it. But an event is only ever joined by articles that its
vector or one of its members' titles is near to, so articles fall into blocks that never look at each other: the components of
that nearness. A micro-batch is cut into slices of a bounded number of articles, by time. Of each slice, the rows of the state and
its own articles are compared with it where they lie, a task sends home a spanning forest, and the blocks, many small ones in a task, are then folded in time order
together with the events that it may join. Titles near each other were found in the comparison and come with their rows, so
the fold, which order makes serial, only looks them up.

The state is a table of the events within the horizon, a version for each slice. A slice that is run again replaces its version,
so a stream that stops resumes from its checkpoint with equal results.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How long an event without news can be joined, in seconds; shares of similarity, types and category in a match (fixed values).
HORIZON, NEAR, TYPES, CATEGORY = 7 * 86_400, 0.55, 0.25, 0.20
#: Composite and similarity from which a vector, and from which a title is accepted; least similarity of titles; candidates (fixed values).
BY_VECTOR, ALONE_VECTOR, BY_TITLE, ALONE_TITLE, LEAST_TITLE, BEST = 0.75, 0.82, 0.65, 0.55, 0.38, 3
#: Relevance, reliability, age in seconds and word similarity that let an article give its event a new headline (fixed values).
HEADLINE, RELIABLE, LATER, ALIKE = 0.75, 0.5, 2 * 3600, 0.80
#: Below this similarity no vector is accepted whatever else agrees, so blocks need not hold such pairs.
LEAST_VECTOR = (BY_VECTOR - TYPES - CATEGORY) / NEAR
#: Articles of a slice. It bounds what is broadcast, a block and a task's memory; results are the same for any bound.
SLICE = 20_000
#: Rows whose vectors are compared with a slice at once.
ROWS = 256

ARTICLES = "article_id long, title string, summary string, published_at timestamp, source string, reliability double, category string, event_types array<string>, embedding array<double>"
STATE = "event_id long, title string, category string, event_types array<string>, embedding array<double>, first_at long, last_at long"
JOINED = "article_id long, event_id long, relevance double, is_new boolean, new_headline boolean, source string"


def trigrams(title: str | None) -> set[str]:
    """The trigrams of the title's words, padded by two blanks before and one after."""
    return {w[i : i + 3] for x in re.findall(r"[^\W_]+", (title or "").lower()) for w in [f"  {x} "] for i in range(len(w) - 2)}


def _words(title: str | None) -> set[str]:
    return {w for w in re.sub(r"[^a-z0-9\s]", "", (title or "").lower()).split() if len(w) > 2}


def _unit(vector) -> np.ndarray | None:
    """The vector by its length; None if there is none or it has none."""
    if vector is None or len(vector) == 0:
        return None
    v = np.asarray([np.nan if x is None else x for x in vector], float)
    n = np.linalg.norm(v)
    return v / n if np.isfinite(n) and n > 0 else None


class Forest:
    """Union of numbered nodes; the least of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


@dataclass
class Slice:
    """The articles of a slice as every task holds them: vectors by row, and the sets of the titles' trigrams, each once under the number of
    its first article. Trigrams that many titles hold are rows of a matrix, the others lists."""

    vectors: np.ndarray
    has: np.ndarray
    rep: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    index: dict[str, np.ndarray]
    often: dict[str, int]
    dense: np.ndarray

    @staticmethod
    def of(titles: list, embeddings: list) -> Slice:
        units = [_unit(v) for v in embeddings]
        d = max((len(u) for u in units if u is not None), default=1)
        vectors = np.zeros((len(units), d))
        has = np.array([u is not None and len(u) == d for u in units], bool)
        for i, u in enumerate(units):
            if has[i]:
                vectors[i] = u
        known: dict[frozenset, int] = {}
        rep = np.array([known.setdefault(frozenset(trigrams(t)), i) for i, t in enumerate(titles)], np.int32)
        found: dict[str, list[int]] = {}
        for u, grams in enumerate(known):
            for g in grams:
                found.setdefault(g, []).append(u)
        common = [g for g, x in found.items() if len(x) * 50 > len(known)]
        dense = np.zeros((len(common), len(known)), np.uint8)
        for k, g in enumerate(common):
            dense[k, found[g]] = 1
        return Slice(vectors, has, rep, np.array(list(known.values()), np.int32), np.array([len(g) for g in known], np.int64), {g: np.array(x) for g, x in found.items()}, {g: k for k, g in enumerate(common)}, dense)

    def titled(self, grams: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets that a title of these trigrams could match, and how many trigrams each shares. Of n trigrams so many must be shared that the
        commonest need not be counted to find the sets, only for the few found."""
        n, least = len(grams), LEAST_TITLE - 1e-6
        skipped = sorted((g for g in grams if g in self.often), key=lambda g: -len(self.index[g]))[: max(0, int(np.ceil(least * n)) - 1)]
        lists = [self.index[g] for g in grams.difference(skipped) if g in self.index]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shared = np.bincount(np.concatenate(lists), minlength=len(self.first))
        at = np.flatnonzero((shared > 0) & ((shared + len(skipped)) * (1 + least) >= least * (n + self.sizes)))
        shared = shared[at] + self.dense[np.ix_([self.often[g] for g in skipped], at)].sum(axis=0, dtype=np.int64)
        fits = shared >= least * (n + self.sizes[at] - shared)
        return at[fits], shared[fits]

    def close(self, vectors: list) -> list[np.ndarray]:
        """For each vector, the articles whose vectors are near."""
        units = [_unit(v) for v in vectors]
        own = [i for i, u in enumerate(units) if u is not None and len(u) == self.vectors.shape[1]]
        out = [np.zeros(0, np.int64)] * len(units)
        if own:
            for i, row in zip(own, (np.stack([units[i] for i in own]) @ self.vectors.T >= LEAST_VECTOR - 1e-6) & self.has, strict=True):
                out[i] = np.flatnonzero(row)
        return out


def _blocks(items: DataFrame, known, n: int) -> tuple[list[int], DataFrame]:
    """(the block of each article by number; of events that a block may join, with the number of one of its articles, and of articles, whose event_id is
    null, the columns NEARBY). The table is persisted. items: (event_id, number, title, embedding), the state's events with a null number and the
    slice's articles with a null event_id."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, forest = known.value, Forest(n)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part, rows = b.slice(at, ROWS).to_pydict(), []
                for event, number, title, close in zip(part["event_id"], part["number"], part["title"], own.close(part["embedding"]), strict=True):
                    rep = None if number is None else int(own.rep[number])
                    grams = trigrams(title) if rep == number else set()  # an article with the title of an earlier one shares its list
                    sets, shared = own.titled(grams)
                    found = own.first[sets]
                    joined = [*found.tolist(), *close.tolist()]
                    first = number if number is not None else joined[0] if joined else None
                    for j in joined + ([] if rep is None else [rep]):
                        forest.join(first, j)
                    if first is not None:
                        rows.append((event, first, None, rep, len(grams), found.astype(np.int32).tobytes(), shared.astype(np.int32).tobytes()))
                yield _found(rows)
        yield _found([(None, i, forest.root(i), None, None, None, None) for i in range(n) if forest.up[i] != i])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(n)
        for b in batches:
            for i, j in zip(b.column("number").to_pylist(), b.column("root").to_pylist(), strict=True):
                forest.join(i, j)
        edges = [(i, forest.root(i)) for i in range(n) if forest.up[i] != i]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in edges], pa.int32()), pa.array([r for _, r in edges], pa.int32())], names=["number", "root"])

    found = items.mapInArrow(compare, f"event_id long, number int, root int, {NEARBY}").persist()
    edges = found.where("root IS NOT NULL").select("number", "root")
    # a forest a partition, then up a tree: no task reads more than the root of the partitions' number of forests
    parts = max(1, int(edges.rdd.getNumPartitions() ** 0.5))
    edges = edges.repartition(parts).mapInArrow(merge, "number int, root int").coalesce(1).mapInArrow(merge, "number int, root int")
    forest = Forest(n)
    for r in edges.collect():
        forest.join(r.number, r.root)
    return [forest.root(i) for i in range(n)], found


def _bins(blocks: list[int], most: int) -> dict[int, int]:
    """A bin for each block, the largest first into the emptiest: a task's fixed cost is for a bin, not for each of many small blocks."""
    load = [(0, b) for b in range(most)]
    out = {}
    for block, n in sorted(Counter(blocks).items(), key=lambda x: (-x[1], x[0])):
        held, b = heapq.heappop(load)
        out[block] = b
        heapq.heappush(load, (held + n, b))
    return out


#: What the title of an article or event is near to: the article that stands for its title (null for events), its trigrams, the articles that stand for
#: the titles near it and the trigrams shared with each, as 4-byte numbers.
NEARBY = "rep int, grams int, near binary, shared binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("event_id", pa.int64()), ("number", pa.int32()), ("root", pa.int32()), ("rep", pa.int32()), ("grams", pa.int32()), ("near", pa.binary()), ("shared", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


class Titles:
    """Titles of a block by number, events' titles from 0 and then those that articles stand for, each with the titles near it."""

    def __init__(self, events: list[tuple], articles: list[tuple]):
        """events: (grams, near, shared) of the state's events in their order; articles: (number, grams, near, shared) of those that stand for titles."""
        self.base, numbers = len(events), np.array([a[0] for a in articles], np.int64)
        self.of = {int(x): self.base + i for i, x in enumerate(numbers)}
        sizes = np.array([e[0] for e in events] + [a[1] for a in articles], np.int64)
        lists = [np.frombuffer(x[-2], np.int32) for x in [*events, *articles]]
        source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        none = [np.zeros(0, np.int32)]
        place = np.argsort(numbers)
        target = place[np.searchsorted(numbers, np.concatenate(lists + none), sorter=place)] if len(numbers) else np.zeros(0, np.int64)
        shared = np.concatenate([np.frombuffer(x[-1], np.int32) for x in [*events, *articles]] + none)
        sims = np.round(shared / np.maximum(1, sizes[source] + sizes[self.base + target] - shared), 9)
        kept = np.flatnonzero(sims >= LEAST_TITLE)
        kept = kept[np.lexsort((-sims[kept], target[kept]))]
        self.near, self.sims = source[kept], sims[kept]
        self.start = np.searchsorted(target[kept], np.arange(len(numbers) + 1))

    def around(self, title: int) -> Iterator[tuple[int, float]]:
        """The titles near one that an article stands for, the most similar first."""
        at, to = self.start[title - self.base], self.start[title - self.base + 1]
        return zip(self.near[at:to].tolist(), self.sims[at:to].tolist(), strict=True)


class Fold:
    """The events of some blocks, to which articles are added in time order. Vectors meet within a block and a length."""

    def __init__(self, titles: Titles):
        self.events: list[dict] = []
        self.titles = titles
        self.by_title: dict[int, set[int]] = {}
        self.vectors: dict[tuple, tuple[np.ndarray, list[int]]] = {}

    def add(self, event: dict) -> int:
        k, unit = len(self.events), event["unit"]
        self.events.append(event)
        if unit is not None:
            vectors, owners = self.vectors.get(at := (event["block"], len(unit)), (np.zeros((4, len(unit))), []))
            if len(owners) >= len(vectors):
                vectors = np.vstack([vectors, np.zeros_like(vectors)])
            vectors[len(owners)] = unit
            owners.append(k)
            self.vectors[at] = vectors, owners
        self.by_title.setdefault(event["number"], set()).add(k)
        return k

    def name(self, k: int, title: str | None, number: int) -> None:
        event = self.events[k]
        self.by_title[event["number"]].discard(k)
        event["title"], event["number"] = title, number
        self.by_title.setdefault(number, set()).add(k)

    def match(self, a: dict, now: int) -> tuple[int, float] | None:
        """The first of the nearest live events, by vector and then by title, that the article fits; with the composite score."""
        live = lambda k: self.events[k]["last_at"] > now - HORIZON

        def composite(k: int, sim: float) -> float:
            e = self.events[k]
            shared = any(t != "OTHER" and t in e["event_types"] for t in a["event_types"])
            return round(sim * NEAR + (TYPES if shared else 0.0) + (CATEGORY if e["category"] == a["category"] else 0.0), 9)

        if a["unit"] is not None and (held := self.vectors.get((a["block"], len(a["unit"])))):
            vectors, owners = held
            sims = np.round(vectors[: len(owners)] @ a["unit"], 9)
            near = [(-float(sims[i]), self.events[k]["event_id"], k) for i in np.flatnonzero(sims >= LEAST_VECTOR - 1e-6).tolist() if live(k := owners[i])]
            for minus, _, k in sorted(near)[:BEST]:
                score = composite(k, -minus)
                if score >= BY_VECTOR or -minus >= ALONE_VECTOR:
                    return k, score
        titled: list[tuple] = []
        for title, sim in self.titles.around(a["number"]):
            if len(titled) >= BEST and -sim > titled[BEST - 1][0]:
                break
            found = [(-sim, self.events[k]["event_id"], k) for k in self.by_title.get(title, ()) if live(k)]
            titled = sorted(titled + found)[:BEST] if found else titled
        for minus, _, k in titled:
            score = composite(k, -minus)
            if score >= BY_TITLE or -minus >= ALONE_TITLE:
                return k, score
        return None

    def take(self, a: dict, now: int) -> tuple:
        """Adds an article; (article_id, event_id, relevance, is_new, new_headline, source)."""
        found = self.match(a, now)
        if found is None:
            self.add({"block": a["block"], "event_id": a["article_id"], "title": a["title"], "number": a["number"], "category": a["category"], "event_types": list(a["event_types"]), "embedding": a["embedding"], "unit": a["unit"], "first_at": a["at"], "last_at": a["at"], "changed": True})
            return a["article_id"], a["article_id"], 1.0, True, False, a["source"]
        k, score = found
        event = self.events[k]
        event["changed"] = True
        event["event_types"] = sorted(set(event["event_types"]) | set(a["event_types"]))
        event["last_at"] = max(event["last_at"], now)
        renamed = score >= HEADLINE and self.may_rename(event, a)
        if renamed:
            self.name(k, a["title"], a["number"])
        return a["article_id"], event["event_id"], score, False, renamed, a["source"]

    @staticmethod
    def may_rename(event: dict, a: dict) -> bool:
        reliability = 0.5 if a["reliability"] is None else a["reliability"]
        if reliability < RELIABLE or a["at"] - event["first_at"] < LATER:
            return False
        old, new = _words(event["title"]), _words(a["title"])
        return not (old and new and len(old & new) / len(old | new) > ALIKE)


def _none(x):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else x


def fold_block(rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
    """The events (article_id null) of blocks and their articles in time order, as rows of JOINED for its articles and of STATE for the events that
    they founded or joined."""
    earlier, own = rows[rows.article_id.isna()].sort_values("event_id"), rows[rows.article_id.notna()].sort_values(["first_at", "article_id"])
    leading = own[own.rep == own.number]
    titles = Titles(list(zip(earlier.grams, earlier.near, earlier.shared, strict=True)), list(zip(leading.number, leading.grams, leading.near, leading.shared, strict=True)))
    fold, joined = Fold(titles), []
    for i, r in enumerate(earlier.itertuples()):
        fold.add({"block": r.block, "event_id": int(r.event_id), "title": r.title, "number": i, "category": r.category, "event_types": list(r.event_types), "embedding": r.embedding, "unit": _unit(r.embedding), "first_at": int(r.first_at), "last_at": int(r.last_at), "changed": False})
    for r in own.itertuples():
        at = int(r.first_at)
        a = {"block": r.block, "article_id": int(r.article_id), "title": r.title, "number": titles.of[int(r.rep)], "category": r.category, "event_types": list(r.event_types), "embedding": r.embedding, "unit": _unit(r.embedding), "at": at, "source": r.source, "reliability": _none(r.reliability)}
        joined.append(fold.take(a, max(watermark, at)))
    states = [(None, e["event_id"], None, None, None, None, e["title"], e["category"], e["event_types"], e["embedding"], e["first_at"], e["last_at"]) for e in fold.events if e["changed"]]
    return pd.DataFrame([(*j, None, None, None, None, None, None) for j in joined] + states, columns=_FOLDED)


_FOLDED = ["article_id", "event_id", "relevance", "is_new", "new_headline", "source", "title", "category", "event_types", "embedding", "first_at", "last_at"]
_FOLDED_SCHEMA = f"{JOINED}, title string, category string, event_types array<string>, embedding array<double>, first_at long, last_at long"


class EventStore:
    """Versions of the state, the articles joined and a line for each slice, under one folder in shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def done(self) -> list[str]:
        """Finished slices, in order: those whose line was written, which is the last that a slice does."""
        fs, path = self._fs(f"{self.root}/slices")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.root}/slices/{n}/_SUCCESS")[1]))

    def table(self, name: str, schema: str) -> DataFrame:
        """All finished slices of a table."""
        paths = [f"{self.root}/{name}/{n}" for n in self.done()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def before(self, name: str) -> tuple[DataFrame, int]:
        """The state and the watermark that a slice starts from."""
        earlier = [n for n in self.done() if n < name]
        if not earlier:
            return self.spark.createDataFrame([], STATE), -(2**62)
        state = self.spark.read.schema(STATE).parquet(f"{self.root}/state/{earlier[-1]}")
        return state, self.spark.read.schema(LINE).parquet(f"{self.root}/slices/{earlier[-1]}").first().watermark

    def forget(self, name: str) -> None:
        """Versions of the state before the last two are not needed to run anything again."""
        for old in [n for n in self.done() if n < name][:-1]:
            fs, path = self._fs(f"{self.root}/state/{old}")
            fs.delete(path, True)


LINE = "slice string, articles long, late long, watermark long"


def cluster_slice(articles: DataFrame, store: EventStore, name: str) -> None:
    """Joins the articles of a slice, at most SLICE rows, to the store. Late articles, older than the horizon when they come, are
    counted; they can join what is live but found events that nothing can join."""
    spark = store.spark
    articles = articles.select(*[f.split(" ")[0] for f in ARTICLES.split(", ") if not f.startswith("summary")]).withColumn("at", F.unix_timestamp("published_at"))
    rows = articles.select("article_id", "title", "embedding", "at").toArrow().sort_by([("at", "ascending"), ("article_id", "ascending")])
    times = rows["at"].to_pylist()
    state, watermark = store.before(name)
    state = state.where(F.col("last_at") > max(watermark, times[0]) - HORIZON)
    known = spark.sparkContext.broadcast(Slice.of(rows["title"].to_pylist(), rows["embedding"].to_pylist()))
    order = spark.createDataFrame(pa.table({"article_id": rows["article_id"], "number": pa.array(range(len(times)), pa.int32())}))
    numbered = articles.join(F.broadcast(order), "article_id").repartition(spark.sparkContext.defaultParallelism)
    items = state.select("event_id", F.lit(None).cast("int").alias("number"), "title", "embedding").union(numbered.select(F.lit(None).cast("long"), "number", "title", "embedding"))
    blocks, found = _blocks(items, known, len(times))
    bins = _bins(blocks, 2 * spark.sparkContext.defaultParallelism)
    block_of = spark.createDataFrame(pa.table({"number": pa.array(range(len(blocks)), pa.int32()), "block": pa.array(blocks, pa.int32()), "bin": pa.array([bins[b] for b in blocks], pa.int32())}))
    near = [f.split(" ")[0] for f in NEARBY.split(", ")]
    events = found.where("event_id IS NOT NULL").join(F.broadcast(block_of), "number").select("event_id", "bin", "block", *near).join(state, "event_id")
    empty = lambda kind: F.lit(None).cast(kind)
    types = F.coalesce("event_types", F.array().cast("array<string>")).alias("event_types")
    events = events.select("bin", "block", empty("long").alias("article_id"), "event_id", "title", "category", types, "embedding", "first_at", "last_at", empty("string").alias("source"), empty("double").alias("reliability"), empty("int").alias("number"), *near)
    own = numbered.join(F.broadcast(block_of), "number").join(found.where("event_id IS NULL AND root IS NULL").select("number", *near), "number").select("bin", "block", "article_id", empty("long").alias("event_id"), "title", "category", types, "embedding", F.col("at").alias("first_at"), empty("long").alias("last_at"), "source", "reliability", "number", *near)
    folded = events.union(own).groupBy("bin").applyInPandas(lambda pdf: fold_block(pdf, watermark), _FOLDED_SCHEMA)
    at = f"{store.root}/folded/{name}"
    folded.write.mode("overwrite").parquet(at)
    folded = spark.read.schema(_FOLDED_SCHEMA).parquet(at)
    folded.where("article_id IS NOT NULL").select(*[f.split(" ")[0] for f in JOINED.split(", ")]).write.mode("overwrite").parquet(f"{store.root}/joined/{name}")
    now = max(watermark, times[-1])
    changed = folded.where("article_id IS NULL").select(*[f.split(" ")[0] for f in STATE.split(", ")])
    kept = state.join(changed, "event_id", "left_anti").select(changed.columns).union(changed).where(F.col("last_at") > now - HORIZON)
    kept.write.mode("overwrite").parquet(f"{store.root}/state/{name}")
    late = sum(at <= watermark - HORIZON for at in times)
    spark.createDataFrame([(name, len(times), late, now)], LINE).coalesce(1).write.mode("overwrite").parquet(f"{store.root}/slices/{name}")
    store.forget(name)
    found.unpersist()
    known.destroy()


def cluster_batch(articles: DataFrame, store: EventStore, number: int, most: int = SLICE) -> None:
    """A micro-batch in slices of about `most` articles, by ranges of time and id. The slices are written once, so that a batch that is
    run again is cut alike. Articles without id or time cannot be ordered and are left out; of rows that repeat an id one counts."""
    spark, at = store.spark, f"{store.root}/batches/{number:09d}"
    fs, path = store._fs(f"{at}/_SUCCESS")
    if not fs.exists(path):
        articles = articles.where("published_at IS NOT NULL AND article_id IS NOT NULL").dropDuplicates(["article_id"])
        parts = max(1, -(-articles.count() // most))
        sliced = articles.repartitionByRange(parts, "published_at", "article_id").withColumn("slice", F.spark_partition_id())
        sliced.write.mode("overwrite").partitionBy("slice").parquet(at)
    sliced = spark.read.schema(f"{ARTICLES}, slice int").parquet(at)
    finished = set(store.done())
    for k in sorted(r.slice for r in sliced.select("slice").distinct().collect()):
        name = f"{number:09d}-{k:06d}"
        if name not in finished:
            cluster_slice(sliced.where(F.col("slice") == k), store, name)


def cluster_stream(stream: DataFrame, prepared, store: EventStore, most: int = SLICE) -> None:
    """Runs a stream of raw rows to its present end; `prepared` makes articles of a micro-batch. The checkpoint lies beside the store, and
    both together resume where an earlier run stopped."""

    def each(batch: DataFrame, number: int) -> None:
        cluster_batch(prepared(batch), store, number, most)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def event_counts(joined: DataFrame) -> DataFrame:
    """(event_id, articles, sources, renamed, entries_new, entries_evidence) of JOINED rows: counts, how often the headline changed, and the
    entries that the live feed has for the event."""
    return joined.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_distinct("source").alias("sources"),
        F.count_if("new_headline").alias("renamed"),
        F.count_if("is_new").alias("entries_new"),
        F.count_if(~F.col("is_new")).alias("entries_evidence"),
    )


def live_entries(joined: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, entry_type, title, description) of the live feed: a new event with its article's title and summary, further coverage with
    the source."""
    rows = joined.join(articles.select("article_id", "title", "summary"), "article_id")
    title = F.coalesce("title", F.lit(""))
    return rows.select(
        "event_id",
        F.when(F.col("is_new"), "new_event").otherwise("new_evidence").alias("entry_type"),
        F.when(F.col("is_new"), F.concat(F.lit("New Event: "), F.substring(title, 1, 120))).otherwise(F.concat(F.lit("Additional Coverage: "), title)).alias("title"),
        F.when(F.col("is_new"), F.nullif(F.substring("summary", 1, 200), F.lit(""))).otherwise(F.concat(F.lit("New reporting from "), F.coalesce("source", F.lit("Independent source")))).alias("description"),
    )
