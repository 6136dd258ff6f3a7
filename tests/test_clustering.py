"""Online clustering against a plain sequential fold over all events, cut into slices, batches and resumed runs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.sources.tables import Scratch
from newsloom.streaming import clustering as C

DAY = 86_400


def made(n=150, seed=3):
    """Articles of a few topics that drift over a month: near vectors, near titles, copies, ties of time, missing parts."""
    rng = random.Random(seed)
    topics = [np.random.default_rng(k).normal(size=8) for k in range(6)]
    words = ["flood", "valley", "rescue", "market", "shares", "plunge", "court", "ruling", "launch", "phone", "storm", "coast"]
    rows = []
    for i in range(n):
        k = rng.randrange(6)
        v = (topics[k] + np.array([rng.gauss(0, 0.8) for _ in range(8)])).tolist()
        title = " ".join(rng.choice(words[2 * k : 2 * k + 3]) for _ in range(rng.randrange(1, 6)))
        at = 1_700_000_000 + rng.randrange(30 * 24) * 3600
        rows.append((i, rng.choice([title, title.title(), title + " again"]), "s", at, rng.choice(["a", "b", None]), rng.choice([0.3, 0.6, 0.9, None]), rng.choice(["x", "y"]), rng.choice([["OTHER"], ["LAW"], ["LAW", "POLICY"], []]), rng.choice([v, v, None])))
    rows += [(n, None, None, 1_700_000_000, None, None, "x", ["OTHER"], None), (n + 1, "", "", 1_700_000_000, "a", 0.9, "x", ["OTHER"], [0.0] * 8), (n + 2, "!?", "", 1_700_900_000, "a", 0.9, "x", ["LAW"], [float("nan")] * 8)]
    rows += [(n + 3 + j, *rows[5][1:]) for j in range(4)]  # copies
    return rows


def plain(rows):
    """One article after the other against all events."""

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[a-z0-9]+", (t or "").lower()) for i in range(len(w) + 1)}

    def unit(v):
        n = np.linalg.norm(v) if v else 0
        return np.array(v) / n if v and np.isfinite(n) and n > 0 else None

    events, out, now = [], {}, -(2**62)
    for i, title, _, at, _, reliability, category, types, vector in sorted(rows, key=lambda r: (r[3], r[0])):
        now, u, found = max(now, at), unit(vector), None
        live = [e for e in events if e["last"] > now - 7 * DAY]

        def score(e, sim):
            return round(sim * 0.55 + (0.25 if set(types) & e["types"] - {"OTHER"} else 0) + (0.2 if e["cat"] == category else 0), 9)

        if u is not None:
            near = sorted((-round(float(e["u"] @ u), 9), e["id"]) for e in live if e["u"] is not None)[:3]
            for s, k in near:
                e = next(x for x in events if x["id"] == k)
                if score(e, -s) >= 0.75 or -s >= 0.82:
                    found = e, score(e, -s)
                    break
        if not found:
            sims = []
            for e in live:
                a, b = grams(e["title"]), grams(title)
                if a | b and round(len(a & b) / len(a | b), 9) >= 0.38:
                    sims.append((-round(len(a & b) / len(a | b), 9), e["id"]))
            for s, k in sorted(sims)[:3]:
                e = next(x for x in events if x["id"] == k)
                if score(e, -s) >= 0.65 or -s >= 0.55:
                    found = e, score(e, -s)
                    break
        if not found:
            events.append({"id": i, "title": title, "types": set(types), "cat": category, "u": u, "first": at, "last": at})
            out[i] = (i, 1.0, True, False)
            continue
        e, s = found
        e["types"] |= set(types)
        e["last"] = max(e["last"], now)
        old, new = ({w for w in re.sub(r"[^a-z0-9\s]", "", (t or "").lower()).split() if len(w) > 2} for t in (e["title"], title))
        renamed = s >= 0.75 and (0.5 if reliability is None else reliability) >= 0.5 and at - e["first"] >= 7200 and not (old and new and len(old & new) / len(old | new) > 0.8)
        if renamed:
            e["title"] = title
        out[i] = (e["id"], s, False, renamed)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, C.ARTICLES.replace("published_at timestamp", "published_at long"))
    return df.withColumn("published_at", F.timestamp_seconds("published_at"))


def found(store):
    return {r.article_id: (r.event_id, r.relevance, r.is_new, r.new_headline) for r in store.table("joined", C.JOINED).collect()}


@pytest.mark.parametrize("most", [1000, 40])
def test_equals_sequential_fold(spark, most):
    rows = made()
    want = plain(rows)
    assert sum(not x[2] for x in want.values()) > 40 and any(x[3] for x in want.values())
    store = C.EventStore(spark, Scratch(spark, "fold").root)
    C.cluster_batch(frame(spark, rows), store, 0, most)
    assert found(store) == want
    lines = store.table("slices", C.LINE).collect()
    assert sum(r.articles for r in lines) == len(rows) and (len(lines) == 1 or len(lines) > 2)


def test_stopped_stream_resumes(spark, tmp_path, monkeypatch):
    """Batches by time; the third fails half-way once. The stream that is started again ends as one that never failed."""
    rows = sorted(made(90, 8), key=lambda r: (r[3], r[0]))
    want = plain(rows)
    for k in range(3):
        frame(spark, rows[k * 33 : (k + 1) * 33]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(frame(spark, rows).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    store, whole, calls = C.EventStore(spark, f"{tmp_path}/store"), C.cluster_slice, []

    def fails(articles, to, name):
        calls.append(name)
        if name.startswith("000000002") and calls.count(name) == 1:
            raise RuntimeError("lost")
        whole(articles, to, name)

    monkeypatch.setattr(C, "cluster_slice", fails)
    with pytest.raises(Exception, match="lost"):
        C.cluster_stream(stream(), lambda b: b, store)
    assert len(store.done()) == 2
    C.cluster_stream(stream(), lambda b: b, store)
    assert found(store) == want
    C.cluster_stream(stream(), lambda b: b, store)  # nothing new
    assert found(store) == want
    # versions of the state that nothing needs are gone
    assert len([p for p in (tmp_path / "store" / "state").iterdir()]) == 2


def test_late_articles_are_counted(spark):
    store = C.EventStore(spark, Scratch(spark, "late").root)
    rows = [(1, "storm on the coast", "s", 1_700_000_000 + 20 * DAY, "a", 0.9, "x", ["LAW"], None), (2, "storm on the coast", "s", 1_700_000_000, "a", 0.9, "x", ["LAW"], None), (3, "storm on the coast", "s", 1_700_000_000 + DAY, "a", 0.9, "x", ["LAW"], None)]
    C.cluster_batch(frame(spark, rows[:1]), store, 0)
    C.cluster_batch(frame(spark, rows[1:]), store, 1)
    assert found(store)[2][0] == 1 and found(store)[3][0] == 1  # they join what is live when they come
    assert sorted((r.articles, r.late) for r in store.table("slices", C.LINE).collect()) == [(1, 0), (2, 2)]
    C.cluster_batch(frame(spark, []), store, 2)
    assert len(store.done()) == 2


def test_live_entries(spark):
    joined = spark.createDataFrame([(1, 1, 1.0, True, False, "a"), (2, 1, 0.8, False, True, None)], C.JOINED)
    out = {r.entry_type: (r.title, r.description) for r in C.live_entries(joined, frame(spark, [(1, "T" * 130, "b", 0, "a", 0.5, "x", [], None), (2, "Later", "c", 0, "a", 0.5, "x", [], None)])).collect()}
    assert out == {"new_event": ("New Event: " + "T" * 120, "b"), "new_evidence": ("Additional Coverage: Later", "New reporting from Independent source")}
    r = C.event_counts(joined).first()
    assert (r.articles, r.sources, r.renamed, r.entries_new, r.entries_evidence) == (2, 1, 1, 1, 1)
