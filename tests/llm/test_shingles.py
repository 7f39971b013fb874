"""Near-duplicates of the pipeline against brute force over all pairs."""

import random
import re

import pytest
from test_simhash import components

from attestra.llm import shingles, simhash


def similarity(a, b):
    def of(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    return len(of(a) & of(b)) / len(of(a) | of(b))


@pytest.mark.parametrize("block", [256, 4])
def test_links_are_all_pairs_of_similarity_0_8_and_no_others(spark, monkeypatch, block):
    """Edited copies around the limit, chains of them, and texts that share a long passage."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "SMALL_BUCKET", 16 if block > 4 else 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        docs.append(base)
        for _ in range(6):
            near = list(base)
            for at in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.005, 0.045)))):
                near[at] = "changed"
            docs.append(near)
            base = near if rng.random() < 0.3 else base
    docs += [[rng.choice(words) for _ in range(40)] + passage for _ in range(40)]
    docs = [" ".join(d) for d in docs]
    rng.shuffle(docs)
    near = {(a, b): similarity(docs[a], docs[b]) for a in range(len(docs)) for b in range(a + 1, len(docs))}
    assert sum(0.8 <= s < 0.9 for s in near.values()) > 20 and sum(0.6 < s < 0.8 for s in near.values()) > 20
    want = set(components(range(len(docs)), lambda a, b: near[min(a, b), max(a, b)] >= 0.8).values())
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == want


def test_rows_of_buckets_are_joined_few_times(spark, monkeypatch):
    """A group of copies that are mostly less than 0.8 alike keeps its buckets open; its rows pass few joins all the same."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    base, docs = [rng.choice(words) for _ in range(100)], []
    for _ in range(120):
        near = list(base)
        for at in rng.sample(range(100), 2):
            near[at] = rng.choice(words)
        docs.append(" ".join(near))
    tables, write = {}, shingles.materialize

    def counted(frame, label):
        out = write(frame, label)
        tables.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(shingles, "materialize", counted)
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    near = {(a, b): similarity(docs[a], docs[b]) for a in range(len(docs)) for b in range(a + 1, len(docs))}
    want = set(components(range(len(docs)), lambda a, b: near[min(a, b), max(a, b)] >= 0.8).values())
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(frame).collect()}
    assert want <= got and len(got - want) <= 3 and len(want) > 20  # close pairs share a table in over 99 % of cases, others never link
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found, runs = 0, store.executionsList()
    for i in range(done, runs.size()):
        run, values = runs.apply(i), store.executionMetrics(runs.apply(i).executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[(key|node)#\d+L?\], \[(key|node)#", node.desc()) and "bit_count" not in node.desc():
                metrics = node.metrics()
                rows = [m.accumulatorId() for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows"]
                found += sum(int(values.apply(r).replace(",", "")) for r in rows if values.contains(r))
    members = tables["members"][0]
    assert members > 20 * len(docs) and members < found < 4 * members, (found, members)
