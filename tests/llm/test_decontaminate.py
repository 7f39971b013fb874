"""Decontamination against brute force, in one automaton and in shards; span removal; odd rows."""

import random

import pytest

from attestra.llm import decontaminate as D


def brute(docs, items, window):
    split = D.words_of
    out = []
    for _, text in docs:
        words, hit, found = split(text), set(), set()
        for name, said in items:
            item = split(said)
            k = min(window, len(item))
            grams = {tuple(item[p : p + k]) for p in range(len(item) - k + 1)} if item else set()
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    found |= {name} - {None}
        out.append((len(words), hit, sorted(found)))
    return out


def cases(seed):
    rng = random.Random(seed)
    words = ["ab", "cd", "É", "x1", "y"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 2, 3, 4, 5, 6, 9, 14]))) for i in range(12)] + [("90", "..."), (None, text(6)), ("91", "AB, cd; É")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "!?"), (103, text(5000)), (104, items[5][1].upper()), (104, items[5][1].upper())]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("window", [3, 5])
def test_automaton_is_brute_force(seed, window):
    docs, items = cases(seed)
    automaton = D.ItemAutomaton(((n, D.words_of(t)) for n, t in items), window)
    for (_, text), (n, hit, found) in zip(docs, brute(docs, items, window), strict=True):
        words = D.words_of(text)
        spans, names = automaton.hits(words)
        assert len(words) == n and {i for a, b in spans for i in range(a, b)} == hit and sorted(x for x in names if x is not None) == found
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("max_words", [200_000, 12])
def test_scan(spark, max_words):
    docs, items = cases(4)
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.scan(frame, bench, 4, max_words).collect()
    key = lambda r: (r[0], r[1])
    have = sorted((r["doc_id"], r["__n_words"], tuple(i for a, b in sorted(r["__spans"]) for i in range(a, b)), tuple(sorted(r["__items"]))) for r in got)
    want = sorted((i, n, tuple(sorted(h)), tuple(f)) for (i, _), (n, h, f) in zip(docs, brute(docs, items, 4), strict=True))
    assert have == want and key


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "nothing of that kind is here, one two three!"
    docs = [(1, f"Before it all. {item.title()}; and then a good many words that come after it, quite enough of them.", 1), (2, item, 2), (3, clean, 3), (4, None, None), (5, "", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in D.remove_spans(frame, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3]["text"] == clean and got[4]["text"] is None
    assert got[1]["text"] == "Before it all. ; and then a good many words that come after it, quite enough of them." and got[1]["n_chars"] == len(got[1]["text"])
    nothing = D.remove_spans(frame, spark.createDataFrame([], "item_id long, text string"))
    assert nothing.count() == 5 and D.remove_spans(frame.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
