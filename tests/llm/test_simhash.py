"""SimHash fingerprints and groups against brute force; the dedup stage; odd rows."""

import random

import pytest
import xxhash

from attestra.llm import simhash
from attestra.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(500):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & flipped for m in masks)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        docs.append((i * 10, " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            docs.append((i * 10 + k + 1, " ".join(near if k else base).upper()))
    return [*docs, (1000, None), (1001, ""), (1002, " \n "), (1003, "Ünïcode wörds hére"), (1004, "x " * 20000), (1004, "x " * 20000)]


@pytest.mark.parametrize("small_bucket", [48, 1])
def test_groups_are_those_of_brute_force(spark, small_bucket):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(frame, small_bucket=small_bucket).select("doc_id", simhash.hex_digits(simhash.F.col("fp")).alias("h"), "component_id").collect()
    prints = {i: brute_fingerprint(t) for i, t in docs}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(got) == len(docs) and all(r["h"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("radius", [1, 2, 4])
@pytest.mark.parametrize(("small_bucket", "block"), [(48, 2048), (1, 4)])
def test_links_of_any_radius(spark, radius, small_bucket, block):
    rng = random.Random(radius)
    centres = [rng.getrandbits(63) for _ in range(6)]
    marks = sorted({c ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, radius + 1))) for c in centres for _ in range(25)})
    edges = simhash.linked_fingerprints(spark.createDataFrame([(m,) for m in marks], "fp long"), radius, small_bucket, block)
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    want = components(marks, lambda a, b: (a ^ b).bit_count() <= radius)
    assert {m: got.get(m, m) for m in marks} == want


@pytest.mark.parametrize(("small_bucket", "block"), [(48, 2048), (1, 4)])
def test_links_of_several_fingerprints(spark, small_bucket, block):
    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(63), n))
    centres = [[rng.getrandbits(63) for _ in range(3)] for _ in range(5)]
    rows = [tuple(flip(x, rng.randint(0, 5)) for x in c) for c in centres for _ in range(40)]
    frame = spark.createDataFrame([(7 * k, *r) for k, r in enumerate(rows)], "node long, f0 long, f1 long, f2 long")
    edges = simhash.linked_nodes(frame, ["f0", "f1", "f2"], 2, 9, small_bucket, block)
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}

    def linked(a, b):
        apart = [(x ^ y).bit_count() for x, y in zip(rows[a], rows[b], strict=True)]
        return min(apart) <= 2 and sum(apart) <= 9

    want = components(range(len(rows)), linked)
    assert {k: got.get(7 * k, 7 * k) for k in range(len(rows))} == {k: 7 * c for k, c in want.items()}


def test_stage_drops_near_copies_and_keeps_other_texts(spark):
    """Near copies: five-word shingles of similarity 0.9 or more. Others: under 0.5."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(500)]
        near, far = list(base), list(base)
        for at in rng.sample(range(500), 4):
            near[at] = "changed"
        far[:250] = [rng.choice(words) for _ in range(250)]
        docs += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got >= {i for i, _ in docs if i % 3 != 1} and len(got) <= 120 + 2


def test_stage_keeps_one_of_each_group(spark):
    docs = [(5, "a b c d e f g"), (3, "A B c d e f g"), (3, "a b c d e f g"), (7, "other words are here now"), (7, "other words are here now"), (None, "a b c d e f g"), (8, None), (9, ""), (None, "alone in the dark")]
    frame = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in docs], "doc_id long, text string, lang string, n_chars long, fp string")
    got = simhash.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    assert sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in got.collect()) == sorted([("3", "a b c d e f g"), ("7", "other words are here now"), ("8", "none"), ("None", "alone in the dark")])
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0 and simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (50, 51), (51, 50), (60, 70), (70, 60)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 60: 60, 70: 60}
