"""Packing: exact round trip of ids, gapless bins, little padding, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestra.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't I'll we've '", "a—. x", "“Hi”—ok", "ÅNGSTRÖM é Éa.", "<|ENDOFTEXT|> <|endoftext|>x", "ＦＵＬＬ", "İstanbul ıI", "ǅ ß ẞ.", "x\x1cy z\x85w q", "日本語。テスト", "ª º µ", "can't.", "ŉ a.", "12,5 3.", "a_b __", "ẃord́.", "", " \n", "..", "it's'S"]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_encoder_gives_the_tokenizers_ids(reference):
    encoder = packing.CachedEncoder(PATH)
    for text in [*ODD, *ODD, " ".join(ODD[:4])]:
        assert encoder.encode(text) == reference(text)[:-1].tobytes(), text


def test_cuts():
    for n in [*range(1, 600), 2047, 2048, 2049, 4095, 4096, 4097, 8192, 100_001]:
        pieces = packing.cut(n)
        assert sum(p[1] for p in pieces) == n and all(p[1] <= 4096 // p[2] for p in pieces)
        assert [p[0] for p in pieces] == list(np.cumsum([0, *[p[1] for p in pieces[:-1]]]))


def test_round_trip(spark, reference):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Alpha", "béta", "gamma,", "delta."]) for _ in range(rng.randint(1, 3000)))) for i in range(120)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "word " * 60_000), (3, docs[3][1]), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, start long, class int")
    rows = packing.pack(frame, PATH).toPandas()
    ids = {}
    for i, t in docs:
        ids[i] = reference(t)
    copies = {i: sum(j == i for j, _ in docs) for i, _ in docs}
    for i, got in rows.groupby("doc_id", dropna=False):
        want, key = ids[None if i != i else int(i)], None if i != i else int(i)
        assert got["length"].sum() == len(want) * copies[key] and (got["doc_tokens"] == len(want)).all()
        if copies[key] == 1:
            at = 0
            for _, p in got.sort_values("start").iterrows():
                assert p["start"] == at and zlib.crc32(want[at : at + int(p["length"])].tobytes()) == p["ids_crc32"]
                at += int(p["length"])
    for _, bin_ in rows.groupby("sequence_id"):
        ordered = bin_.sort_values("offset")
        assert list(ordered["offset"]) == list(np.cumsum([0, *ordered["length"][:-1]])) and ordered["length"].sum() <= 4096
    padding = 1 - rows["length"].sum() / (4096 * rows["sequence_id"].nunique())
    assert padding < 0.02


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
