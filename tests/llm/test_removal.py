"""Substring and suffix dedup against sets of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from veilsight.llm import substring_dedup, suffix_dedup

from .conftest import inputs, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def rough(spark):
    """One id with two texts, null ids, repeated rows: only what stands under a smaller id goes."""
    t, u, v = (" ".join(f"{c}{k}" for k in range(80)) for c in "tuv")
    rows = [(3, t), (5, t), (5, u), (5, u), (None, t), (None, u), (7, v), (7, v + " " + t), (7, u), (9, v), (9, v), (9, None), (8, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module", name="rough")
def _rough(spark):
    return rough(spark)


def by_words(rows, width=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def by_bytes(rows, width=200):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] = count.get(b[k : k + width], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def near(spark):
    """Near copies of one text, periodic texts, lengths about the width."""
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(40)) for _ in range(220))
    rows = []
    for i in range(40):
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice("xyzé ")
        rows.append((i, "".join(x)))
    rows += [(100, "ab" * 500), (101, "ab" * 300 + "q"), (102, "a" * 199), (103, "a" * 200), (104, "a" * 201), (105, base), (None, base), (106, "a b " * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", ["docs", "odd", "near", "rough", "empty"])
def test_words(request, name):
    df = request.getfixturevalue(name)
    assert rows_of(substring_dedup.digest(df)) == by_words(inputs(df))


@pytest.mark.parametrize("width", [5, 20, 120])
def test_words_at_other_numbers_of_levels(docs, rough, width):
    assert substring_dedup.levels(50) == [13, 25, 50] and len(substring_dedup.levels(width)) == {5: 1, 20: 2, 120: 4}[width]
    for df in (docs, rough):
        assert rows_of(substring_dedup.digest(df, width)) == by_words(inputs(df), width)


@pytest.mark.parametrize("name", ["docs", "odd", "near", "rough", "empty"])
def test_bytes(request, name):
    df = request.getfixturevalue(name)
    assert rows_of(suffix_dedup.digest(df)) == by_bytes(inputs(df))


def test_bytes_with_many_levels_and_hot_anchors(near, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 700)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    assert rows_of(suffix_dedup.digest(near)) == by_bytes(inputs(near))


def test_levels_are_suffix_arrays():
    """Order of each level, what scans find and what merges hold, against plain sets."""
    rng = random.Random(4)
    task, seen = suffix_dedup.Task(20), set()
    for k in range(40):
        segs = ["".join(rng.choices("ab", k=rng.randint(20, 60))).encode() for _ in range(30)] + [b"abc" * 20]
        some = [np.arange(31) + 100 * k] * 2 + [np.zeros(31, np.int64), np.zeros(31, bool)]
        task.batch(*some, segs)
        seen |= {s[j : j + 20] for s in segs for j in range(len(s) - 19)}
        held = [[bytes(lv.text[p : p + 20]) for p in lv.order] for lv in task.family.levels]
        assert all(x == sorted(set(x)) for x in held) and sorted(s for x in held for s in x) == sorted(seen)
        sizes = [len(x) for x in held]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    assert task.family.merges > 20 and task.family.scans > 39


def test_whole_table_meets_and_merges_levels(spark):
    """Production parameters over all segments of a stored table: levels are scanned and merged."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    segments = suffix_dedup.segments(docs)[1].select(*suffix_dedup._SEGMENTS.names).toArrow()
    task = suffix_dedup.Task(suffix_dedup.WIDTH)
    spans = sum(b.num_rows for b in suffix_dedup.index_scan(segments.to_batches(), suffix_dedup.WIDTH, task))
    assert spans > 0 and task.family.scans >= 2 and task.family.merges >= 1


def test_stage_cuts_what_the_digest_says(docs):
    left = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, _, _, sha in by_words(inputs(docs)):
        kept = " ".join(WORD.findall(left[i]["text"]))
        assert hashlib.sha256(kept.encode()).hexdigest() == sha and left[i]["n_chars"] == len(left[i]["text"])


def test_stage_on_ids_with_several_texts(rough):
    got = sorted(hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() for r in substring_dedup.remove_repeats(rough).collect())
    assert got == sorted(sha for _, _, _, sha in by_words(inputs(rough)))


def test_stage_keeps_columns(odd):
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
