"""Mixing, packing and the pipeline."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilsight.llm import mixing, packing

from .conftest import inputs, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        room = total - sum(fixed.values())
        share = {s: room * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_mix(request, name):
    df = request.getfixturevalue(name)
    sizes = defaultdict(int)
    for r in df.select("source", "text").collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = slow_targets(sizes) if sizes else {}
    taken = defaultdict(int)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["taken"] // max(r["size"], 1) in (0, 1, 2, 3)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.001
    assert rows_of(mixing.mix(df)) == rows_of(mixing.mix(df.repartition(2)))


@pytest.mark.parametrize("edge_rows", [1, 3, 40])
def test_edges_are_looked_into(docs, edge_rows):
    """Cells of any size give the same mix."""
    assert rows_of(mixing.mix(docs, edge_rows=edge_rows)) == rows_of(mixing.mix(docs))


def test_sample_of_rows_with_shared_ids(spark):
    """Null ids, one id with several texts and sources, repeated rows: each row by itself."""
    text = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(None, text("a", 2), "s"), (None, text("b", 100), "s"), (1, text("c", 40), "s"), (1, text("d", 7), "s"), (1, text("c", 40), "t")]
    rows += [(2, text("e", 9), "t")] * 5 + [(None, None, None), (3, "", None), (4, text("f", 3), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got = defaultdict(int)
    out = mixing.sample(df).collect()
    for r in out:
        got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    assert got == {k: n for k, n in want.items() if n}
    heads = {t for _, t, _ in rows if t}
    assert all(any(t.startswith(r["text"]) for t in heads) for r in out)
    assert sum(r["text"] == text("b", 100) for r in out) <= 3


def test_sample_on_odd_rows(odd, empty):
    out = mixing.sample(odd)
    assert out.columns == odd.columns and mixing.sample(empty).count() == 0
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.mix(odd).collect())


def test_heavier_documents_come_first_more_often(spark):
    rows = [(k, ("a " * 40 if k % 2 else " ".join(f"w{k}x{j}" for j in range(40))), "s" if k < 2000 else "t") for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    picked = [r for r in mixing.mix(df, weights=(1, 9)).collect() if r["source"] == "s" and r["taken"] % r["size"] == 0 and r["taken"]]
    rich = sum(r["doc_id"] % 2 == 0 for r in picked)
    assert rich > 0.75 * len(picked)


def test_sample_is_the_mix(docs):
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    out = mixing.sample(docs)
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert out.columns == docs.columns and got == {i: n for i, n in want.items() if n}


def check_packing(df, capacity=packing.CAPACITY):
    exact = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(df, capacity=capacity).collect()
    seqs = defaultdict(list)
    ids = {}
    for i, t in inputs(df):
        ids[i] = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    pieces = defaultdict(set)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= capacity and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].add((r["piece"], r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(found)):
            assert piece == k and start == at and (k == 0 or length == capacity)
            at += length
        assert at == len(ids[i])
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, len(seqs)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    rows, used = check_packing(df)
    total = sum(r["length"] for r in rows)
    assert used <= math.ceil(total / packing.CAPACITY) * 1.01 + 1


def test_special_strings_go_through_the_exact_library(spark):
    check_packing(spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "  two  blanks \n\n x"), (3, "don't 123 ½ \u00a0 中文")], "doc_id long, text string"))


def triples(rng, n):
    """Pieces of which three fill a bin just so."""
    out = []
    for _ in range(n):
        a, b = rng.randint(600, 800), rng.randint(500, 700)
        out += [a, b, 2048 - a - b]
    return out


@pytest.fixture(scope="module")
def tight(spark):
    """Four regions' worth of triples, as pieces."""
    rng = random.Random(6)
    return [(k, x) for k, x in enumerate(triples(rng, 240))]


def test_islands_need_fewer_bins_than_best_fit(spark, tight):
    """Best-fit misses the bound in every region; islands need fewer bins, and the packing is whole."""
    df = spark.createDataFrame(tight, "uid long, length long").repartition(3)
    got = packing.pack_regions(df, size=180).collect()
    size, bins = dict(tight), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], size[r["uid"]]))
    assert sorted(r["uid"] for r in got) == sorted(size)
    for x in bins.values():
        ends = [0] + [a + n for a, n in sorted(x)]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048
    regions = defaultdict(list)
    for r in got:
        regions[r["sequence_id"] >> 22].append(r)
    plain = better = 0
    for rows in regions.values():
        sizes, loads = [size[r["uid"]] for r in rows], []
        packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], loads, 2048)
        mine = len({r["sequence_id"] for r in rows})
        assert {r["region_bins"] for r in rows} == {mine} and {r["region_bound"] for r in rows} == {-(-sum(sizes) // 2048)}
        plain, better = plain + len(loads), better + mine
        assert mine <= len(loads)
    assert len(regions) == 4 and better < plain


def test_elites_migrate(spark, tight, monkeypatch):
    """Epochs write populations; an island holds the best that its neighbour had, and never gets worse."""
    tables, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    sizes = [x for _, x in tight[:180]]
    df = spark.createDataFrame([(0, sizes, -(-sum(sizes) // 2048))], "region long, sizes array<int>, bound long")
    best = packing.evolved(df).collect()
    states = [{r["island"]: r for r in t.collect()} for name, t in tables if name == "islands"]
    assert len(states) == packing.EPOCHS and all(len(s) == packing.ISLANDS for s in states)
    for old, new in zip(states, states[1:]):
        for k in range(packing.ISLANDS):
            assert new[k]["bins"] <= min(old[k]["bins"], old[(k - 1) % packing.ISLANDS]["bins"])
    assert best[0]["bins"] == min(r["bins"] for r in states[-1].values())


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, out, sf), name)
        assert out.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert rows and words > 0 and {r["doc_id"] for r in rows} == {r["doc_id"] for r in out.collect()}


@pytest.mark.parametrize("name", ["odd", "shared", "empty"])
def test_stages_on_odd_tables(spark, request, name):
    """Nulls, one id with several texts, null ids, repeated rows, clashing columns: every stage keeps the columns, and packing is whole."""
    if name == "shared":
        text = lambda c, n: " ".join(f"{c}{k % 97}x{k}" for k in range(n))
        rows = [(3, text("a", 90), "s"), (5, text("a", 90), "s"), (5, text("b", 90), "t"), (None, text("c", 60), None), (None, text("d", 60), "t"), (5, text("b", 90), "t"), (None, None, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    else:
        df = request.getfixturevalue(name)
    out = df
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, out, ""), stage_name)
        assert out.columns == df.columns
        if name == "shared" and stage_name == "simhash_near_dedup":
            kept = sorted(((r["doc_id"], r["text"][0]) for r in out.collect()), key=repr)
            assert kept == [(3, "a"), (5, "b"), (None, "c"), (None, "d")]
        if name == "shared" and stage_name == "substring_dedup":
            assert sorted(len(r["text"].split()) for r in out.collect()) == [60, 60, 90, 90]
    rows = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert all(n <= packing.CAPACITY for n in used.values()) and (len(rows) >= out.count() or name == "empty")
