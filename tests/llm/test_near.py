"""SimHash against all pairs; similar documents against exact Jaccard; chunk fingerprints against the plain loop."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from veilsight.llm import chunk_fingerprint, simhash

from .conftest import inputs, rows_of


def slow_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(keys, linked):
    """Smallest key reachable, by flooding over all pairs."""
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for k, x in zip(keys, label):
        if k is not None:
            least[x] = min(least.get(x, k), k)
    return [least.get(x) for x in label]


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_simhash(request, name):
    rows = inputs(request.getfixturevalue(name))
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = reachable([i for i, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    want = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, comp)), key=repr)
    got = rows_of(simhash.near_duplicates(request.getfixturevalue(name)))
    assert sorted(((i, f % (1 << 64), c) for i, f, c in got), key=repr) == want


def test_spark_hashes_alike(spark):
    got = spark.sql("select xxhash64('a b c') as h").first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_of_large_buckets(spark):
    rng = random.Random(1)
    c, x = rng.getrandbits(64), set()
    for _ in range(600):
        y = c
        for b in rng.sample(range(64), rng.randint(0, 5)):
            y ^= 1 << b
        x.add(y)
    x = sorted(x)
    want = reachable(x, lambda i, j: (x[i] ^ x[j]).bit_count() <= 2)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in x], "fp long")
    for rows in (50, 8192):
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in rows_of(simhash.links(df, bucket_rows=rows))]
        pairs = {frozenset(e) for e in edges}
        assert reachable(x, lambda i, j: frozenset((x[i], x[j])) in pairs) == want


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, groups = [], []
    for g in range(40):
        base = [word() for _ in range(300)]
        members = []
        for _ in range(rng.randint(1, 4)):
            x = list(base)
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = word()
            members.append(len(rows))
            rows.append((len(rows), " ".join(x)))
        other = list(base)
        for k in rng.sample(range(300), 120):
            other[k] = word()
        groups += [members, [len(rows)]]
        rows.append((len(rows), " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == {min(g) for g in groups}


def at_similarity(rng, shared, own, word):
    """Two texts whose sets of five-word shingles share ``shared``; the second has ``own`` more."""
    a = [word() for _ in range(shared + 4)]
    return " ".join(a), " ".join(a + [word() for _ in range(own)])


@pytest.mark.parametrize("group_shingles", [3000, simhash.GROUP_SHINGLES])
def test_links_hold_on_the_sets_themselves(spark, group_shingles):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    rows, want = [], []
    for shared, own in [(20, 5), (20, 6), (400, 126), (400, 119), (400, 109), (400, 101), (400, 100), (400, 94), (400, 88), (400, 76)] * 12:
        for text in at_similarity(rng, shared, own, word):
            rows.append((len(rows), text))
        first = rows[-2][0]
        want += [first, first if 5 * shared >= 4 * (shared + own) else first + 1]
    chain = [word() for _ in range(404 + 8 * 60)]
    for k in range(9):  # neighbours at 340/460, so none is linked, but all are proposed
        rows.append((len(rows), " ".join(chain[60 * k : 60 * k + 404])))
        want.append(rows[-1][0])
    rows += [(None, x) for x in at_similarity(rng, 400, 90, word)] + [(7, rows[0][1] + " and other words at its end that are many enough")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_documents(df.repartition(3), group_shingles=group_shingles).where("doc_id is not null").collect()
    seen = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] != 7}
    assert [i for i, w in enumerate(want) if i != 7 and seen[i] != w] == []


def slow_groups(texts_):
    """Groups of texts linked by an exact Jaccard similarity of 0.8 over five-word shingles."""
    sets = []
    for t in texts_:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    linked = lambda i, j: not (sets[i] or sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    return reachable(list(range(len(sets))), linked)


def test_one_of_each_group_stays_whatever_the_ids(spark):
    """One id with several texts, null ids, repeated rows, copies in another case."""
    t, u, v, w = (" ".join(f"{c}{k}" for k in range(60)) for c in "tuvw")
    rows = [(3, t), (5, t), (5, u), (5, u), (None, u), (None, v), (None, v), (None, w), (6, w + " tail"), (7, t.upper()), (7, v), (8, None), (8, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts_ = sorted({x for _, x in rows}, key=repr)
    group = dict(zip(texts_, slow_groups(texts_)))
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    assert len({group[x] for _, x in kept}) == len(kept) == len(set(group.values()))
    for i, x in kept:
        ids = [k for k, y in rows if group[y] == group[x] and k is not None]
        assert i == min(ids, default=None)


def test_recall_about_the_threshold(spark):
    """Pairs whose sets have a similarity of 0.80 to 0.85: what bands and fingerprints propose, against exact counts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    rows, pairs = [], 0
    for k in range(600):
        shared = rng.randint(30, 500)
        most = shared // 4  # at shared / 0.8 the union has a quarter more
        own = rng.randint(-(-shared * 3 // 17), most)
        for text in at_similarity(rng, shared, own, word):
            rows.append((len(rows), text))
        assert 0.8 <= shared / (shared + own) <= 0.851
        pairs += 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(pairs))
    assert found >= 0.99 * pairs


def test_stored_documents_against_exact_similarity(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows.sort()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    group = slow_groups([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[g][0] for g in group]


def test_stage_on_odd_rows(odd, empty):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert sum(r["text"] is not None and r["text"].startswith("The quick") for r in got) == 1
    assert simhash.keep_one(empty).count() == 0


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_fingerprint._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_is_the_rolling_hash():
    data = bytes(random.Random(4).randrange(256) for _ in range(500))
    assert chunk_fingerprint.gear(data).tolist() == slow_gear(data)


def slow_cuts(data):
    h, out, at = slow_gear(data), [], 0
    while at < len(data):
        end = at + chunk_fingerprint.LEAST
        while end < len(data):
            mask = chunk_fingerprint.STRICT if end - at < chunk_fingerprint.MEAN else chunk_fingerprint.LOOSE
            if h[end - 1] & int(mask) == 0 or end - at >= chunk_fingerprint.MOST:
                break
            end += 1
        at = min(end, len(data))
        out.append(at)
    return out


def test_boundaries_against_a_scan():
    rng = random.Random(8)
    for n in (0, 1, 23, 24, 25, 64, 300, 5000):
        data = bytes(rng.randrange(97, 110) for _ in range(n))
        assert chunk_fingerprint.boundaries(data) == slow_cuts(data)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_next_documents(request, name):
    K = chunk_fingerprint
    df = request.getfixturevalue(name)
    rows = sorted(((i, t or "") for i, t in inputs(df)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = K.edited(t, after)
        a, b, c = (K.chunk_lengths(x.encode()) for x in (t, new, after))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), K.text_of(a), K.text_of(b), K.likeness(a, b), K.likeness(a, c)))
    assert rows_of(K.fingerprint_with_next(df)) == sorted(want, key=repr)


def test_fingerprints_read_back():
    a = chunk_fingerprint.chunk_lengths(b"some text that is long enough to have chunks " * 20)
    assert chunk_fingerprint.chunks_of(chunk_fingerprint.text_of(a)) == a and chunk_fingerprint.likeness(a, a) == 1.0
    assert chunk_fingerprint.likeness({}, {}) == 1.0 and chunk_fingerprint.likeness(a, {}) == 0.0
