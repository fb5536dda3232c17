"""Queries over whole texts that SQL can't state, and places of words, against plain loops."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilsight.functions import kernels as K
from veilsight.operators import assess as A
from veilsight.operators import matching as M
from veilsight.plans import text_queries as Q
from veilsight.plans.cases import KEYED, PLAIN
from veilsight.plans.registry import QUERIES
from veilsight.sources import keywords

WORDS = keywords.load()


@pytest.fixture(scope="module")
def stored(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return lambda cases: {r["doc_id"]: f"{cases[r['doc_id'] % len(cases)]} {r['text']}" for r in rows}


def slow_places(text, word):
    return [p for p in range(len(text)) if text.startswith(word, p)]


def test_places_at_any_length(spark):
    rng = random.Random(3)
    rows = [("", "가"), (None, "가"), ("가", "가가"), ("가가가", "가가"), ("토토토", "토토"), ("x" * 5000, "x"), ("é😀가" * 700 + "토토토", "토토")]
    rows += [("".join(rng.choices("ab가", k=rng.randrange(400))), "".join(rng.choices("ab가", k=rng.randrange(1, 5)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string, w string").select("t", "w", M.places(F.col("t"), F.col("w")).alias("p"))
    for r in got.collect():
        assert r["p"] == slow_places(r["t"] or "", r["w"]), (r["t"], r["w"])


def slow_latin(text, word):
    """Counts of look-alikes, leet signs and leet signs inside for each way to read the word, letter by letter."""
    kinds = [K._classify(c) for c in text]
    edge = [k is not None and k[1] in "POCSD" for k in kinds] + [False]
    out = []
    for m in re.finditer("1+", "".join(str(int(k is not None)) for k in kinds)):
        a, b = m.span()
        while a < b and kinds[a][1] == "-":
            a += 1
        while b > a and kinds[b - 1][1] == "-":
            b -= 1
        solid = sum(kinds[i][1] != "-" for i in range(a, b))
        for i in range(a, b):
            if kinds[i][1] == "-":
                continue
            at, read = i, []
            while at < b and len(read) < len(word):
                cands, kind = kinds[at]
                if kind != "-":
                    if kind in "NO" or word[len(read)] not in cands:
                        break
                    read.append(kind)
                at += 1
            if len(read) < len(word):
                continue
            free = (i == a or not edge[i - 1]) + (at == b or not edge[at])
            if free < (2 if len(word) <= 3 else 1 if len(word) <= 5 else 0):
                continue
            if not any(kinds[j][1] in "PC" for j in range(a, b)) and len(read) < solid:
                continue
            out.append((a, m.end(), sum(map(read.count, "CSD")), read.count("L"), read[1:-1].count("L")))
    return out


def slow_korean(text):
    every = [(k.word, p, p + len(k.word)) for k in WORDS.korean for p in slow_places(text, k.word)]
    own = {k.word: [(p, p + len(x)) for x in k.excludes for p in slow_places(text, x)] for k in WORDS.korean if k.word in text}
    every = [h for h in every if not any(a <= h[1] and h[2] <= b for a, b in own[h[0]])]
    return [h for h in every if not any(o != h and o[1] <= h[1] and h[2] <= o[2] for o in every)]


def slow_gate(text):
    bare = "".join(c for c in text if c not in K.T.ZERO_WIDTH)
    lower = K.fold_compat(K.decode(bare)).lower()
    hits = slow_korean(lower)
    spans, found, loose = {h[1:] for h in hits}, {h[0] for h in hits}, []
    loose = [w for w in dict.fromkeys(h[0] for h in slow_korean(K.squeeze_hangul(lower))) if len(w) >= 3 and w not in found]
    latin = {(m[0], m[1], k.word) for k in WORDS.latin for m in slow_latin(text, k.word) if m[3] == 0 or len(k.word) >= 5 and m[4] > 0}
    spans |= {m[:2] for m in latin}
    names = found | set(loose) | {m[2] for m in latin}
    kept = [k for k in (*WORDS.korean, *WORDS.latin) if k.word in names and not any(k.word != n and k.word in n for n in names)]
    close = lambda a, b: len(lower) <= 80 or bool(loose) or any(a <= e + 30 and b >= s - 30 for s, e in spans)
    cues = sum(any(close(p, p + len(c)) for p in slow_places(lower, c)) for c in A.CUES)
    contacts = 0
    for n, pattern in enumerate((A.MESSENGER, A.DOMAIN, A.PHONE, A.SHORT_LINK)):
        near = [m for m in re.finditer(pattern, lower, re.A | re.I) if close(*m.span())]
        contacts += bool([m for m in near if n != 1 or not re.search(A.PUBLIC_DOMAIN, m[1], re.A)])
    context, strong = (sum(w in lower for w in v) for v in (A.REPORT_CONTEXT, A.STRONG_CONTEXT))
    plain = K.fold_compat(K.decode(bare))
    letters = sum(unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" for c in plain)
    weight, top = sum(k.weight for k in kept), max((k.weight for k in kept), default=0)
    score = min(weight, 9) + (min(cues, 2) if weight else 0) + (2 if contacts else 0)
    blocked = not contacts and (context >= 2 or context == 1 and score < 5)
    few = letters <= 30 and 10 * sum(len(k.word) for k in kept) >= 7 * letters
    return {
        "keyword_score": weight, "max_weight": top, "score": score, "blocked": blocked, "ad_like": top >= 2 and not blocked and (score >= 3 or few),
        "hidden_ad_like": top >= 2 and (contacts > 0 or (strong < 2 if top >= 3 else context == 0)),
        "compact": len(text) <= 200 or 10 * (sum(b - a for a, b in spans) + sum(map(len, loose))) >= letters,
    }


@pytest.fixture(scope="module")
def gates(stored):
    return {i: slow_gate(t) for i, t in stored(PLAIN).items()}


@pytest.mark.parametrize("name", ["gate_score", "gate_adlike", "gate_hidden", "gate_compact"])
def test_gates_over_whole_texts(spark, sf, gates, name):
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(gates)
    for r in rows:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == {k: gates[r["doc_id"]][k] for k in r.asDict() if k != "doc_id"}, r["doc_id"]


def test_latin_words_over_whole_texts(spark, sf, stored):
    want = {i: ",".join(k.word for k in WORDS.latin if slow_latin(t, k.word)) for i, t in stored(Q.LATTICE).items()}
    assert {r["doc_id"]: r["words"] for r in QUERIES["latin_skeleton"](spark, sf).collect()} == want
    assert {want[i] for i in want if i % len(Q.LATTICE) == 0} >= {"casino"}


def test_folding_of_whole_texts(spark, sf, stored):
    keep = lambda c: "가" <= c <= "힣" or K.compat_jamo(c)
    want = {i: "".join(c if keep(c) else unicodedata.normalize("NFKC", c) for c in t) for i, t in stored(Q._WIDE).items()}
    assert {r["doc_id"]: r["folded"] for r in QUERIES["fold_compat"](spark, sf).collect()} == want


def test_keyboard_words_of_whole_texts(spark, sf, stored):
    want = set()
    for i, t in stored([k[0] for k in KEYED]).items():
        want |= {(i, w, k) for w in re.split(r"[\x20\t-\r]+", t) if (k := K.key_word_korean(w)) is not None}
    got = [tuple(r) for r in QUERIES["qwerty_korean"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    said = {(w, k) for _, w, k in got}
    assert said >= {(w, k) for w, k in KEYED if k}


def slow_align(text):
    fold = lambda s: s.translate(K.T.FUZZY)
    units = K.jamo_units(text)
    for k in WORDS.korean:
        n = len(k.jamo)
        for at in range(len(units) - n + 1):
            span = units[at : at + n]
            if not n or span[0].kind == "S" and not span[0].first or span[-1].kind == "S" and not span[-1].last:
                continue
            off = [u for u, c in zip(span, k.jamo) if c not in u.cands]
            like = all(u.kind not in "SB" and fold(c) in fold(u.cands) for u, c in zip(span, k.jamo) if c not in u.cands)
            if not off or len(off) == 1 and n >= 5 and like:
                kinds = "".join(u.kind for u in span)
                yield k.word, span[0].src, span[-1].src + 1, kinds.count("J"), kinds.count("L"), kinds.count("S"), len(off)


def test_alignment_over_whole_texts(spark, sf, stored):
    texts = stored(Q.ALIGN)
    want = Counter((i, *m) for i, t in texts.items() for m in slow_align(t))
    assert Counter(tuple(r) for r in QUERIES["jamo_align"](spark, sf).collect()) == want
    assert {(i % len(Q.ALIGN), m) for i, m, *_ in want} >= {(0, "카지노"), (1, "카지노"), (2, "바카라"), (4, "카지노"), (5, "카지노")}
