"""Rules, classifier, licences and URL filters against plain statements and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from veilsight.llm import license_scan, quality_classifier, quality_rules, url_filter

from .conftest import inputs, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), sum(hit)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, n < 20 or 100 * rep > 30 * n)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_rule_counts(request, name):
    df = request.getfixturevalue(name)
    want = sorted(((i, *slow_counts(t)) for i, t in inputs(df)), key=repr)
    out = quality_rules.judge(df)
    assert rows_of(out.drop("posterior", "kept")) == want
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])


def slow_votes(t):
    """The votes, each rule stated by itself."""
    w = WORD.findall(t or "")
    n, (_, chars, symbols, dup, rep, _) = len(w), slow_counts(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    upper, lower = len(re.findall("[A-Z]", t or "")), len(re.findall("[a-z]", t or ""))
    shout = len(re.findall(r"!!(?=[ \n])", t or "")) + (t or "").endswith("!!")
    mark = re.compile(r"[#*$%&|<>]")

    def rate(k, of, good, bad):
        return 0 if not of else 1 if k / of <= good else -1 if k / of > bad else 0

    mean = chars / max(n, 1)
    some = n if n >= 20 else 0
    return [
        1 if n >= 50 else -1 if n < 20 else 0,
        rate(rep, max(n, 1), 0.05, 0.3),
        rate(symbols, max(n, 1), 0.05, 0.25),
        rate(dup, len(lines) if len(lines) > 4 else 0, 0.2, 0.45),
        rate(upper, upper + lower, 0.15, 0.4),
        rate(sum(a == b for a, b in zip(w, w[1:])), n if n > 1 else 0, 0.05, 0.2),
        0 if not n else 1 if 3 <= mean <= 12 else -1 if mean < 2 or mean > 20 else 0,
        rate(shout, n, 0.05, 0.3),
        rate(sum(bool(mark.search(x)) for x in w), n, 0.03, 0.2),
        rate(sum(bool(mark.search(x)) for x in lines), len(lines), 0.1, 0.5),
        rate(max(Counter(w).values(), default=0), some, 0.08, 0.2),
        0 if not some else 1 if len(set(w)) / min(n, 7 * n**0.5) >= 0.6 else -1 if len(set(w)) / min(n, 7 * n**0.5) < 0.3 else 0,
    ]


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_votes(request, name):
    df = request.getfixturevalue(name)
    want = sorted(((i, slow_votes(t)) for i, t in inputs(df)), key=repr)
    assert rows_of(quality_rules.rule_counts(df).select("doc_id", "votes")) == want


def drawn(rng, n, balance, good, bad):
    """Votes drawn from a model, and the classes that they were drawn from."""
    truth = rng.random(n) < balance
    right = rng.random((n, len(good))) < np.where(truth[:, None], good, bad)
    votes = np.where(right == truth[:, None], 1, -1)
    votes[rng.random(votes.shape) < 0.1] = 0
    return truth, votes


def test_em_estimates_accuracies_and_overrides_single_votes():
    m = len(quality_rules.RULES)
    rng = np.random.default_rng(2)
    good, bad = np.linspace(0.8, 0.98, m), np.linspace(0.75, 0.35, m)
    truth, votes = drawn(rng, 40000, 0.7, good, bad)
    times = Counter(map(tuple, votes.tolist()))
    model = quality_rules.fit([(list(p), n) for p, n in times.items()])
    assert model.balance == pytest.approx(0.7, abs=0.03)
    assert np.abs(np.array(model.on_good) - good).max() < 0.03 and np.abs(np.array(model.on_bad) - bad).max() < 0.06
    kept = np.array([model.posterior(v) >= 0.5 for v in votes.tolist()])
    single = (votes < 0).sum(1) == 1
    drawn_from = quality_rules.LabelModel(0.7, tuple(good), tuple(bad))
    best = np.array([drawn_from.posterior(v) >= 0.5 for v in votes.tolist()])
    assert abs((kept == truth).mean() - (best == truth).mean()) < 0.003 and kept[single].mean() > 0.95
    assert all(model.posterior([1] * k + [-1] + [1] * (m - k - 1)) > 0.5 for k in range(m))
    assert quality_rules.fit([]).posterior([0] * m) == pytest.approx(0.8)


def test_posterior_is_bayes():
    model = quality_rules.LabelModel(0.6, tuple(np.linspace(0.6, 0.9, 12)), tuple(np.linspace(0.3, 0.8, 12)))
    votes = [1, -1, 0, 1, 1, -1, -1, 0, 0, 1, -1, 1]
    a, b = 0.6, 0.4
    for v, g, d in zip(votes, model.on_good, model.on_bad):
        if v:
            a, b = a * (g if v > 0 else 1 - g), b * (d if v < 0 else 1 - d)
    assert model.posterior(votes) == pytest.approx(a / (a + b))


def test_one_bad_vote_is_outvoted_on_stored_documents(spark):
    """Clean texts that trip one rule stay, junk that trips two goes."""
    plain = " ".join(f"wo{k * 7919 % 613}rd" for k in range(120))
    shouted = " ".join(f"WO{k * 7919 % 613}RD" for k in range(120))
    starred = " ".join(f"wo{k * 7919 % 613}rd***" for k in range(120))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mine = spark.createDataFrame([(-1, plain), (-2, shouted), (-3, starred)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(rows.unionByName(mine)).where("doc_id < 0").collect()}
    assert got[-1]["kept"] and got[-2]["kept"] and not got[-3]["kept"]
    assert not any(r["base_failed"] for r in got.values())


def test_rules_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad = [got[r["doc_id"]]["kept"] for r in labels if not r["quality"]]
    fine = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] and not got[r["doc_id"]]["base_failed"]]
    assert np.mean(bad) < 0.1 and np.mean(fine) > 0.98


def test_stage_keeps_columns(odd, empty):
    out = quality_rules.keep_good(odd)
    assert out.columns == odd.columns and quality_rules.keep_good(empty).count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(rows) == docs.count() and len(held) > 40
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.93
    good, bad = ([r["score"] for r, q in held if q == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_classifier_reads_no_held_out_label(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality_classifier.F.when(quality_classifier.remainder() == 0, 1 - labels["quality"]).otherwise(labels["quality"]))
    assert rows_of(quality_classifier.classify(docs, labels)) == rows_of(quality_classifier.classify(docs, turned))


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 0), (7, None)], "doc_id long, quality int")
    got = quality_classifier.classify(odd, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and {r["doc_id"] for r in got} >= {None, 3, 4}
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    at, value = quality_classifier.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(value) > 0).all() and value[0] == 0 and value[-1] == pytest.approx(2 / 3)


def slow_scan(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_license_base(request, name):
    df = request.getfixturevalue(name)
    want = sorted(((i, *slow_scan(t)) for i, t in inputs(df)), key=repr)
    assert rows_of(license_scan.licenses(df).drop("labels", "score")) == want


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("mit-license, MIT License; mit license", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("licensed under the terms of the GNU General Public License version 3", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("All rights were reserved", ""),
        ("This file you may not use this file except in compliance with the License", "apache-2.0"),
        ("you may not use this a b c d except in compliance with the license", ""),
        ("", ""),
    ],
)
def test_templates(text, labels):
    assert license_scan.scan(text.encode())[5] == labels


def filled(template, rng):
    """A text that the template stands for: optional parts in or out, free words made up."""
    def expand(parts):
        out = []
        while parts:
            x = parts.pop(0)
            if x == "[":
                inside = expand(parts)
                out += inside if rng.random() < 0.5 else []
            elif x == "]":
                return out
            elif x[0] == "{":
                out += [f"Free{k}" for k in range(rng.randint(0, int(x[1:-1])))]
            else:
                out += x.split()
        return out

    return expand(re.findall(r"[\[\]]|\{\d+\}|[^\[\]{}]+", template))


def test_full_texts_match_and_changed_ones_do_not():
    rng = random.Random(3)
    for label, strength, template in license_scan.TEMPLATES:
        for _ in range(5):
            words = filled(template, rng)
            text = "Some words before. " + " ".join(words).upper() + " and some after"
            assert label in license_scan.scan(text.encode())[5].split(","), (label, text)
        bare = re.sub(r"\{\d+\}", "", re.sub(r"\[[^\[\]]*\]", "", re.sub(r"\[[^\[\]]*\]", "", template))).split()
        real = [k for k, w in enumerate(bare) if re.search("[a-z]", w.lower())]
        for k in rng.sample(real, min(4, len(real))):
            changed = " ".join([*bare[:k], "zzz", *bare[k + 1 :]])
            mine = license_scan.compile_template(template)
            low = license_scan.tokens(changed.encode())
            assert not any(mine.accepts(low, j) for j in range(len(low))) or "{" in template


def test_markup():
    a = license_scan.compile_template("a [b [c] d] {2} e")
    yes = ["a e", "a b d e", "a b c d e", "a x e", "a x y e", "a b d x y e"]
    assert all(a.accepts(t.encode().split()) for t in yes)
    assert not any(a.accepts(t.encode().split()) for t in ["a x y z e", "b e", "a b", ""])
    with pytest.raises(ValueError):
        license_scan.compile_template("a [b")


def slow_url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = sorted((h + p for h, p, _ in url_filter.RULES if ("." + host).endswith("." + h) and path.startswith(p)), key=len)
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    return host, path, fits[-1] if fits else None, verdicts[fits[-1]] if fits else None


def test_url_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    more = ["HTTP://A.Example.COM/en/7x", "http://com/en/", "x", None, "http://notexample.net/de/8", "http://example.net/de/8?q", "a://b://c/d", "://", "http://ÀB.org/es/#x"]
    extra = spark.createDataFrame([(1000 + k, u) for k, u in enumerate(more)], "page_id long, url string")
    df = pages.unionByName(extra)
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in ((r["page_id"], r["url"]) for r in df.collect()):
        host, path, rule, verdict = slow_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_host_words(spark):
    hosts = ["free-bets", "casino-win", "freebetscasino", "bluegarden", "blue-garden", "garden-blue", "news"] * 5
    df = spark.createDataFrame([(k, f"http://{h}.example.org/a/{k}") for k, h in enumerate(hosts)], "page_id long, url string")
    got = {r["host"].split(".")[0]: r for r in url_filter.judge(df).collect()}
    assert got["freebetscasino"]["host_words"].startswith("free bets casino") and got["freebetscasino"]["verdict"] == "block"
    assert got["bluegarden"]["host_words"].startswith("blue garden") and got["bluegarden"]["verdict"] == "allow"


@pytest.mark.parametrize("times", [1, 30])
def test_host_words_whatever_the_number_of_pages(spark, times):
    """Also where the names themselves stand on many hosts."""
    names = ["freebets", "casinowin", "cheappills", "bestcasino", "freecasinobonus"]
    hosts = [*names, *[f"garden{k}-news" for k in range(200)]]
    rows = [f"http://www{c}.{h}.example.org/a/blue{k}" for c in range(times) for k, h in enumerate(hosts)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df).where("page_id < 5").collect()}
    want = ["free bets", "casino win", "cheap pills", "best casino", "free casino bonus"]
    assert [got[k]["host_words"].split(" ")[1:-2] for k in range(5)] == [w.split() for w in want]


def splits(piece):
    """All ways to cut a piece into words of at most ``LONGEST`` letters."""
    if not piece:
        yield []
    for k in range(1, min(len(piece), url_filter.LONGEST) + 1):
        for rest in splits(piece[k:]):
            yield [piece[:k], *rest]


def test_viterbi_is_the_cheapest_split():
    known = {"the": 0.02, "ther": 0.001, "herb": 0.003, "garde": 0.2, "dens": 0.01, "shop": 0.05, "hops": 0.0001}
    price = lambda x: sum(url_filter.cost(w, known) for w in x)
    for piece in ("theherbs", "gardensshop", "freebets", "xqzvk", "thehops", "winnershops", "abc", "été4u"):
        got = url_filter.segment(piece, known)
        assert "".join(got) == piece and (len(piece) < 4 or price(got) == pytest.approx(min(map(price, splits(piece)))))
    assert url_filter.segment("freecasinobonus" * 40, {}) == ["free", "casino", "bonus"] * 40 and url_filter.segment("1234567", {}) == ["1234567"]


def slow_judgement(urls):
    """Words and naive Bayes of every URL by plain counting."""
    split = [slow_url(u)[:2] for u in urls]
    piece = lambda x: re.findall(r"[^\W_]+", x.lower())
    hosts = {}
    for h, p in split:
        for x in piece(h) + piece(p):
            hosts.setdefault(x, set()).add(h)
    plain = {x: len(v) for x, v in hosts.items() if not re.fullmatch("[0-9]+", x)}
    known = {x: n / sum(plain.values()) for x, n in plain.items() if n >= 2 and 3 <= len(x) <= 20}
    words = [
        [w if not w.isdigit() else "#" for x in piece(h) for w in url_filter.segment(x, known)]
        + ["/" + w if not w.isdigit() else "#" for x in piece(p) for w in url_filter.segment(x, known)]
        for h, p in split
    ]
    bad = [any(w.lstrip("/") in url_filter.BLOCKED_WORDS for w in x) for x in words]
    count = {y: Counter(w for x, b in zip(words, bad) if b == y for w in x) for y in (True, False)}
    some = [b for x, b in zip(words, bad) if x]
    vocabulary = {w for x in words for w in x}

    def score(x):
        if not x or not any(some):
            return 0.0
        odds = sum(some) / max(len(some) - sum(some), 1)
        for w in x:
            chance = [(count[y][w] + 0.1) / (sum(count[y].values()) + 0.1 * len(vocabulary)) for y in (True, False)]
            odds *= chance[0] / chance[1]
        return odds / (1 + odds)

    return [score(x) for x in words]


def test_naive_bayes_against_plain_counts(spark, sf):
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "x", "http://freebets.example.org/a", "http://freebets.example.org/a", "https://www.casino-win.com/en/7?x", "http://blog.winbets.net/de/1", "http:///", "http://12.34/56"]
    for some in (urls, urls[:30], []):
        df = spark.createDataFrame(list(enumerate(some)), "page_id long, url string").repartition(3)
        got = {r["page_id"]: r["score"] for r in url_filter.judge(df).collect()}
        assert [got[k] for k in range(len(some))] == pytest.approx(slow_judgement(some), abs=1e-8)
