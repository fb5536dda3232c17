"""URL filters: rules by host and path, and for the rest host word segmentation with naive Bayes.

Host labels and path parts are split at everything but letters and digits, and each different piece is split
into words by a unigram Viterbi search, as hosts run words together. A word of the unigram model is a piece
that stands by itself on ``HOSTS`` different hosts or more, counted exactly over all URLs (a name run together
is a piece of its own host, so it doesn't become a word by being there), or one of a short list of seed
words. Multinomial naive Bayes is trained on all URLs, those with a seed word of blocked topics in host or
path being the blocked class, as URLs come without labels; its counts are exact as well, and grow with the
words that there are. Everything is a table: candidate words of a piece, its segmentation and the evidence
of a word are looked up by joins. Keys that make up ``1 / OFTEN`` of all rows or more, ``OFTEN`` at most,
are looked up in a broadcast table, so no key is hot in a shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and the verdict of
no words (allow); repeated rows are judged each by itself; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import emit, materialise

#: Host suffix, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Seed words of blocked topics and of ordinary hosts.
BLOCKED_WORDS = (
    "adult bet bets betting bonus casino cialis click erotic escort farm gamble gambling hack jackpot loan loans lottery "
    "nude phish pills poker porn prize scam sex slots spam torrent viagra warez win winner x xxx"
).split()
PLAIN_WORDS = (
    "about article best blog book buy cheap city com data day de docs edu en es example family food forum fr free game garden gov green health help "
    "home house html info it job learn library life light live local love mail market media money music my net new news now on one online open org "
    "page park photo play post red river school science shop site sky social sport star store support tech the time top travel tree tv video water "
    "weather web wiki work world www you"
).split()

#: Counts of words are taken as of a corpus of this size, in which each seed word occurs ``SEED`` times.
CORPUS, SEED = 100.0, 1000.0
#: Least number of hosts on which a piece stands by itself to be a word, and shortest and longest word.
HOSTS, SHORTEST, LONGEST = 2, 3, 20
OFTEN = 4096
#: Laplace smoothing of naive Bayes.
SMOOTHING = 0.1
TOTAL = CORPUS + SEED * (len(BLOCKED_WORDS) + len(PLAIN_WORDS))
_SEEDS = frozenset(w for w in (*BLOCKED_WORDS, *PLAIN_WORDS) if len(w) > 1)
_BLOCKED = frozenset(BLOCKED_WORDS)
_PIECE = re.compile(r"[^\W_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))
    host = "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host])
    return host, tail[:cut]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, as text, and its verdict."""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pieces(part: str) -> list[str]:
    return _PIECE.findall(part.lower())


def cost(word: str, known: dict[str, float]) -> float:
    """Negative log probability, ``known`` holding the share of all hosts' pieces that a word has.

    What is no seed word costs more the longer it is, and unseen letters cost most. Shares are damped by the
    root and by length, as a run-together name may be frequent; being shares, they split a piece alike
    however many pages there are.
    """
    if word in _SEEDS:
        return math.log(TOTAL / SEED)
    unseen = math.log(TOTAL) + 2.5 * len(word)
    share = known.get(word, 0.0)
    return min(unseen, math.log(TOTAL) - 0.5 * math.log(CORPUS * share) + 0.7 * max(0, len(word) - 6)) if share else unseen


def segment(piece: str, known: dict[str, float]) -> list[str]:
    """Viterbi over all splits into words of at most ``LONGEST`` letters; digits stay whole."""
    n = len(piece)
    if n < 4 or piece.isdigit():
        return [piece]
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            c = best[start] + cost(piece[start:end], known)
            if c < best[end]:
                best[end], back[end] = c, start
    out, at = [], n
    while at:
        out.append(piece[back[at] : at])
        at = back[at]
    return out[::-1]


def substrings(piece: str) -> set[str]:
    """What may be a word in a piece and is no seed word."""
    n = len(piece)
    if n < 4 or piece.isdigit():
        return set()
    return {piece[a:b] for a in range(n) for b in range(a + SHORTEST, min(a + LONGEST, n) + 1)} - _SEEDS


_URLS = pa.schema(
    [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("rule_verdict", pa.string())]
    + [("pieces", pa.list_(pa.string())), ("n_host", pa.int32())]
)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, rule_verdict, pieces, n_host``: the first ``n_host`` pieces are the host's."""

    def run(batches):
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = [rule_for(h, p, rules) for h, p in split]
            of_host = [pieces(h) for h, _ in split]
            cols = dict(host=[h for h, _ in split], path=[p for _, p in split], rule=[r for r, _ in fits], rule_verdict=[v for _, v in fits])
            yield emit(_URLS, page_id=batch.column(0), pieces=[a + pieces(p) for a, (_, p) in zip(of_host, split)], n_host=list(map(len, of_host)), **cols)

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return src.mapInArrow(run, "page_id long, host string, path string, rule string, rule_verdict string, pieces array<string>, n_host int")


def attached(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Inner join with ``known``, one row per ``key`` with its number of rows ``times``; frequent keys are broadcast, the rest shuffled."""
    total = known.agg(F.sum("times")).first()[0] or 0
    heavy = F.broadcast(known.where(F.col("times") * OFTEN >= total))  # OFTEN rows at most
    light = known.where(F.col("times") * OFTEN < total)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key)).drop("times")


_SPLIT = pa.schema([("piece", pa.string()), ("times", pa.int64()), ("words", pa.list_(pa.string()))])


def segmented(urls: DataFrame) -> DataFrame:
    """``piece, times, words`` of every different piece of host or path."""
    each = urls.select("host", F.explode("pieces").alias("piece"))
    counts = each.groupBy("piece").agg(F.count("*").alias("times"))
    hosts = each.distinct().groupBy("piece").agg(F.count("*").alias("hosts"))
    counts = materialise(counts.join(hosts, "piece"), "pieces")
    total = counts.where(~F.col("piece").rlike("^[0-9]+$")).agg(F.sum("hosts")).first()[0] or 1
    alone = (F.col("hosts") >= HOSTS) & F.length("piece").between(SHORTEST, LONGEST) & ~F.col("piece").rlike("^[0-9]+$")
    vocabulary = counts.where(alone).select(F.col("piece").alias("word"), (F.col("hosts") / F.lit(float(total))).alias("share"))

    parts = pa.schema([("piece", pa.string()), ("word", pa.string())])

    def cut(batches):
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                found = sorted(substrings(piece))
                if found:
                    yield emit(parts, piece=[piece] * len(found), word=found)

    def split(batches):
        for batch in batches:
            of = batch.column(0).to_pylist()
            known = [{x["word"]: x["share"] for x in row or ()} for row in batch.column(2).to_pylist()]
            yield emit(_SPLIT, piece=of, times=batch.column(1), words=[segment(p, k) for p, k in zip(of, known)])

    candidates = counts.select("piece").mapInArrow(cut, "piece string, word string").join(vocabulary, "word")
    candidates = candidates.groupBy("piece").agg(F.collect_list(F.struct("word", "share")).alias("known"))
    rows = counts.select("piece", "times").join(candidates, "piece", "left")
    return rows.mapInArrow(split, "piece string, times long, words array<string>")


def worded(urls: DataFrame) -> DataFrame:
    """``urls`` (with a number ``row``) with ``words``, those of the path marked and numbers being one word, and ``host_words``."""
    split = materialise(segmented(urls), "segmented")
    each = urls.select("row", "n_host", F.posexplode("pieces").alias("at", "piece"))
    each = attached(each, split, "piece").select("row", "at", (F.col("at") < F.col("n_host")).alias("in_host"), "words")
    lists = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "in_host", "words"))).alias("x"))
    marked = lambda x: F.transform(
        x["words"], lambda w: F.when(w.rlike("^[0-9]+$"), "#").when(x["in_host"], w).otherwise(F.concat(F.lit("/"), w))
    )
    lists = lists.select("row", F.flatten(F.transform("x", marked)).alias("words"), F.array_join(F.flatten(F.transform(F.filter("x", lambda x: x["in_host"]), lambda x: x["words"])), " ").alias("host_words"))
    none = F.array().cast("array<string>")
    return urls.join(lists, "row", "left").withColumn("words", F.coalesce("words", none)).withColumn("host_words", F.coalesce("host_words", F.lit("")))


def scored(rows: DataFrame) -> DataFrame:
    """``row, score`` of ``row, words``: naive Bayes of the blocked class, which a seed word of blocked topics marks; 0 where no page is blocked."""
    seeds = F.array(*[F.lit(w) for w in sorted(_BLOCKED)])
    bad = F.exists("words", lambda w: F.array_contains(seeds, F.ltrim(w, F.lit("/"))))
    rows = rows.where(F.size("words") > 0).select("row", "words", bad.alias("blocked"))
    n = rows.agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("fine")).first()
    each = rows.select("row", "blocked", F.explode("words").alias("word"))
    counts = materialise(each.groupBy("word").agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("fine")), "words")
    sums = counts.agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"), F.count("*").alias("words")).first()
    if not n["bad"]:
        return rows.select("row", F.lit(0.0).alias("score"))
    floor = SMOOTHING * sums["words"]
    chance = lambda c: (F.col(c) + SMOOTHING) / F.lit(sums[c] + floor)
    evidence = counts.select("word", (F.col("bad") + F.col("fine")).alias("times"), (F.log(chance("bad")) - F.log(chance("fine"))).alias("weight"))
    z = F.sum("weight") + F.lit(math.log(n["bad"] / max(n["fine"], 1)))
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))
    return attached(each.select("row", "word"), evidence, "word").groupBy("row").agg((F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Host, path, rule and verdict of every row, with the classifier's score and the words of the host."""
    urls = materialise(parsed(pages, rules).withColumn("row", F.monotonically_increasing_id()), "urls")
    rows = materialise(worded(urls), "worded")
    out = rows.join(scored(rows), "row", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, "score", "host_words")
