"""Keyword matching as column expressions: the dictionary is a literal array, so nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.keywords import Dictionary, Keyword


#: Latin keywords shorter than this are not looked for among letters that invisible marks part.
REVEALED = 4


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again for every element that a lambda inside looks at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyword_array(words: tuple[Keyword, ...]) -> Column:
    rows = [
        F.struct(
            F.lit(k.kw_id).alias("kw_id"), F.lit(k.word).alias("word"), F.lit(k.weight).alias("weight"), F.lit(k.category).alias("category"),
            F.array(*map(F.lit, k.excludes)).cast("array<string>").alias("excludes"), F.lit(k.jamo).alias("jamo"),
        )
        for k in words
    ]
    return F.array(*rows)


def places(text: Column, word: Column) -> Column:
    """Zero-based starts of all occurrences, overlapping ones too.

    A text is looked at in about as many parts as each has characters, and only parts that hold the word place by place:
    finding a place in a string costs its distance from the front, so one pass over a long text would be quadratic.
    """
    none = F.array().cast("array<int>")
    step = F.ceil(F.sqrt(F.length(text))).cast("int") + F.length(word)
    part = lambda a: F.struct(a.alias("at"), F.substring(text, a, step + F.length(word) - 1).alias("t"))
    parts = F.filter(F.transform(F.sequence(F.lit(1), F.length(text), step), part), lambda p: F.contains(p["t"], word))

    def of(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(p["t"]) - F.length(word) + 1)
        return F.transform(F.filter(starts, lambda i: F.substring(p["t"], i, F.length(word)) == word), lambda i: p["at"] + i - 2)

    return F.when(F.contains(text, word) & (F.length(word) > 0), F.flatten(F.transform(parts, of))).otherwise(none)


def scan(text: Column | str, words: Dictionary) -> Column:
    """Array of ``kw_id, word, start, end, excluded``: every place of every Korean keyword."""
    t = _c(text)
    present = F.filter(keyword_array(words.korean), lambda k: F.contains(t, k["word"]))

    def of(k: Column) -> Column:
        barred = F.flatten(F.transform(k["excludes"], lambda x: F.transform(places(t, x), lambda p: F.struct(p.alias("a"), (p + F.length(x)).alias("b")))))
        hit = lambda p, spans: F.struct(
            k["kw_id"].alias("kw_id"), k["word"].alias("word"), k["weight"].alias("weight"), p.alias("start"), (p + F.length(k["word"])).alias("end"),
            F.exists(spans, lambda s: (s["a"] <= p) & (s["b"] >= p + F.length(k["word"]))).alias("excluded"),
        )
        return let(barred, lambda spans: F.transform(places(t, k["word"]), lambda p: hit(p, spans)))

    return F.flatten(F.transform(present, of))


def longest(hits: Column) -> Column:
    """Hits outside excluding phrases that no other hit contains; containment is transitive, so one pass will do."""
    inside = lambda h, o: (o["kw_id"] != h["kw_id"]) & (o["start"] <= h["start"]) & (o["end"] >= h["end"])
    return let(F.filter(hits, lambda h: ~h["excluded"]), lambda live: F.filter(live, lambda h: ~F.exists(live, lambda o: inside(h, o))))


def subsume(words: Column) -> Column:
    """Words that are not inside a longer one."""
    return let(words, lambda each: F.filter(each, lambda w: ~F.exists(each, lambda o: (F.length(o) > F.length(w)) & F.contains(o, w))))


def present(text: Column | str, vocabulary: list[str]) -> Column:
    t = _c(text)
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(t, w))


def revealed(text: Column | str, words: Dictionary) -> Column:
    """Keywords that a text holds only without its invisible marks."""
    from ..functions.text import strip_zero_width

    known = F.array(*[F.lit(k.word) for k in (*words.korean, *(x for x in words.latin if len(x.word) >= REVEALED))])
    held = lambda t: F.filter(known, lambda w: F.contains(t, w))
    both = lambda x: F.array_except(held(x["bare"]), held(x["raw"]))
    t = _c(text)
    bare = strip_zero_width(t)
    pair = F.struct(F.lower(t).alias("raw"), F.lower(bare).alias("bare"))
    return F.when(bare != t, let(pair, both)).otherwise(F.array().cast("array<string>"))


def beside(text: Column, word: Column, spans: Column, within: int = 30) -> Column:
    """Whether a word touches the reach of one of the spans; only what lies about them is read."""

    def about(s: Column) -> Column:
        left = F.greatest(F.lit(0), s["start"] - within - F.length(word))
        return F.contains(F.substring(text, left + 1, s["end"] + within + F.length(word) - left), word)

    return F.exists(spans, about)


def latin_boundary(word: str) -> str:
    """Edges by length, as a pattern: both up to three letters, one up to five, none beyond."""
    left, right = "(?:^|[^a-z])", "(?:$|[^a-z])"
    if len(word) <= 3:
        return f"{left}{word}{right}"
    return f"(?:{left}{word}|{word}{right})" if len(word) <= 5 else word


def latin_words(text: Column | str, words: Dictionary) -> Column:
    """Latin keywords in plain text; disguised ones need the lattice of ``functions.kernels``."""
    t = F.lower(_c(text))
    return F.array_compact(F.array(*[F.when(t.rlike(latin_boundary(k.word)), F.lit(k.word)) for k in words.latin]))


def scattered(text: Column | str, words: Dictionary) -> Column:
    """The longest keyword whose jamo stand in a text's single jamo, the earlier one on ties."""
    from ..functions.text import lone_jamo

    long = tuple(k for k in words.korean if len(k.jamo) >= 4)
    rank = lambda j, k: F.struct(F.length(k["jamo"]).alias("n"), (-F.instr(j, k["jamo"])).alias("p"), (-k["kw_id"]).alias("i"), k["word"].alias("word"))
    fit = lambda j: F.transform(F.filter(keyword_array(long), lambda k: F.contains(j, k["jamo"])), lambda k: rank(j, k))
    return let(lone_jamo(text), lambda j: F.array_max(fit(j))["word"])
