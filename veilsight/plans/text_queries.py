"""Queries over text: folding, keyword matching, the gate, disguises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.udfs import align_udf, compose_udf, decode_udf, fold_udf, keyed_udf, latin_udf
from ..operators import assess as A
from ..operators import matching as M
from ..operators.verdicts import TEXT_CHECKS, verdict_udf
from ..sources.keywords import load
from ..sources.tables import spread
from . import sqlgen as S
from .cases import DECODES, KEYED, PLAIN, VERDICTS
from .registry import pick, query, sql_pick, sql_text, table

DICT = load()
_KO = "(VALUES " + ", ".join(f"({k.kw_id}, {sql_text(k.word)}, {k.weight}, {'[' + ', '.join(map(sql_text, k.excludes)) + ']::VARCHAR[]'}, {sql_text(k.jamo)})" for k in DICT.korean) + ") AS k(kw_id, word, weight, excludes, jamo)"


def _sql_cases(cases: list[str]) -> str:
    return f"(SELECT doc_id, {sql_pick(cases, 'doc_id')} || ' ' || text AS t FROM documents)"


#: Every text is looked at in pieces of this many places, as finding a place in a string costs its distance from the front.
_STEP = 200


def _sql_places(rows: str, word: str) -> str:
    """Rows with ``s`` and ``e`` for every place of a word in ``t``."""
    piece = f"substr(t, a, {_STEP - 1} + length({word}))"
    held = f"SELECT *, {piece} AS piece FROM (SELECT *, unnest(range(1, length(t) + 1, {_STEP})) AS a FROM {rows} WHERE contains(t, {word})) WHERE contains({piece}, {word})"
    tried = f"SELECT *, unnest(range(1, {_STEP + 1})) AS i FROM ({held})"
    return f"(SELECT * EXCLUDE (a, i, piece), (a + i - 2)::INTEGER AS s, (a + i - 2 + length({word}))::INTEGER AS e FROM ({tried}) WHERE substr(piece, i, length({word})) = {word})"


def _whole(spark: SparkSession, sf_dir: str, cases: list[str]) -> DataFrame:
    """A made-up case before each whole stored text, as those hold no Hangul."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(cases, F.col("doc_id")), F.lit(" "), "text").alias("t"))


def _dealt(spark: SparkSession, sf_dir: str, cases: list[str]) -> DataFrame:
    """The same, for work that is heavy in each row."""
    return spread(_whole(spark, sf_dir, cases))


def _fold(name: str, cases: list[str], column, sql: str) -> None:
    """Folds both a made-up case and the stored text."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _whole(spark, sf_dir, cases).select("doc_id", column(F.col("t")).alias("v"))

    f.__name__ = name
    query(f"SELECT doc_id, {sql} AS v FROM {_sql_cases(cases)}")(f)


_WIDE = ["ｃａｓｉｎｏ ７７７", "𝐜𝐚𝐬𝐢𝐧𝐨", "plain", "ⓒⓐⓢⓘⓝⓞ", "Ａ－Ｂ＿Ｃ"]
_JAMO = ["ㅋㅏㅈㅣㄴㅗ", "ﾡￂ ﾤￃ", "각 가", "ㅘㄳ ㅄ", "안녕 ㅋㅋ"]
for _name, _cases_of, _column, _sql in (
    ("script_fold", ["сasinо", "Κасино", "рокеr", "łóź ø", "plain"], X.fold_script, S.translate("t", T.script_pairs())),
    ("fullwidth_fold", _WIDE, X.fold_width, S.translate("t", T.compat_pairs())),
    ("diacritic_fold", ["café naïve", "Ångström", "plain", "żółw ǵ"], X.fold_diacritics, S.translate("t", T.diacritic_pairs())),
    ("jamo_compat_fold", _JAMO, X.to_compat_jamo, S.translate("t", T.jamo_pairs())),
    ("jamo_fuzzy_class", _JAMO + ["ㅋㄲㅌㄸㅍㅃㅔㅖ"], X.fuzzy_class, S.translate("t", (T.FUZZY_FROM, T.FUZZY_TO))),
    ("look_jamo", ["7r지노", "口人o", "plain Lc"], X.looks_to_jamo, S.translate("t", T.look_pairs())),
    ("lone_jamo", _JAMO, X.lone_jamo, S.lone_jamo("t")),
    ("zero_width_strip", ["카​지​노", "so­ft", "plain", "a⁠b﻿c"], X.strip_zero_width, S.sub("t", S.char_class(T.ZERO_WIDTH))),
    ("space_collapse", ["a 　 b", "  x\t\ty ", "plain"], X.collapse_space, f"trim({S.sub('t', S.char_class(T.BROWSER_SPACE) + '+', ' ')})"),
    ("squeeze_hangul", ["카.지.노 사 이 트", "가--나", "가---나", "카a지", "바 · 카 · 라"], X.squeeze_hangul, S.squeeze("t")),
    ("has_jamo", _JAMO + ["가나다"], X.has_jamo, S.has("t", "[ㄱ-ㅣ" + "".join(T.JAMO_FORMS) + "]")),
    ("interesting", ["c4sino", "안녕하세요", "12 34", "가1", "ab"], X.interesting, S.has("t", X.INTERESTING)),
    ("count_letters", ["①②③ Ⅳ a1가", "!!!", "한글 abc 123"], X.count_letters, f"len(regexp_extract_all(t, {sql_text(X.ALNUM)}))::INTEGER"),
    ("count_syllables", ["한글 abc", "ㅋㅋ", "가나다"], X.count_syllables, "len(regexp_extract_all(t, '[가-힣]'))::INTEGER"),
    ("evidence_clip", ["x" * 600, "short"], X.evidence, "substr(t, 1, 500)"),
):
    _fold(_name, _cases_of, _column, _sql)


@query(f"SELECT doc_id, {S.short_number('v')} AS s FROM (SELECT doc_id, (doc_id % 97) / 40.0 AS v FROM documents)")
def short_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.short_number((F.col("doc_id") % 97) / 40.0).alias("s"))


# ---------------------------------------------------------------- dictionary
_D = _sql_cases(PLAIN)
_HITS = _sql_places(f"(SELECT * FROM {_D}, {_KO})", "word")
_LIVE = (
    f"(SELECT * FROM {_HITS} h WHERE NOT EXISTS (SELECT 1 FROM unnest(h.excludes) AS x(p), unnest(range(greatest(1, h.e - length(p) + 1), h.s + 2)) AS y(i)"
    " WHERE substr(h.t, i, length(p)) = p))"
)
_LONGEST = f"(SELECT a.* FROM {_LIVE} a WHERE NOT EXISTS (SELECT 1 FROM {_LIVE} b WHERE b.doc_id = a.doc_id AND b.kw_id <> a.kw_id AND b.s <= a.s AND b.e >= a.e))"


def _hits(spark: SparkSession, sf_dir: str, which) -> DataFrame:
    df = _dealt(spark, sf_dir, PLAIN).select("doc_id", F.explode(which(M.scan("t", DICT))).alias("h"))
    return df.select("doc_id", "h.word", F.col("h.start").alias("s"), F.col("h.end").alias("e"))


@query(f"SELECT doc_id, word, s, e FROM {_HITS}")
def korean_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, lambda h: h)


@query(f"SELECT doc_id, word, s, e FROM {_LIVE}")
def keyword_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, lambda h: F.filter(h, lambda x: ~x["excluded"]))


@query(f"SELECT doc_id, word, s, e FROM {_LONGEST}")
def korean_scan_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, M.longest)


@query(f"SELECT DISTINCT a.doc_id, a.word FROM {_LIVE} a WHERE NOT EXISTS (SELECT 1 FROM {_LIVE} b WHERE b.doc_id = a.doc_id AND length(b.word) > length(a.word) AND contains(b.word, a.word))")
def keyword_subsume(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.transform(F.filter(M.scan("t", DICT), lambda x: ~x["excluded"]), lambda x: x["word"]))
    return _dealt(spark, sf_dir, PLAIN).select("doc_id", F.explode(M.subsume(words)).alias("word"))


@query("SELECT kw_id, lang, word, weight, category, jamo FROM (VALUES " + ", ".join(f"({k.kw_id}, '{k.lang}', {sql_text(k.word)}, {k.weight}, {sql_text(k.category)}, {sql_text(k.jamo)})" for k in (*DICT.korean, *DICT.latin)) + ") AS k(kw_id, lang, word, weight, category, jamo)")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DICT.frame(spark).select("kw_id", "lang", "word", "weight", "category", "jamo")


_PAGE_TEXT = f"(SELECT page_id, lower(url || ' ' || {S.sub('html', '(?s)<[^>]*>', ' ')}) AS t FROM pages)"


@query("SELECT page_id, word FROM (" + " UNION ALL ".join(f"SELECT page_id, '{k.word}' AS word FROM {_PAGE_TEXT} WHERE {S.has('t', M.latin_boundary(k.word))}" for k in DICT.latin) + ")")
def latin_keyword_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("url", F.lit(" "), F.regexp_replace("html", "(?s)<[^>]*>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(M.latin_words(text, DICT)).alias("word"))


def _array(words: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, words)) + "]"


def _present(words: list[str], t: str = "t") -> str:
    return f"list_filter({_array(words)}, lambda w: contains({t}, w))"


@query(f"SELECT doc_id, array_to_string({_present(A.CUES)}, ',') AS cues, array_to_string({_present(A.REPORT_CONTEXT)}, ',') AS context, array_to_string({_present(A.STRONG_CONTEXT)}, ',') AS strong FROM {_sql_cases(PLAIN)}")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues, report context and strong context of whole texts."""
    show = lambda words: F.array_join(M.present("t", words), ",")
    return _whole(spark, sf_dir, PLAIN).select("doc_id", show(A.CUES).alias("cues"), show(A.REPORT_CONTEXT).alias("context"), show(A.STRONG_CONTEXT).alias("strong"))


_NO_LOOK = {
    "messenger": "(텔레그램|텔레\\s*@|telegram|카카오톡|카톡|kakao|위챗|wechat|라인\\s*(?:id|아이디))|(?:^|[^a-z0-9._])(@[a-z0-9_]{3,})",
    "domain": "(?:^|[^a-z0-9@._-])(?:https?://)?((?:[a-z0-9-]+\\.)+(?:com|net|org|kr|io|xyz|top|vip|bet|club|site|online|cc|me|info|biz|app|link|live|win|fun|shop|store|pro|tv))(?:$|[^a-z0-9-])",
    "phone": "(?:^|[^0-9])((?:01[016789]|050\\d?)[-.\\s]?\\d{3,4}[-.\\s]?\\d{4})(?:$|[^0-9])",
    "short_link": "(?:^|[^a-z0-9.-])((?:https?://)?(?:bit\\.ly|han\\.gl|me2\\.do|vo\\.la|url\\.kr|buly\\.kr|linktr\\.ee|lnk\\.bio|heylink\\.me|tinyurl\\.com|t\\.me|open\\.kakao\\.com)/[\\w-]+)",
}


@query(
    "SELECT doc_id, " + ", ".join(f"regexp_extract(t, {sql_text(p)}, 1)" + (f" || regexp_extract(t, {sql_text(p)}, 2)" if n == "messenger" else "") + f" AS {n}" for n, p in _NO_LOOK.items())
    + f" FROM {_sql_cases(PLAIN)}"
)
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First contact of each kind in whole texts, by the look-around patterns of the gate."""
    t = F.col("t")
    return _whole(spark, sf_dir, PLAIN).select(
        "doc_id",
        F.regexp_extract(t, f"({A.MESSENGER})", 1).alias("messenger"),
        F.regexp_extract(t, A.DOMAIN, 1).alias("domain"),
        F.regexp_extract(t, f"({A.PHONE})", 1).alias("phone"),
        F.regexp_extract(t, A.SHORT_LINK, 0).alias("short_link"),
    )


# The gate reads tokens of look-alike letters and what stands near a keyword, in stored text too, which SQL can't say: held against loops in the tests.
def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_distinct(_whole(spark, sf_dir, PLAIN), "t", "a", A.assess_udf())


@query()
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return _assessed(spark, sf_dir).select("doc_id", A.keyword_score(a).alias("keyword_score"), A.max_weight(a).alias("max_weight"), A.score(a).alias("score"))


@query()
def gate_adlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return _assessed(spark, sf_dir).select("doc_id", A.blocked(a).alias("blocked"), A.ad_like(a).alias("ad_like"))


@query()
def gate_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("doc_id", A.hidden_ad_like(F.col("a")).alias("hidden_ad_like"))


@query()
def gate_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is short or full of keywords."""
    return _assessed(spark, sf_dir).select("doc_id", A.compact(F.col("a"), F.length("t")).alias("compact"))


_SCATTER = ["ㅋ 오늘 ㅏ 날씨 ㅈ 가 ㅣ 참 ㄴ 좋 ㅗ 네", "ㅋㅋㅋ", "ㅌㅗㅌㅗ", "plain", "ㅅ ㅡ ㄹ ㄹ ㅗ ㅅ ㅁㅓㅅㅣㄴ"]
_SJ = f"(SELECT doc_id, {S.lone_jamo('t')} AS j FROM {_sql_cases(_SCATTER)})"


@query(f"SELECT doc_id, word FROM {_SJ}, {_KO} WHERE length(jamo) >= 4 AND contains(j, jamo) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(jamo) DESC, instr(j, jamo), kw_id) = 1")
def scattered_jamo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, _SCATTER).select("doc_id", M.scattered("t", DICT).alias("word")).where("word is not null")


# ---------------------------------------------------------------- kernels
@query(f"SELECT doc_id, {sql_pick([d[1] for d in DECODES], 'doc_id')} || ' ' || text AS decoded FROM documents")
def jamo_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_distinct(_whole(spark, sf_dir, [d[0] for d in DECODES]), "t", "decoded", decode_udf).select("doc_id", "decoded")


_SYLLABLE = "chr((44032 + (doc_id * 7919) % 11172)::INTEGER)"


@query(f"SELECT doc_id, {_SYLLABLE} || ' ' || text AS composed FROM documents")
def jamo_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A syllable taken apart by arithmetic in the engine before each whole text, put together by the automaton."""
    code = (F.col("doc_id") * 7919 % 11172).cast("int")
    at = lambda s, i: F.substring(F.lit(s), i, F.lit(1))
    onset = at(T.ONSETS, F.floor(code / 588).cast("int") + 1)
    nucleus = at(T.NUCLEI, F.floor(code % 588 / 28).cast("int") + 1)
    coda = F.when(code % 28 == 0, "").otherwise(at(T.CODAS, code % 28))
    jamo = F.concat(X.lone_jamo(F.concat(onset, nucleus, coda)), F.lit(" "), "text")
    return A.by_distinct(table(spark, sf_dir, "documents").select("doc_id", jamo.alias("j")), "j", "composed", compose_udf).select("doc_id", "composed")


@query()
def qwerty_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korean reading of each different word of the whole texts that has one."""
    df = _whole(spark, sf_dir, [k[0] for k in KEYED])
    words = df.select("doc_id", F.explode(F.array_distinct(F.split("t", r"[\x20\x09-\x0D]+"))).alias("word"))
    return A.by_distinct(words, "word", "korean", keyed_udf).where("korean is not null").select("doc_id", "word", "korean")


@query()
def fold_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_distinct(_whole(spark, sf_dir, _WIDE), "t", "folded", fold_udf).select("doc_id", "folded")


LATTICE = ["с.а.s.і.n.о", "ＢＥＴ365", "alphabet", "c4sino", "Привет", "bet365 c@sino", "no"]


@query()
def latin_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin keywords that tokens of whole texts can be read as."""
    return A.by_distinct(_whole(spark, sf_dir, LATTICE), "t", "words", latin_udf()).select("doc_id", "words")


ALIGN = ["ㅋㅏㅈㅣㄴㅗ", "카ㅈㅣ노", "ㅂrㅋr라", "ㅅㅡㄹㄹㅗㅅㅁㅓㅅㅣㄴ", "카 지.노", "ㄱㅏㅈㅣㄴㅗ", "카a지노", "가나다"]


@query()
def jamo_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by the jamo of whole texts, spelled out, in look-alikes or as syllables."""
    df = A.by_distinct(_whole(spark, sf_dir, ALIGN), "t", "found", align_udf())
    return df.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def _check(name: str, which: int) -> None:
    cases = [c[0] for c in VERDICTS]

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = A.by_distinct(_whole(spark, sf_dir, cases), "t", "v", verdict_udf(name))
        return done.select("doc_id", F.col("v.hit").cast("int").alias("hit"))

    f.__name__ = "detect_" + name.lower()
    query(f"SELECT doc_id, ([{', '.join(str(int(c[1][which])) for c in VERDICTS)}])[(doc_id % {len(VERDICTS)}) + 1] AS hit FROM documents")(f)


for _k, _name in enumerate(TEXT_CHECKS):
    _check(_name, _k)



# ---------------------------------------------------------------- positions
_FAR = ["카지노 " + "가나다라마바사아자차 " * n + tail for n, tail in ((1, "무료 쿠폰"), (2, "무료 쿠폰"), (4, "무료 쿠폰"), (9, "이벤트 토토"), (0, "vip"))]
_W = _sql_cases(_FAR)
_FAR_HITS = _sql_places(f"(SELECT * FROM {_W}, {_KO} WHERE word IN ('카지노', '토토'))", "word")


@query(
    f"SELECT DISTINCT h.doc_id, cue FROM {_FAR_HITS} h, unnest({_array(A.CUES)}) AS c(cue), unnest(range(greatest(1, h.s - 29 - length(cue)), h.e + 32)) AS r(i)"
    " WHERE substr(h.t, i, length(cue)) = cue AND i - 1 <= h.e + 30 AND i - 1 + length(cue) >= h.s - 30"
)
def proximity_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues within thirty characters of a keyword."""
    df = _dealt(spark, sf_dir, _FAR).select("doc_id", "t", M.longest(M.scan("t", DICT)).alias("hits"))
    by = lambda hits: F.filter(F.array(*map(F.lit, A.CUES)), lambda c: M.beside(F.col("t"), c, hits, A.NEAR))
    near = M.let(F.col("hits"), by)
    return df.select("doc_id", F.explode(near).alias("cue"))


_ZERO = ["카\u200b지\u200b노 가입", "토토 카지노", "바\u2060카\u00ad라 무료", "plain", "CA\u200bSINO bo\u200bnus", "be\u200bt po\u200bker poker"]
_EN = "(VALUES " + ", ".join(f"({sql_text(k.word)})" for k in DICT.latin if len(k.word) >= M.REVEALED) + ") AS k(word)"
_BARE = f"(SELECT doc_id, lower(t) AS t, lower({S.sub('t', S.char_class(T.ZERO_WIDTH))}) AS bare FROM {_sql_cases(_ZERO)})"


@query(f"SELECT doc_id, word FROM {_BARE}, (SELECT word FROM {_KO} UNION ALL SELECT word FROM {_EN}) WHERE contains(bare, word) AND NOT contains(t, word)")
def zero_width_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, Latin ones of four letters or more, that only the text without invisible marks holds."""
    return _dealt(spark, sf_dir, _ZERO).select("doc_id", F.explode(M.revealed(F.col("t"), DICT)).alias("word"))
