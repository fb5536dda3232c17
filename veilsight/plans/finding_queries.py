"""Queries over structure: trees, hidden roots, findings, reviews, evaluation, crawl events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl as C
from ..operators import evaluate as E
from ..operators import findings as N
from ..operators import hidden as H
from ..operators import measure as M
from ..operators import review as R
from ..operators.disguise import suppress_full
from . import sqlgen as S
from .registry import pick, query, sql_pick, sql_text, table

# ---------------------------------------------------------------- trees: blocks of 50 documents, node i under i div 2
_TREE = "(SELECT doc_id // 50 AS page_id, 0 AS frame_id, (doc_id % 50 + 1)::INTEGER AS e, CASE WHEN doc_id % 50 > 0 THEN ((doc_id % 50 + 1) // 2)::INTEGER END AS p, doc_id AS id, lang, n_chars FROM documents)"
_UP = (
    f"up(page_id, e, anc) AS (SELECT page_id, e, p FROM {_TREE} WHERE p IS NOT NULL UNION ALL"
    f" SELECT u.page_id, u.e, t.p FROM up u JOIN {_TREE} t ON t.page_id = u.page_id AND t.e = u.anc WHERE t.p IS NOT NULL)"
)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id") % 50
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 50).alias("page_id"), F.lit(0).alias("frame_id"), (at + 1).cast("int").alias("e"),
        F.when(at > 0, F.floor((at + 1) / 2).cast("int")).alias("p"), F.col("doc_id").alias("id"), "lang", "n_chars",
    )


@query(f"WITH RECURSIVE {_UP} SELECT page_id, e, anc FROM up")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure(_tree(spark, sf_dir)).select("page_id", "e", "anc")


_GROUPS = f"(SELECT page_id, e, id % 7 = 0 AS own, id % 5 = 0 AS rest FROM {_TREE})"


@query(
    f"WITH RECURSIVE {_UP} SELECT page_id, e, own FROM {_GROUPS} g WHERE own OR (rest AND NOT EXISTS"
    f" (SELECT 1 FROM up u JOIN {_GROUPS} d ON d.page_id = u.page_id AND d.e = u.e WHERE u.page_id = g.page_id AND u.anc = g.e AND (d.own OR d.rest)))"
)
def hidden_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    groups = tree.select("page_id", "frame_id", "e", (F.col("id") % 7 == 0).alias("own"), (F.col("id") % 5 == 0).alias("rest"))
    return H.suppress(groups, H.closure(tree)).select("page_id", "e", "own")


@query(
    f"WITH RECURSIVE {_UP} SELECT page_id, e FROM (SELECT page_id, e, n_chars > 1500 AS via_full FROM {_TREE} WHERE lang = 'en') f WHERE NOT via_full OR NOT EXISTS"
    f" (SELECT 1 FROM up u JOIN {_TREE} d ON d.page_id = u.page_id AND d.e = u.e WHERE d.lang = 'en' AND u.page_id = f.page_id AND u.anc = f.e)"
)
def text_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    found = tree.where("lang = 'en'").select("page_id", "frame_id", "e", (F.col("n_chars") > 1500).alias("via_full"))
    return suppress_full(found, H.closure(tree)).select("page_id", "e")


_SIGNALS = f"(SELECT page_id, e AS ord, n, ((e * (n + 3)) % 60 + 1)::INTEGER AS root FROM {_TREE}, (VALUES (0), (1), (2)) AS v(n))"


@query(f"SELECT s.page_id, s.ord, s.root FROM {_SIGNALS} s JOIN (SELECT page_id, e, (id % 6)::INTEGER AS d FROM {_TREE}) r ON r.page_id = s.page_id AND r.e = s.root QUALIFY row_number() OVER (PARTITION BY s.page_id, s.ord ORDER BY d DESC, n) = 1")
def nearest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    signals = tree.select("page_id", "frame_id", F.col("e").alias("ord"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("n"))
    signals = signals.withColumn("root", ((F.col("ord") * (F.col("n") + 3)) % 60 + 1).cast("int"))
    roots = tree.select("page_id", "frame_id", "e", (F.col("id") % 6).cast("int").alias("d"))
    return H.nearest(signals, roots).select("page_id", "ord", "root")


@query(
    f"WITH RECURSIVE n AS (SELECT page_id, e, p, 1 - (id % 4) / 10.0::DOUBLE AS op, id % 11 = 0 AS none FROM {_TREE}),"
    " down(page_id, e, cum, none_root) AS (SELECT page_id, e, op, CASE WHEN none THEN e END FROM n WHERE p IS NULL UNION ALL"
    " SELECT n.page_id, n.e, d.cum * n.op, CASE WHEN n.none THEN n.e ELSE d.none_root END FROM down d JOIN n ON n.page_id = d.page_id AND n.p = d.e)"
    " SELECT page_id, e, round(cum, 6) AS cum, none_root FROM down"
)
def cumulative_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opacity along the tree, and the innermost element that isn't displayed."""
    nodes = _tree(spark, sf_dir).select("page_id", "e", "p", (F.lit(1.0) - (F.col("id") % 4) / 10.0).alias("op"), (F.col("id") % 11 == 0).alias("none"))
    return M.accumulated(nodes).select("page_id", "e", F.round("cum", 6).alias("cum"), "none_root")


_COLOURS = ["rgb(255, 255, 255)", "rgba(0, 0, 0, 0.5)", "transparent", "rgb(250 250 250)", "rgba(10, 20, 30, 40%)", "red", "rgb(245, 245, 245)"]
_CH = lambda v: f"(CASE WHEN ({v}) / 255.0 <= 0.03928 THEN ({v}) / 255.0 / 12.92 ELSE pow((({v}) / 255.0 + 0.055) / 1.055, 2.4) END)"
_LUM = lambda r, g, b: f"(0.2126 * {_CH(r)} + 0.7152 * {_CH(g)} + 0.0722 * {_CH(b)})"
_PART = lambda k: f"regexp_extract(c, {sql_text(M.RGB)}, {k})"


@query(
    f"SELECT doc_id, round((greatest(l, 1.0) + 0.05) / (least(l, 1.0) + 0.05), 4) AS contrast, round(a, 4) AS alpha FROM (SELECT doc_id, a, {_LUM('r * a + 255 * (1 - a)', 'g * a + 255 * (1 - a)', 'b * a + 255 * (1 - a)')} AS l FROM"
    f" (SELECT doc_id, CASE WHEN c = 'transparent' THEN 0 ELSE try_cast({_PART(1)} AS DOUBLE) END AS r, CASE WHEN c = 'transparent' THEN 0 ELSE try_cast({_PART(2)} AS DOUBLE) END AS g,"
    f" CASE WHEN c = 'transparent' THEN 0 ELSE try_cast({_PART(3)} AS DOUBLE) END AS b, CASE WHEN c = 'transparent' THEN 0 WHEN {_PART(1)} = '' THEN NULL WHEN {_PART(4)} = '' THEN 1.0"
    f" WHEN {_PART(5)} = '%' THEN {_PART(4)}::DOUBLE / 100 ELSE {_PART(4)}::DOUBLE END AS a FROM (SELECT doc_id, {sql_pick(_COLOURS, 'doc_id')} AS c FROM documents)))"
)
def contrast_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a colour on white."""
    white = F.array(*[F.lit(255.0)] * 3)
    df = table(spark, sf_dir, "documents").select("doc_id", M.colour(pick(_COLOURS, F.col("doc_id"))).alias("c"))
    return df.select("doc_id", F.round(M.contrast(M.blend(F.col("c"), white), white), 4).alias("contrast"), F.round(F.col("c")[3], 4).alias("alpha"))


@query(f"SELECT page_id, e, row_number() OVER (PARTITION BY page_id, p, id % 2 ORDER BY e)::INTEGER AS nth, count(*) OVER (PARTITION BY page_id, p, id % 2)::INTEGER AS same FROM {_TREE}")
def nth_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place among the siblings with the same tag, and their number."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id", "p", F.col("id") % 2)
    return _tree(spark, sf_dir).select("page_id", "e", F.row_number().over(w.orderBy("e")).alias("nth"), F.count("*").over(w).cast("int").alias("same"))


# ---------------------------------------------------------------- findings made from pages
_TECH = ["HOMOGLYPH", "JAMO", "TRANSPARENT", "OFFSCREEN", "ETC"]
_F = (
    "(SELECT page_id AS arrival, CASE WHEN page_id % 13 = 0 THEN upper(split_part(url, '://', 1)) || '://' || split_part(url, '://', 2) ELSE url END AS url,"
    f" CASE WHEN page_id % 17 = 0 THEN ' ' ELSE 'div > p:nth-of-type(' || (page_id % 3) || ')' END AS location, {sql_pick(_TECH, 'page_id')} AS technique,"
    " CASE WHEN page_id % 5 = 4 THEN 'CLIPPED' END AS extra_type, 'text ' || (page_id % 4) AS evidence_text FROM pages"
    " UNION ALL SELECT page_id + 100000, url || '#again', 'div > p:nth-of-type(' || (page_id % 3) || ')', "
    f"{sql_pick(_TECH, 'page_id')}, CASE WHEN page_id % 5 = 4 THEN 'CLIPPED' END, 'later' FROM pages WHERE contains(url, '/en/'))"
)
_KIND = "technique || coalesce(':' || extra_type, '')"
_KEY = f"({S.key('url')} || chr(10) || location || chr(10) || {_KIND})"
_FOUND = f"(SELECT *, {_KEY} AS key FROM {_F} WHERE length(trim(location)) > 0 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY arrival) = 1)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    place = F.concat(F.lit("div > p:nth-of-type("), (i % 3).cast("string"), F.lit(")"))
    extra = F.when(i % 5 == 4, "CLIPPED")
    shouted = F.concat(F.upper(F.substring_index("url", "://", 1)), F.lit("://"), F.regexp_replace("url", "^.*?://", ""))
    first = p.select(
        i.alias("arrival"), F.when(i % 13 == 0, shouted).otherwise(F.col("url")).alias("url"), F.when(i % 17 == 0, " ").otherwise(place).alias("location"),
        pick(_TECH, i).alias("technique"), extra.alias("extra_type"), F.concat(F.lit("text "), (i % 4).cast("string")).alias("evidence_text"),
    )
    again = p.where("contains(url, '/en/')").select(
        (i + 100000).alias("arrival"), F.concat("url", F.lit("#again")).alias("url"), place.alias("location"), pick(_TECH, i).alias("technique"), extra.alias("extra_type"), F.lit("later").alias("evidence_text")
    )
    return first.unionByName(again)


@query(f"SELECT arrival, url, location, technique, key FROM {_FOUND}")
def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.collect(_candidates(spark, sf_dir)).select("arrival", "url", "location", "technique", "key")


@query(f"SELECT arrival, printf('f_%03d', row_number() OVER (PARTITION BY technique <> 'ETC' ORDER BY {S.key('url')}, location, technique, coalesce(extra_type, ''))) AS id FROM {_FOUND}")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.numbered(N.collect(_candidates(spark, sf_dir))).select("arrival", "id")


@query(f"SELECT f.arrival, CASE WHEN n >= 2 THEN n ELSE 0 END::INTEGER AS shared_pages FROM {_FOUND} f JOIN (SELECT technique, extra_type, location, evidence_text, count(DISTINCT url) AS n FROM {_FOUND} GROUP BY ALL) g ON f.technique = g.technique AND f.extra_type IS NOT DISTINCT FROM g.extra_type AND f.location = g.location AND f.evidence_text = g.evidence_text")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.shared_pages(N.collect(_candidates(spark, sf_dir))).select("arrival", "shared_pages")


@query(f"SELECT arrival, CASE technique WHEN 'HOMOGLYPH' THEN {sql_text(N.ADVICE['HOMOGLYPH'])} WHEN 'JAMO' THEN {sql_text(N.ADVICE['JAMO'])} ELSE {sql_text(N.ADVICE[''])} END || CASE WHEN arrival % 2 = 0 THEN {sql_text(N.SHARED_ADVICE)} ELSE '' END AS action FROM {_FOUND}")
def finding_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = N.collect(_candidates(spark, sf_dir)).withColumn("shared_pages", F.when(F.col("arrival") % 2 == 0, 3).otherwise(0))
    return df.select("arrival", N.action().alias("action"))


@query(f"SELECT arrival, substr(sha1(key), 1, 16) AS review_key FROM {_FOUND}")
def review_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.collect(_candidates(spark, sf_dir)).select("arrival", N.report_key().alias("review_key"))


@query(f"SELECT technique, count(*) AS n FROM {_FOUND} GROUP BY technique")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.summary(N.collect(_candidates(spark, sf_dir)))


_SCAN = "2026-03-01T10:00:00+09:00"
_ST = list(R.STATUSES)
_ENTRIES = (
    f"(SELECT 'k' || page_id AS key, {sql_pick(_ST, 'page_id')} AS status, 'm' AS memo, CASE WHEN page_id % 3 > 0 THEN '2026-0' || (page_id % 5 + 1) || '-01T00:00:00+09:00' END AS updated_at,"
    f" CASE WHEN page_id % 4 = 1 THEN '{_SCAN}' END AS last_seen_at, page_id % 9 = 0 AS reappeared FROM pages)"
)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("k"), i.cast("string")).alias("key"), pick(_ST, i).alias("status"), F.lit("m").alias("memo"),
        F.when(i % 3 > 0, F.concat(F.lit("2026-0"), (i % 5 + 1).cast("string"), F.lit("-01T00:00:00+09:00"))).alias("updated_at"),
        F.when(i % 4 == 1, _SCAN).alias("last_seen_at"), (i % 9 == 0).alias("reappeared"),
    )


@query(
    f"SELECT e.key, status, memo, updated_at, CASE WHEN s.key IS NOT NULL THEN '{_SCAN}' ELSE last_seen_at END AS last_seen_at, reappeared OR (s.key IS NOT NULL AND status = 'resolved'"
    f" AND last_seen_at IS DISTINCT FROM '{_SCAN}' AND (updated_at IS NULL OR updated_at <= '{_SCAN}')) AS reappeared FROM {_ENTRIES} e LEFT JOIN (SELECT 'k' || page_id AS key FROM pages WHERE contains(url, '/en/')) s ON s.key = e.key"
)
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "pages").where("contains(url, '/en/')").select(F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("key"))
    return R.merge_scan(_entries(spark, sf_dir), seen, _SCAN)


@query(
    f"SELECT coalesce(e.key, c.key) AS key, CASE WHEN c.key IS NULL THEN status ELSE 'confirmed' END AS status, CASE WHEN c.key IS NULL THEN memo ELSE '' END AS memo, CASE WHEN c.key IS NULL THEN updated_at ELSE 'now' END AS updated_at,"
    f" last_seen_at, CASE WHEN c.key IS NULL THEN reappeared ELSE false END AS reappeared FROM {_ENTRIES} e FULL JOIN (SELECT 'k' || (page_id * 2) AS key FROM pages WHERE contains(url, '?')) c ON c.key = e.key"
)
def review_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("k"), (F.col("page_id") * 2).cast("string")).alias("key")
    changes = table(spark, sf_dir, "pages").where("contains(url, '?')").select(key, F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("memo"), F.lit("now").alias("updated_at"))
    return R.set_status(_entries(spark, sf_dir), changes)


# ---------------------------------------------------------------- evaluation against the labels table
_TRUTH = f"(SELECT doc_id % 40 AS page, doc_id AS element, {sql_pick(_TECH, 'quality + toxic * 2 + doc_id')} AS label FROM labels)"
_SAID = (
    f"(SELECT doc_id % 40 AS page, CASE WHEN doc_id % 7 > 0 THEN doc_id - doc_id % 3 END AS element, {sql_pick(_TECH, 'doc_id - doc_id % 3')} AS label, doc_id AS arrival,"
    " CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS matches, doc_id % 10 = 0 AS known FROM documents)"
)
_ONE = f"(SELECT *, row_number() OVER (PARTITION BY page, element, label ORDER BY arrival) AS n FROM {_SAID} WHERE matches = 1 AND element IS NOT NULL)"
_JUDGED = (
    f"(SELECT coalesce(o.page, t.page) AS page, coalesce(o.label, t.label) AS label, CASE WHEN n IS NULL THEN 'fn' WHEN t.label IS NOT NULL AND n = 1 THEN 'tp' WHEN t.label IS NULL AND known THEN 'known_fp' ELSE 'fp' END AS outcome"
    f" FROM {_ONE} o FULL JOIN {_TRUTH} t ON o.page = t.page AND o.element = t.element AND o.label = t.label UNION ALL SELECT page, label, 'fp' FROM {_SAID} WHERE NOT (matches = 1 AND element IS NOT NULL))"
)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    number = F.col("quality") + F.col("toxic") * 2 + i
    truth = table(spark, sf_dir, "labels").select((i % 40).alias("page"), i.alias("element"), pick(_TECH, number).alias("label"))
    said = table(spark, sf_dir, "documents").select(
        (i % 40).alias("page"), F.when(i % 7 > 0, i - i % 3).alias("element"), pick(_TECH, i - i % 3).alias("label"), i.alias("arrival"),
        F.when(i % 11 == 0, 2).otherwise(1).alias("matches"), (i % 10 == 0).alias("known"),
    )
    return E.judge(said, truth)


@query(f"SELECT page, label, outcome, count(*) AS n FROM {_JUDGED} GROUP BY ALL")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("page", "label", "outcome").agg(F.count("*").alias("n"))


_COUNTED = f"(SELECT label, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome IN ('fp', 'known_fp')) AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM (SELECT label, outcome FROM {_JUDGED} UNION ALL SELECT 'TOTAL', outcome FROM {_JUDGED} WHERE label NOT LIKE 'ETC%') GROUP BY label)"


@query(f"SELECT label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall FROM {_COUNTED}")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(_judged(spark, sf_dir)).select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT " + ", ".join(f"coalesce(max({k}) FILTER (label = '{x}'), 0) AS {x.lower()}_{k}" for x in (*_TECH, "TOTAL") for k in ("tp", "fp", "fn")) + f" FROM {_COUNTED}")
def eval_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.history_row(E.metrics(_judged(spark, sf_dir)), [*_TECH, "TOTAL"])


_SAY = ["TP", "o", "정탐", "FP", "X", "오탐", "FN", "미탐", "?", ""]


@query(f"SELECT technique, count(*) FILTER (v IN ('TP', 'O', '정탐')) AS tp, count(*) FILTER (v IN ('FP', 'X', '오탐')) AS fp, count(*) FILTER (v IN ('FN', '미탐')) AS fn, count(*) FILTER (v NOT IN ('TP', 'O', '정탐', 'FP', 'X', '오탐', 'FN', '미탐')) AS unjudged FROM (SELECT {sql_pick(_TECH, 'doc_id // 10')} AS technique, upper({sql_pick(_SAY, 'doc_id')}) AS v FROM documents) GROUP BY technique")
def eval_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return E.by_hand(table(spark, sf_dir, "documents").select(pick(_TECH, F.floor(i / 10)).alias("technique"), pick(_SAY, i).alias("verdict")))


@query("SELECT DISTINCT path FROM (SELECT url || CASE page_id % 4 WHEN 0 THEN '/files/a.pdf' WHEN 1 THEN '?do=logout' ELSE '' END AS path FROM pages) WHERE contains(path, '/files/') OR contains(path, 'logout') OR contains(path, 'delete')")
def forbidden_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    path = F.concat("url", F.when(i % 4 == 0, "/files/a.pdf").when(i % 4 == 1, "?do=logout").otherwise(""))
    return E.forbidden_requests(table(spark, sf_dir, "pages").select(path.alias("path")))


# ---------------------------------------------------------------- crawl events from the events table
_MESSAGES = ["HTTP 404", "HTTP 503", "net::ERR_CONNECTION_RESET at x", "Download is starting", "Timeout", "HTTP 410", "net::ERR_NAME_NOT_RESOLVED", "net::ERR_TIMED_OUTX"]
_M = f"(SELECT event_id, {sql_pick(_MESSAGES, 'event_id')} AS m, event_id % 9 = 0 AS late FROM events)"
_TRANSIENT_RE2 = C.TRANSIENT


@query(f"SELECT event_id, CASE WHEN m IN ('HTTP 404', 'HTTP 410') THEN 'OTHER' WHEN m LIKE 'HTTP %' THEN 'REFUSED' WHEN contains(m, 'Download is starting') THEN 'FILE' WHEN late OR {S.has('m', _TRANSIENT_RE2)} THEN 'TRANSIENT' ELSE 'OTHER' END AS kind FROM {_M}")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id", pick(_MESSAGES, i).alias("m"), (i % 9 == 0).alias("late"))
    return df.select("event_id", C.failure(F.col("m"), F.col("late")).alias("kind"))


@query('SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM (SELECT user_id, event_id, failed, row_number() OVER w - sum(failed::INTEGER) OVER w AS island FROM (SELECT user_id, event_id, hash_ok AS failed FROM (SELECT user_id, event_id, (event_id * 7 + user_id) % 3 > 0 AS hash_ok FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE failed GROUP BY user_id, island')
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 7 + F.col("user_id")) % 3 > 0).alias("failed"))
    return C.streaks(df, "user_id", "event_id", "failed")


_OUT = ["ok", "ok", "failed", "uninspected", "truncated", "deferred", "file"]


@query(f"SELECT count(*) FILTER (o IN ('ok', 'truncated', 'uninspected')) AS visited, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'uninspected') AS uninspected, count(*) FILTER (o = 'truncated') AS truncated, count(*) FILTER (o = 'deferred') AS deferred, count(*) FILTER (o = 'file') AS files FROM (SELECT {sql_pick(_OUT, 'event_id')} AS o FROM events)")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counters(table(spark, sf_dir, "events").select(pick(_OUT, F.col("event_id")).alias("outcome")))


@query()
def crawl_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(["OK", "REFUSED", "OK", "OTHER", "FILE", "OK", "OK", "TRANSIENT"], F.col("event_id"))
    return C.pacing(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


@query("SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 302 END AS status, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS ct FROM pages) WHERE status < 400 AND (ct IS NULL OR regexp_matches(ct, 'html|xml'))")
def response_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    df = table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 == 0, 200).when(i % 4 == 1, 404).otherwise(302).alias("status"), F.when(i % 3 == 0, "text/html").when(i % 3 == 1, "image/png").alias("content_type"))
    return df.where(C.readable()).select("page_id")


# ---------------------------------------------------------------- signals of measured style
_S = (
    "(SELECT doc_id, (doc_id % 23) / 100.0::DOUBLE AS op, (doc_id % 7) / 20.0::DOUBLE AS ca, 1 + (doc_id % 5) / 20.0::DOUBLE AS sc, (doc_id % 9) / 4.0::DOUBLE AS fs, doc_id % 6 = 0 AS none, doc_id % 8 = 0 AS off FROM documents)"
)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    value = lambda v: F.struct(v.cast("double").alias("v"), F.lit(1).alias("r"), F.lit(None).cast("string").alias("how"))
    off = F.struct(F.lit(4).alias("r"), F.lit("left").alias("how"), F.lit(False).alias("indent"), (-i).cast("double").alias("x"), F.lit(2.5).alias("y"))
    same = F.struct((F.lit(1) + (i % 5) / 20.0).alias("v"), F.lit(3).alias("r"), F.lit("a").alias("fg"), F.lit("b").alias("bg"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", value((i % 23) / 100.0).alias("op"), value((i % 7) / 20.0).alias("ca"), same.alias("sc"), value((i % 9) / 4.0).alias("fs"),
        F.when(i % 6 == 0, 2).alias("dn"), F.when(i % 8 == 0, off).alias("off"),
    )


@query(
    f"SELECT doc_id, 0 AS n, 'opacity:' || {S.short_number('op')} AS method FROM {_S} WHERE op <= 0.1 UNION ALL"
    f" SELECT doc_id, (op <= 0.1)::INTEGER, 'color:transparent' FROM {_S} WHERE ca <= 0.1 UNION ALL"
    f" SELECT doc_id, (op <= 0.1)::INTEGER + (ca <= 0.1)::INTEGER, 'color:a / background:b' FROM {_S} WHERE sc <= 1.1"
)
def signals_transparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _measured(spark, sf_dir).select("doc_id", F.posexplode(H.transparent()).alias("n", "s"))
    return df.select("doc_id", "n", "s.method")


@query(
    f"SELECT doc_id, 0 AS n, 'display:none' AS method FROM {_S} WHERE none UNION ALL"
    f" SELECT doc_id, none::INTEGER, 'font-size:' || {S.short_number('fs')} || 'px' FROM {_S} WHERE fs <= 1 UNION ALL"
    f" SELECT doc_id, none::INTEGER + (fs <= 1)::INTEGER, '화면 왼쪽 밖 (x=' || (-doc_id) || 'px, y=3px)' FROM {_S} WHERE off"
)
def signals_offscreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _measured(spark, sf_dir).select("doc_id", F.posexplode(H.offscreen()).alias("n", "s"))
    return df.select("doc_id", "n", "s.method")
