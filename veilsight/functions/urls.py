"""URL functions as column expressions: cleaning, comparison keys, scope and crawl priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:($|[^0-9])"
SESSION_ID = r"(?i);jsessionid=[^?#/]*"
INDEX_DOCUMENT = r"(?i)/(?:index|default)[.](?:html?|php|jsp|do|aspx?)$"
PAGE_PARAMETERS = "page|pageindex|pageno|page_no|pagenum|pg|cpage|curpage|currentpage|nowpage|offset|start"
BOARD = (
    "bbs|board|notice|article|post|view|list|comment|reply|qna|faq|free|gallery|forum|community|talk|review|guest|news|press"
    "|nttid|bbsid|articleno|boardid|게시|공지"
)
DOWNLOAD = "down(?:load)?|filedown|attach|getfile|fileid|atchfile|export"
LOW_VALUE = "login|logon|signin|signup|join|member|sitemap|print|popup|privacy|policy|terms|rss"
LANGUAGE = r"/(?:eng?|english|chn?|chinese|jpn?|japanese|cn|jp)(?:/|$)|[?&]lang="
DESTRUCTIVE = r"(?:^|[/_.\-=?&])(?:logout|log_out|signout|sign_out|delete|del|remove|destroy|unsubscribe|withdraw)(?:[/_.\-=&]|$)"
FILE = (
    r"\.(?:pdf|hwpx?|docx?|xlsx?|pptx?|zip|rar|7z|gz|tar|tgz|alz|egg|jpe?g|png|gif|bmp|svg|webp|ico|tiff?|mp3|mp4|avi|mov|wmv|mkv|flv|wav|ogg|webm"
    "|exe|msi|apk|dmg|iso|bin|csv|txt|xml|json|rss|atom|css|js|map|woff2?|ttf|eot|ics|vcf)$"
)
BLOCKED_RESOURCES = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico|bmp|mp4|webm|mp3|avi|mov|woff2?|ttf|otf|eot)(?:[?#]|$)"
DEPTH_STEP, BOARD_BONUS, PAGE_BASE, PAGE_MOST, DEEP_PATH, DOWNLOAD_COST, LOW_VALUE_COST, LANGUAGE_COST = 10, 25, 15, 30, 10, 100, 60, 50
MOST_INT = 2147483647

PAGE = rf"(?:^|[?&])({PAGE_PARAMETERS})=(\d+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(url: Column | str) -> Column:
    return F.regexp_replace(_c(url), r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def clean(url: Column | str) -> Column:
    """Without the fragment and session marks."""
    return F.regexp_replace(F.regexp_replace(strip(url), "(?s)#.*$", ""), SESSION_ID, "")


def key(url: Column | str) -> Column:
    """Comparison key: no scheme, default port, closing slashes or order of parameters."""
    s = F.regexp_replace(clean(url), SCHEME, "")
    base = F.substring_index(s, "?", 1)
    host = F.regexp_replace(F.lower(F.substring_index(base, "/", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(base, "^[^/]*", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(s, r"(?s)\?.*$", 0), r"^\?", "")
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    joined = F.array_join(parts, "&")
    return F.concat(host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def host(url: Column | str) -> Column:
    """Lower-case host without user and port; empty without a scheme."""
    s = strip(url)
    authority = F.regexp_extract(F.regexp_replace(s, SCHEME, ""), "^[^/?#]*", 0)
    authority = F.regexp_replace(authority, "^.*@", "")
    authority = F.when(authority.endswith("]"), authority).otherwise(F.regexp_replace(authority, ":[^:]*$", ""))
    return F.when(s.rlike(SCHEME), F.lower(authority)).otherwise("")


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_http(url: Column | str) -> Column:
    return strip(url).rlike("(?i)^https?://")


def entry(text: Column | str) -> Column:
    """An address as typed, with ``http://`` if it has no scheme; null if it is no web address."""
    s = strip(text)
    full = F.when(s.rlike(SCHEME), s).when(s.rlike(OTHER_SCHEME), None).otherwise(F.concat(F.lit("http://"), s))
    blank = (s == "") | s.rlike(r"[\s\x1C-\x1F]")
    return F.when(~blank & is_http(full) & (host(full) != ""), full)


def visit_key(url: Column | str) -> Column:
    """The key, a folder and its index document being one page."""
    k = key(url)
    return F.when(F.instr(k, "?") == 0, F.regexp_replace(k, INDEX_DOCUMENT, "")).otherwise(k)


def path_query(url: Column | str) -> Column:
    rest = F.regexp_replace(clean(url), "(?s)^.*?://", "")
    tail = F.regexp_extract(rest, "(?s)/.*$", 0)
    return F.lower(F.when(tail == "", "/").otherwise(tail))


def page_number(url: Column | str) -> Column:
    digits = F.regexp_extract(path_query(url), PAGE, 2)
    return F.when(digits == "", 0).otherwise(F.coalesce(F.expr("null").cast("int"), digits.try_cast("int"), F.lit(MOST_INT)))


def list_family(url: Column | str) -> Column:
    """Key of the lists that differ in their page only; null without a page parameter."""
    k = F.lower(key(url))
    return F.when(k.rlike(PAGE), F.regexp_replace(k, rf"(?s)^(.*?(?:(?<![^?&])|^)(?:{PAGE_PARAMETERS})=)\d+", "$1"))


def destructive(url: Column | str) -> Column:
    return path_query(url).rlike(DESTRUCTIVE)


def is_file(url: Column | str) -> Column:
    return F.substring_index(path_query(url), "?", 1).rlike(FILE)


def score(url: Column | str, depth: Column | str) -> Column:
    """Crawl priority: the lower, the sooner."""
    s, page = path_query(url), page_number(url)
    path = F.substring_index(s, "?", 1)
    cost = lambda when, n: F.when(when, n).otherwise(0)
    return (
        _c(depth) * DEPTH_STEP
        - cost(s.rlike(BOARD), BOARD_BONUS)
        + F.when(page > 1, F.lit(PAGE_BASE) + F.least(page, F.lit(PAGE_MOST))).otherwise(0)
        + cost(F.length(path) - F.length(F.replace(path, F.lit("/"))) > 5, DEEP_PATH)
        + cost(s.rlike(DOWNLOAD), DOWNLOAD_COST)
        + cost(s.rlike(LOW_VALUE), LOW_VALUE_COST)
        + cost(s.rlike(LANGUAGE), LANGUAGE_COST)
    ).cast("int")


def without_dots(path: Column) -> Column:
    """A path from ``/`` on, with ``.`` and ``..`` carried out."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    )
    closing = F.when(path.rlike(r"/\.\.?$") & (F.size(walked) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"), closing)).otherwise(path)


def resolve(base: Column | str, link: Column | str) -> Column:
    """Absolute form of a link on a page: absolute, scheme-relative, from the root, query or relative to the page's folder; null for no link."""
    b, u = strip(base), strip(link)
    origin = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    no_query = F.regexp_replace(b, "(?s)[?#].*$", "")
    path = F.regexp_extract(u, r"(?s)^[^?#]*", 0)
    rest = F.substring(u, F.length(path) + 1, F.length(u))
    folder = F.regexp_extract(F.substring(no_query, F.length(origin) + 1, F.length(no_query)), r"(?s)^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when((u == "") | u.startswith("#") | u.rlike("(?i)^(javascript|mailto|tel|sms|data|blob|about):"), None)
        .when(u.rlike(SCHEME), u)
        .when(u.startswith("//"), F.concat(F.regexp_extract(b, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), u))
        .when(u.startswith("?"), F.concat(no_query, u))
        .when(u.rlike(OTHER_SCHEME) | (origin == ""), None)
        .when(u.startswith("/"), F.concat(origin, without_dots(path), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def blocked_resource(url: Column | str) -> Column:
    return _c(url).rlike(BLOCKED_RESOURCES)
