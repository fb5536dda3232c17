"""The same semantics as SQL for DuckDB, whose regular expressions have no look-around."""

from __future__ import annotations

from ..functions import tables as T
from ..functions import urls as U
from .registry import sql_text as q

STRIP = r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def sub(x: str, pattern: str, to: str = "", every: bool = True) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}{', ' + q('g') if every else ''})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def strip(x: str) -> str:
    return sub(x, STRIP)


def clean(x: str) -> str:
    return sub(sub(strip(x), "(?s)#.*$"), U.SESSION_ID)


def base_of(x: str) -> str:
    return f"split_part({x}, '?', 1)"


def key(x: str) -> str:
    s = sub(clean(x), U.SCHEME)
    host = sub(f"lower(split_part({base_of(s)}, '/', 1))", ":(80|443)$")
    path = sub(sub(base_of(s), "^[^/]*", every=False), "/+$")
    query = sub(f"regexp_extract({s}, '(?s)\\?.*$')", r"^\?", every=False)
    joined = f"array_to_string(list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '')), '&')"
    return f"({host} || {path} || CASE WHEN coalesce({joined}, '') = '' THEN '' ELSE '?' || {joined} END)"


def host(x: str) -> str:
    s = strip(x)
    authority = sub(f"regexp_extract({sub(s, U.SCHEME)}, '^[^/?#]*')", "^.*@")
    return f"CASE WHEN {has(s, U.SCHEME)} THEN lower(CASE WHEN {authority} LIKE '%]' THEN {authority} ELSE {sub(authority, ':[^:]*$')} END) ELSE '' END"


def bare_host(x: str) -> str:
    return sub(f"({host(x)})", r"^www\.")


def is_http(x: str) -> str:
    return has(strip(x), "(?i)^https?://")


def entry(x: str) -> str:
    s = strip(x)
    full = f"(CASE WHEN {has(s, U.SCHEME)} THEN {s} WHEN {has(s, U.OTHER_SCHEME)} THEN NULL ELSE 'http://' || {s} END)"
    return f"CASE WHEN NOT ({s} = '' OR {has(s, '[\\s\\x1C-\\x1F]')}) AND {is_http(full)} AND ({host(full)}) <> '' THEN {full} END"


def visit_key(x: str) -> str:
    return f"CASE WHEN instr({key(x)}, '?') = 0 THEN {sub(key(x), U.INDEX_DOCUMENT)} ELSE {key(x)} END"


def path_query(x: str) -> str:
    tail = f"regexp_extract({sub(clean(x), '(?s)^.*?://', every=False)}, '(?s)/.*$')"
    return f"lower(CASE WHEN {tail} = '' THEN '/' ELSE {tail} END)"


def page_number(x: str) -> str:
    digits = f"regexp_extract({path_query(x)}, {q(U.PAGE)}, 2)"
    return f"(CASE WHEN {digits} = '' THEN 0 ELSE coalesce(try_cast({digits} AS INTEGER), {U.MOST_INT}) END)"


def list_family(x: str) -> str:
    k = f"lower({key(x)})"
    return f"CASE WHEN {has(k, U.PAGE)} THEN {sub(k, f'((?:^|[?&])(?:{U.PAGE_PARAMETERS})=)\\d+', chr(92) + '1', every=False)} END"


def destructive(x: str) -> str:
    return has(path_query(x), U.DESTRUCTIVE)


def is_file(x: str) -> str:
    return has(base_of(path_query(x)), U.FILE)


def score(x: str, depth: str) -> str:
    s, page = path_query(x), page_number(x)
    cost = lambda pattern, n: f"CASE WHEN {has(s, pattern)} THEN {n} ELSE 0 END"
    return (
        f"({depth} * {U.DEPTH_STEP} - {cost(U.BOARD, U.BOARD_BONUS)} + CASE WHEN {page} > 1 THEN {U.PAGE_BASE} + least({page}, {U.PAGE_MOST}) ELSE 0 END"
        f" + CASE WHEN length({base_of(s)}) - length(replace({base_of(s)}, '/', '')) > 5 THEN {U.DEEP_PATH} ELSE 0 END"
        f" + {cost(U.DOWNLOAD, U.DOWNLOAD_COST)} + {cost(U.LOW_VALUE, U.LOW_VALUE_COST)} + {cost(U.LANGUAGE, U.LANGUAGE_COST)})::INTEGER"
    )


def without_dots(path: str) -> str:
    """Dots carried out one pair at a time by a fold over the parts."""
    parts = f"string_split(substr({path}, 2), '/')"
    fold = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda x: [x])), lambda done, x: CASE x[1] WHEN '..' THEN done[1:greatest(len(done) - 1, 0)] WHEN '.' THEN done ELSE list_concat(done, x) END)"
    closing = f"CASE WHEN {has(path, '/[.][.]?$')} AND len({fold}) > 0 THEN '/' ELSE '' END"
    return f"(CASE WHEN {has(path, '/[.][.]?(/|$)')} THEN '/' || array_to_string({fold}, '/') || {closing} ELSE {path} END)"


def resolve(base: str, link: str) -> str:
    b, u = strip(base), strip(link)
    origin, no_query = f"regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')", sub(b, "(?s)[?#].*$")
    path = f"regexp_extract({u}, '(?s)^[^?#]*')"
    rest = f"substr({u}, length({path}) + 1)"
    folder = f"coalesce(nullif(regexp_extract(substr({no_query}, length({origin}) + 1), '(?s)^.*/'), ''), '/')"
    return (
        f"CASE WHEN {u} = '' OR {u} LIKE '#%' OR {has(u, '(?i)^(javascript|mailto|tel|sms|data|blob|about):')} THEN NULL"
        f" WHEN {has(u, U.SCHEME)} THEN {u} WHEN {u} LIKE '//%' THEN regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*:') || {u}"
        f" WHEN {u} LIKE '?%' THEN {no_query} || {u} WHEN {has(u, U.OTHER_SCHEME)} OR {origin} = '' THEN NULL"
        f" WHEN {u} LIKE '/%' THEN {origin} || {without_dots(path)} || {rest}"
        f" ELSE {origin} || {without_dots(f'({folder} || {path})')} || {rest} END"
    )


def char_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def translate(x: str, pairs: tuple[str, str]) -> str:
    return f"translate({x}, {q(pairs[0])}, {q(pairs[1])})"


def lone_jamo(x: str) -> str:
    out = sub(translate(x, T.jamo_pairs()), "[^ㄱ-ㅣ]")
    for one, two in T.SPLIT.items():
        out = f"replace({out}, '{one}', '{two}')"
    return out


def squeeze(x: str) -> str:
    """Two passes of capture groups, since matches that share a syllable don't overlap."""
    one = sub(x, r"([가-힣])[^\p{L}\p{Nd}]{1,2}([가-힣])", r"\1\2")
    return sub(one, r"([가-힣])[^\p{L}\p{Nd}]{1,2}([가-힣])", r"\1\2")


def short_number(x: str) -> str:
    return sub(sub(f"printf('%.3f', ({x})::DOUBLE)", "0+$"), r"\.$")
