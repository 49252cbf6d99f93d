"""SQL for the queries of this folder that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

RULES = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, CAST(source AS VARCHAR) AS host, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
    FROM documents
), lined AS (
    SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM docs
), windows AS (
    SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
    FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM docs WHERE len(ws) >= 3)
), often AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT rid, count(DISTINCT i + j) AS n FROM often, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid
), counted AS (
    SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM lined LEFT JOIN covered c USING (rid)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
    SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged WHERE host IS NOT NULL GROUP BY host
), total AS (
    SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) AS s FROM hosts
), prior AS (
    SELECT m, greatest(s - m * m - m * (1 - m) * h / n, 0) AS between_hosts FROM total
), weight AS (
    SELECT m, CASE WHEN between_hosts > 0 THEN greatest(least(m * (1 - m) / between_hosts - 1, 1e6), 1) ELSE 1e6 END AS k FROM prior
), bad AS (
    SELECT host FROM hosts, weight WHERE (f + k * m) / (n + k) >= 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept
FROM judged
"""


def _attribute(name: str) -> str:
    start = rf"(?is)[\s\x22\x27/]{name}\s*=\s*"
    parts = [rf"\x22([^\x22]*)\x22", rf"\x27([^\x27]*)\x27", rf"([^\s\x22\x27>]+)"]
    return "trim(" + " || ".join(f"coalesce(regexp_extract(tag, '{start}{p}', 1), '')" for p in parts) + ")"


def _judged(host: str, path: str) -> str:
    """Rule and verdict of the longest fitting rule."""
    rules = [("example.com", "/de/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("net", "/", "block")]
    fits = [(f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {w} THEN '{v}'" for w, _, v in fits) + " END"
    return f"{rule} AS rule, {verdict} AS own"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return rf"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"


def _path(url: str) -> str:
    return rf"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    rest = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"


URLS = rf"""
WITH RECURSIVE tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:[^\x27\x22>]+|\x22[^\x22]*\x22|\x27[^\x27]*\x27)*>')) AS tag
    FROM pages
), named AS (
    SELECT url, lower({_attribute("rel")}) AS rel, {_attribute("href")} AS href, lower({_attribute("http-equiv")}) AS equiv,
           trim(regexp_extract({_attribute("content")}, '(?is)url\s*=\s*[\x22\x27]?([^\x22\x27]*)', 1)) AS later
    FROM tags
), targets AS (
    SELECT url, replace(CASE WHEN regexp_matches(rel, '(^|\s)canonical(\s|$)') THEN href WHEN equiv = 'refresh' THEN later END, '&amp;', '&') AS t
    FROM named
), whole AS (
    SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
                     WHEN starts_with(t, '/') THEN 'http://' || {_host("url")} || t END AS t
    FROM targets
), links AS (
    SELECT {_node("url")} AS a, {_node("t")} AS b FROM whole
), ends AS (
    SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
    SELECT a AS node, a AS other FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.other = e.a
), others AS (
    SELECT node, {_host("'http://' || other")} AS h, {_path("'http://' || other")} AS p FROM reach
), groups AS (
    SELECT node, bool_or(own = 'allow') AS let, bool_or(own = 'block') AS stop
    FROM (SELECT node, {_judged("h", "p")} FROM others) GROUP BY node
), cut AS (
    SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN let THEN 'allow' WHEN stop THEN 'block' END, 'allow') AS verdict
FROM (SELECT *, {_judged("host", "path")} FROM cut) LEFT JOIN groups USING (node)
"""


def _nibble(i: int) -> int:
    for _ in range(4):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def _crc32(ascii_text: str) -> str:
    """crc32 of a text of ASCII signs, half a byte at a time."""
    table = f"[{', '.join(str(_nibble(i)) for i in range(16))}]"
    step = "xor(a, b)"
    for _ in range(2):
        step = f"xor(({step}) >> 4, {table}[1 + (({step}) & 15)])"
    codes = f"list_transform(string_split({ascii_text}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {step}), 4294967295)"


TRIE = rf"""
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS n, digest, words
    FROM (SELECT conv_id, turn, md5(length(r) || ':' || r || t) AS digest, len(regexp_extract_all(t, '{WORD}')) AS words
          FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))
), convs AS (
    SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM own)
), ordered AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS depth, digest, words FROM (
        SELECT convs.c, 0 AS part, n, digest, words FROM convs JOIN own ON own.c = convs.c - convs.c % 20 AND n <= h
        UNION ALL SELECT convs.c, 1, n, digest, words FROM convs JOIN own ON own.c = convs.c AND n > h)
), prefixes AS (
    SELECT c, depth, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS p, words FROM ordered
    UNION ALL SELECT c, 0, '', 0 FROM convs
), linked AS (
    SELECT *, lag(p) OVER (PARTITION BY c ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY c) AS ends FROM prefixes
), nodes AS (
    SELECT p, any_value(above) AS above, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS members
    FROM linked GROUP BY p
), children AS (
    SELECT above AS p, count(*) AS n_children FROM nodes GROUP BY above
), counted AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (p)
), sums AS (
    SELECT a.p, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (n.n_children = 0) AS n_leaves
    FROM counted n JOIN prefixes a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.p
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.members, '')) AS ends_sha256
FROM counted n JOIN sums USING (p) LEFT JOIN nodes up ON up.p = n.above
"""
