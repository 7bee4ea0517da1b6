"""DuckDB SQL for the corpus operators that SQL can express; the others are tested against brute force."""

from collections.abc import Iterable

from loomlog.llm.urls import LIMIT as URL_LIMIT
from loomlog.llm.urls import LOWER, RULES, SOFT, STRICT, UPPER

# The base-32 form of a SHA-1: its hex digits as bits, five at a time.
_BASE32 = """
list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER)),
                    lambda a, b: a * 2 + b), 1)), lambda a, b: a || b)
"""
_BITS = """
list_reduce(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
    1 + 4 * (instr('0123456789abcdef', substr(sha1(p), CAST(i + 1 AS BIGINT), 1)) - 1), 4)), lambda a, b: a || b)
"""



def _url_filter() -> str:
    """Rules and terms of the URL filter, one pattern and one list of terms each."""
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
        for r in sorted(RULES, key=lambda r: -len(r.text))
    ]
    rule = " ".join(f"WHEN {test} THEN '{r.text}'" for test, r in fits)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for _, r in fits)

    def hits(terms: Iterable[str]) -> str:
        listed = ", ".join(f"'{t}'" for t in sorted(terms))
        return f"len(list_filter([{listed}], lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))"

    return f"""
WITH cut AS (
    SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
counted AS (
    SELECT page_id, host, path, CASE {rule} END AS rule, CAST({hits(STRICT)} AS INTEGER) AS strict_hits,
           CAST({hits(set(SOFT) - set(STRICT))} AS INTEGER) AS soft_hits FROM parts
)
SELECT *, CAST({URL_LIMIT} * strict_hits + soft_hits AS INTEGER) AS weight,
       coalesce(CASE rule {verdict} END, CASE WHEN {URL_LIMIT} * strict_hits + soft_hits >= {URL_LIMIT} THEN 'block' ELSE 'allow' END)
           AS verdict
FROM counted
"""


# DuckDB has no CRC-32: bits of it, byte by byte, over the decimal digits of an id.
_CRC = """
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen(i)), lambda k: ascii(substr(i, k, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
        lambda c, n: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)
"""

CHECKS: dict[str, str] = {
    "op2_warc_segments": f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
marked AS (SELECT page_id, strlen(p) AS payload_bytes, {_BITS} AS bits, min(page_id) OVER (PARTITION BY p) AS first FROM rows)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM marked
""",
    "op10_exact_dedup": r"""
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY t)
""",
    "op11_phrase_collocations": rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
),
pieces AS (SELECT doc, lang, unnest(range(len(pieces))) AS piece, unnest(pieces) AS line FROM docs),
listed AS (SELECT doc, lang, piece, list_filter(string_split_regex(line, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
words AS (SELECT doc, lang, piece, unnest(range(len(words))) AS place, unnest(words) AS w1 FROM listed),
runs AS (
    SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3
    FROM words WINDOW piece AS (PARTITION BY doc, piece ORDER BY place)
),
ones AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
twos AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
    SELECT lang, w1, w2, max(f) AS f
    FROM (SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2, w3, f FROM threes) GROUP BY ALL
),
cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, a.f AS l, b.f AS r, 1 AS k
    FROM twos t JOIN ones a ON a.lang = t.lang AND a.w1 = t.w1 JOIN ones b ON b.lang = t.lang AND b.w1 = t.w2
    LEFT JOIN longer x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 WHERE coalesce(100 * x.f < 50 * t.f, TRUE)
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, a.f, b.f, 1
    FROM threes t JOIN ones a ON a.lang = t.lang AND a.w1 = t.w1 JOIN twos b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, a.f, b.f, 2
    FROM threes t JOIN twos a ON a.lang = t.lang AND a.w1 = t.w1 AND a.w2 = t.w2 JOIN ones b ON b.lang = t.lang AND b.w1 = t.w3
),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op12_prefix_trie": f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
    SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) AS turns, CAST(conv_id AS VARCHAR) AS i FROM turns GROUP BY conv_id
),
heads AS (SELECT *, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM own),
rebuilt AS (
    SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
    FROM heads c LEFT JOIN own b ON b.conv_id = c.base
),
paths AS (
    SELECT conv_id, d AS depth, len(turns) AS length, md5(CAST(turns[1:d] AS VARCHAR)) AS node,
           CASE WHEN d > 0 THEN md5(CAST(turns[1:d - 1] AS VARCHAR)) END AS above,
           CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS bytes
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
    SELECT depth, node, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(bytes) AS bytes,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
    FROM paths GROUP BY depth, node
),
family AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.above = n.node AND k.depth = n.depth + 1) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
),
below AS (
    SELECT p.depth, p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
    FROM family f JOIN paths way ON way.conv_id = f.conv_id AND way.depth <= f.depth JOIN nodes p ON p.node = way.node AND p.depth = way.depth
    GROUP BY p.depth, p.node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM family JOIN below USING (depth, node)
""",
    "op13_url_filter": _url_filter(),
}
