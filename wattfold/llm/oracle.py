"""SQL for the queries that SQL can express."""

from __future__ import annotations

from wattfold.llm.chat import CLOSE, END, OPEN, TRAINED_ROLE
from wattfold.llm.licenses import (
    LEAST_PERCENT,
    LEAST_SHARE,
    PHRASES,
    SHIFT,
    TEMPLATES,
    TEXT_TEMPLATES,
    WORD,
)

_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEIGHBOURS = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.e, q.e) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _escaped(column: str) -> str:
    """Length of an escaped text: three characters take two places."""
    return f"(2 * length({column}) - length(regexp_replace({column}, '[\\\\<>]', '', 'g')))"


CHAT = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text)
            FILTER (WHERE role = '{TRAINED_ROLE}'), '') AS loss,
        sum({len(OPEN) + len(CLOSE) + len(END)} + {_escaped("role")} + {_escaped("text")}) AS n
    FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM g
"""

QUALITY = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '{_SPACED}') AS words,
        list_filter(string_split(text, chr(10)),
            lambda l: regexp_matches(l, '{_SPACED}')) AS lines
    FROM d
), tri AS (
    SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS t
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), twice AS (
    SELECT r, t FROM tri GROUP BY r, t HAVING count(*) > 1
), covered AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (r, t)) GROUP BY r
), pair AS (
    SELECT r, max(n) AS n_top_pair
    FROM (SELECT r, words[i] AS a, words[i + 1] AS b, count(*) AS n
        FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM w) GROUP BY r, a, b)
    GROUP BY r
), chars AS (
    SELECT r, regexp_extract_all(text, '(?s).') AS c FROM w
), grams AS (
    SELECT r, sum(n::HUGEINT * n) AS squares, sum(n)::HUGEINT AS places
    FROM (SELECT r, c[i] || c[i + 1] || c[i + 2] AS g, count(*) AS n
        FROM (SELECT r, c, unnest(range(1, len(c) - 1)) AS i FROM chars WHERE len(c) > 2)
        GROUP BY r, g)
    GROUP BY r
), m AS (
    SELECT doc_id, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
        coalesce(n, 0) AS n_repeat_words, coalesce(n_top_pair, 0) AS n_top_pair,
        len(list_filter(words, lambda x: regexp_matches(x, '{_LETTERS}'))) AS n_lettered,
        coalesce(squares, 0) AS squares, coalesce(places, 0) AS places
    FROM w LEFT JOIN covered USING (r) LEFT JOIN pair USING (r) LEFT JOIN grams USING (r)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
        OR word_chars < 2 * n_words OR word_chars > 20 * n_words
        OR 5 * n_lettered < 4 * n_words OR 10 * n_top_pair > n_words
        OR 50 * squares > places * places) AS kept
FROM b
"""


def _stand(start: str, words: tuple[str, ...]) -> str:
    return " AND ".join(f"words[{start} + {i + 1}] = '{w}'" for i, w in enumerate(words))


def _licenses() -> str:
    places = ", ".join(
        f"list_filter(range(len(words)), lambda s: {_stand('s', words)}) AS p{k}"
        for k, (_, words) in enumerate(PHRASES)
    )
    shares = []
    for k, t in enumerate(TEMPLATES):
        # s is where the key stands, so the template starts key_at words before it.
        found = " + ".join(
            f"CASE WHEN s + {i - t.key_at} >= 0 AND words[s + {i - t.key_at + 1}] = '{w}' "
            "THEN 1 ELSE 0 END"
            for i, w in enumerate(t.words)
        )
        keys = f"list_filter(range(len(words)), lambda s: {_stand('s', t.key)})"
        best = f"list_max(list_transform({keys}, lambda s: {found}))"
        shares.append(f"coalesce({best}, 0) / CAST({len(t.words)} AS DOUBLE) AS share{k}")
    for k, t in enumerate(TEXT_TEMPLATES):
        n = len(t.words)
        own = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        # s is where the text starts, i a place in it.
        around = (
            f"list_slice(words, greatest(s + i - {SHIFT}, 0) + 1, "
            f"greatest(s + i + {SHIFT + 1}, 0))"
        )
        found = f"len(list_filter(range({n}), lambda i: list_contains({around}, {own}[i + 1])))"
        keys = f"list_filter(range(len(words)), lambda p: {_stand('p', t.key)})"
        starts = f"list_transform({keys}, lambda p: p - {t.key_at})"
        best = f"coalesce(list_max(list_transform({starts}, lambda s: {found})), 0)"
        shares.append(
            f"CASE WHEN 100 * {best} >= {LEAST_PERCENT * n} THEN {best} ELSE 0 END "
            f"/ CAST({n} AS DOUBLE) AS text{k}"
        )
    base = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(PHRASES)]
    own = [
        f"CASE WHEN share{k} >= {LEAST_SHARE} THEN '{t.label}' END" for k, t in enumerate(TEMPLATES)
    ]
    own += [f"CASE WHEN text{k} > 0 THEN '{t.label}' END" for k, t in enumerate(TEXT_TEMPLATES)]
    listed = "array_to_string(list_sort(list_distinct([{}])), ',')"
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    columns = [f"share{k}" for k in range(len(TEMPLATES))]
    columns += [f"text{k}" for k in range(len(TEXT_TEMPLATES))]
    best = f"greatest({', '.join(columns)})"
    return f"""
WITH w AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS words
    FROM documents
), m AS (SELECT doc_id, words, {places}, {", ".join(shares)} FROM w),
n AS (SELECT *, {every} AS places, {best} AS best FROM m)
SELECT doc_id, len(words) AS n_words, len(places) AS n_base, list_min(places) AS first_word,
    list_max(places) AS last_word, {listed.format(", ".join(base))} AS base_labels,
    {listed.format(", ".join([*base, *own]))} AS labels,
    CASE WHEN len(places) > 0 THEN 1.0::DOUBLE WHEN best >= {LEAST_SHARE} THEN best
        ELSE 0.0::DOUBLE END AS score
FROM n
"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(
        range(1, len(words)), lambda i: words[i] || chr(10) || words[i + 1]) ELSE words END) AS x
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT * FROM s JOIN n USING (doc_id)),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS c
    FROM t AS a JOIN t AS b ON a.x = b.x AND a.doc_id < b.doc_id
        AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY ALL
), e AS (
    SELECT a, b FROM p WHERE 100 * c >= 80 * (m + n - c)
    UNION SELECT b, a FROM p WHERE 100 * c >= 80 * (m + n - c)
), reach AS (
    SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
    doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN n USING (doc_id)
    LEFT JOIN least ON least.a = doc_id
"""

DIVERGENCE = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(text, '') AS text
    FROM documents
), t AS (
    SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format("text")},
        '{_LETTERS}')) AS term
    FROM d
), k AS (
    SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (
    SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY lang
), c AS (
    SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
    SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + v.v) AS p,
        1 + 1000000000 * (k.c + 1) // (v.n + v.v) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), f AS (
    SELECT a.lang, a.source, b.source AS item,
        CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
    FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)
    AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""

SEARCH = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
    SELECT r, unnest(regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}')) AS term FROM d
), f AS (
    SELECT r, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (
    SELECT r, count(*) AS n FROM t GROUP BY r
), a AS (
    SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM n
), m AS (
    SELECT n.r, 25 + (75 * n.n * a.n) // a.l AS m FROM n, a
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * a.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM f, a GROUP BY term, a.n
), i AS (
    SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark GROUP BY item_id
), q AS (
    SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}')) AS term FROM i
), s AS (
    SELECT q.item_id, f.r,
        CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL
), o AS (
    SELECT s.item_id, d.doc_id, s.score, row_number() OVER (
        PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank
    FROM s JOIN d USING (r) WHERE s.score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

SQL = {
    "op2_vp_tree_neighbours": NEIGHBOURS,
    "op5_chat_format": CHAT,
    "op6_quality_cascade": QUALITY,
    "op9_license_scan": _licenses(),
    "op10_minhash_hamming": NEAR_DUPLICATES,
    "op11_source_divergence": DIVERGENCE,
    "op13_ranked_search": SEARCH,
}
