"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sparkwell.llm import chat, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def secret_scan() -> str:
    """Spans as in the operator: what is left between the matches gives their starts."""
    rules = secrets.BASE + secrets.EXTRA
    parts = []
    for i, r in enumerate(rules):
        p = _quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {i} AS place, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {p}) AS h,"
            f" regexp_extract_all(t, {p}, {r.group}) AS v, regexp_split_to_array(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})"
        )
    counts = ", ".join(
        f"count(*) FILTER (place = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
p AS (SELECT doc_id, place, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS a, length(h[i]) AS n FROM e WHERE length(v[i]) >= least),
s AS (SELECT doc_id, {counts},
 string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, place) FILTER (place < {len(secrets.BASE)}) AS base,
 string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, place) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


def chat_formatting(template: chat.Template = chat.TEMPLATE) -> str:
    special = "length(regexp_replace({x}, '[^" + "".join("\\\\" if c == "\\" else c for c in template.special) + "]', '', 'g'))"
    grown = lambda x: f"length({x}) + {special.format(x=x)}"
    markup = len(template.head + template.mid + template.tail)
    follows = " OR ".join(
        f"(coalesce(lag(role) OVER w, '{template.start}') = '{a}' AND role IN ({', '.join(map(_quoted, sorted(b)))}))"
        for a, b in template.follows.items()
    )
    said = _quoted("\\### Assistant: </turn> ok")
    loss = ", ".join(map(_quoted, sorted(template.loss_roles)))
    final = ", ".join(map(_quoted, sorted(template.final)))
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
f AS (SELECT *, ({follows}) AS fits, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM c
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
 sum({markup} + {grown("role")} + {grown("text")})::BIGINT AS formatted_chars,
 bool_and(fits) AND bool_and(NOT last OR role IN ({final})) AS valid FROM f GROUP BY conv_id"""


def near_duplicates() -> str:
    """All pairs that share a shingle, counted; then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS sh FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan(),
    "op2_chat_formatting": chat_formatting(),
    "op4_ngram_jaccard_join": near_duplicates(),
}
