"""DuckDB statements that give the same rows as the registered queries.

They use none of the rewrites of the Spark side: containment is ``contains``,
lines are not merged, and every half is looked up by a plain join.
"""

from __future__ import annotations

from phrasemine.shapes import MAX_GAP, MAX_WORDS, Shape, all_shapes, chunk_shapes

DOCUMENT_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"
CONVERSATION_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM conversations"

PAIRS = """
    SELECT u.conv_id, u.turn, replace(u.text, chr(10), ' ') AS src, replace(a.text, chr(10), ' ') AS dst
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""

MIXED = f"""
    SELECT dst || '|' || src AS value FROM ({PAIRS})
    UNION ALL SELECT line AS value FROM ({DOCUMENT_LINES})"""

TOKENS = "list_filter(string_split({line}, ' '), lambda x: x <> '')"


def emitted(source: str, shapes: list[Shape], keep: str = "", line: str = "line") -> str:
    """Chunk occurrences of ``source``, one branch per shape."""
    prefix = f"{keep}, " if keep else ""
    tokens = f"SELECT {prefix}{TOKENS.format(line=line)} AS t FROM ({source})"

    def branch(shape: Shape) -> str:
        words = " || ' ' || ".join(f"t[i + {offset}]" for offset in shape.offsets)
        return (
            f"SELECT {prefix}{words} AS text, {shape.code} AS type FROM "
            f"(SELECT {prefix}t, unnest(range(1, len(t) - {shape.offsets[-1]} + 1)) AS i FROM toks)"
        )

    return f"WITH toks AS ({tokens}) " + " UNION ALL ".join(map(branch, shapes))


def counted(source: str, shapes: list[Shape], line: str = "line") -> str:
    return f"SELECT text, type, count(*) AS n FROM ({emitted(source, shapes, line=line)}) GROUP BY text, type"


def words(first: int, last: int) -> str:
    return " || ' ' || ".join(f"split_part(text, ' ', {k})" for k in range(first, last + 1))


def halves(side: str, shapes: list[Shape]) -> str:
    """Text and type of one half, as two CASE expressions."""
    text, code = [], []
    for shape in shapes:
        first, last = (1, shape.left_words) if side == "left" else (shape.left_words + 1, shape.words)
        text.append(f"WHEN {shape.code} THEN {words(first, last)}")
        code.append(f"WHEN {shape.code} THEN {Shape(last - first + 1).code}")
    return f"CASE type {' '.join(text)} END AS {side}_text, CASE type {' '.join(code)} END AS {side}_type"


def chi2(a: str = "n11", b: str = "n10", c: str = "n01", d: str = "n00") -> str:
    a, b, c, d = (f"CAST({cell} AS DOUBLE)" for cell in (a, b, c, d))
    spread = f"((({a} + {b}) * ({c} + {d})) * (({a} + {c}) * ({b} + {d})))"
    cross = f"({a} * {d} - {b} * {c})"
    return f"CASE WHEN {spread} <> 0 THEN ({a} + {b} + {c} + {d}) * {cross} * {cross} / {spread} ELSE 20.0 END"


def cells(source: str, max_words: int = 2, max_gap: int = 1, where: str = "true") -> str:
    shapes = chunk_shapes(max_words, max_gap)
    return f"""
    WITH counts AS MATERIALIZED ({counted(source, all_shapes(max_words, max_gap))}),
    cut AS (SELECT text, type, n, {halves('left', shapes)}, {halves('right', shapes)}
            FROM counts WHERE type > 0 AND {where}),
    margins AS (
        SELECT cut.text, cut.type, least(cut.n, s.lines) AS n11, s.lines,
               coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r
        FROM cut
        LEFT JOIN counts l ON l.text = left_text AND l.type = left_type
        LEFT JOIN counts r ON r.text = right_text AND r.type = right_type
        CROSS JOIN (SELECT count(*) AS lines FROM ({source})) s),
    outer_cells AS (
        SELECT text, type, lines, n11,
               CASE WHEN l - n11 > lines THEN lines - n11 ELSE l - n11 END AS n10,
               CASE WHEN r - n11 > lines THEN lines - n11 ELSE r - n11 END AS n01
        FROM margins)
    SELECT text, type, n11, n10, n01, lines - n10 - n01 - n11 AS n00 FROM outer_cells"""


def scores(*args, **kwargs) -> str:
    return f"SELECT text, type, n11, n10, n01, n00, {chi2()} AS chi2 FROM ({cells(*args, **kwargs)})"


def kept(*args, **kwargs) -> str:
    return f"SELECT * FROM ({scores(*args, **kwargs)}) WHERE chi2 < 7"


def groups(source: str, max_words: int = 2, max_gap: int = 1, having: str = "true") -> str:
    pooled = chi2(*[f"sum({cell})" for cell in ("n11", "n10", "n01", "n00")])
    return f"""
    WITH scored AS MATERIALIZED ({scores(source, max_words, max_gap)}),
    pooled AS (
        SELECT text, '#' || string_agg(CAST(type AS VARCHAR), '#' ORDER BY type) AS types, {pooled} AS chi2
        FROM scored GROUP BY text HAVING count(*) > 1),
    held AS MATERIALIZED (SELECT * FROM pooled WHERE {having})
    SELECT s.text, 1 AS level, s.type, h.types, s.chi2 FROM scored s JOIN held h ON h.text = s.text
    UNION ALL
    SELECT text, 2 AS level, 0 AS type, types, chi2 FROM held"""


def line_chunks(shapes: list[Shape], line: str) -> str:
    return emitted("SELECT * FROM pairs", shapes, "conv_id, turn", line)


def matching(chunks: str, max_words: int, max_gap: int, match: str = "substring") -> str:
    """Common table expressions ``pairs``, ``chunks`` and ``matched``; chunks are sought in distinct texts."""
    shapes = chunk_shapes(max_words, max_gap)
    loose = "type % 100 = 0" if match == "substring" else "false"
    return f"""
    pairs AS MATERIALIZED ({PAIRS}),
    chunks AS MATERIALIZED ({chunks}),
    texts AS MATERIALIZED (SELECT DISTINCT src FROM pairs),
    inside AS MATERIALIZED (
        SELECT c.text, c.type, t.src FROM (SELECT * FROM chunks WHERE {loose}) c
        JOIN texts t ON contains(t.src, c.text)),
    matched AS MATERIALIZED (
        SELECT text, type, conv_id, turn FROM inside JOIN pairs USING (src)
        UNION ALL
        SELECT DISTINCT c.text, c.type, conv_id, turn
        FROM chunks c JOIN ({line_chunks(shapes, 'src')}) e ON e.text = c.text AND e.type = c.type
        WHERE NOT (c.{loose}))""".replace("c.false", "false")


def matched(chunks: str, max_words: int, max_gap: int, match: str = "substring") -> str:
    return f"WITH {matching(chunks, max_words, max_gap, match)} SELECT text, type, conv_id, turn FROM matched"


def translations(match: str = "substring") -> str:
    """Common table expressions up to ``scored``, one row for each chunk and candidate."""
    shapes = all_shapes(2, 1)
    return f"""WITH {matching(kept(DOCUMENT_LINES), 2, 1, match)},
    joint AS MATERIALIZED (
        SELECT m.text, m.type, d.text AS dst_text, d.type AS dst_type, count(*) AS n
        FROM matched m JOIN ({line_chunks(chunk_shapes(2, 1), 'dst')}) d USING (conv_id, turn)
        GROUP BY ALL),
    origin AS MATERIALIZED ({counted('SELECT * FROM pairs', shapes, 'src')}),
    destination AS MATERIALIZED ({counted('SELECT * FROM pairs', shapes, 'dst')}),
    margins AS (
        SELECT j.text, j.type, j.dst_text, j.dst_type, j.n AS n11,
               coalesce(o.n, 0) - j.n AS n10, coalesce(d.n, 0) - j.n AS n01, s.lines
        FROM joint j
        LEFT JOIN origin o ON o.text = j.text AND o.type = j.type
        LEFT JOIN destination d ON d.text = j.dst_text AND d.type = j.dst_type
        CROSS JOIN (SELECT count(*) AS lines FROM pairs) s),
    four AS (SELECT text, type, dst_text, dst_type, n11, n10, n01, lines - n10 - n01 - n11 AS n00 FROM margins),
    scored AS MATERIALIZED (SELECT *, {chi2()} AS score FROM four)"""


def joint(match: str = "substring") -> str:
    return f"{translations(match)} SELECT text, type, dst_text, dst_type, n FROM joint"


def candidates(match: str = "substring") -> str:
    return f"{translations(match)} SELECT * FROM scored"


def ranked(order: str, match: str = "substring") -> str:
    """Common table expressions up to ``ranked``."""
    keys = ", ".join(f"{key} {order}" for key in ("score", "dst_text || '@' || CAST(dst_type AS VARCHAR)"))
    return f"""{translations(match)},
    ranked AS (
        SELECT text, type, dst_text, dst_type, score,
               CAST(row_number() OVER (PARTITION BY text, type ORDER BY {keys}) AS INTEGER) AS rank,
               count(*) OVER (PARTITION BY text, type) AS found
        FROM scored)"""


def best(order: str, top_k: int, match: str = "substring") -> str:
    return f"""{ranked(order, match)}
    SELECT r.text, r.type, k.chi2 AS chunk_chi2, r.rank, r.dst_text, r.dst_type, r.score
    FROM ranked r JOIN chunks k ON k.text = r.text AND k.type = r.type
    WHERE found > 5 AND rank <= {top_k}"""


def fixed(x: str, digits: int = 6) -> str:
    """A score with a fixed number of decimals, by double-precision arithmetic alone."""
    whole, unit = f"floor(abs({x}))", 10**digits
    part = f"CAST(floor((abs({x}) - {whole}) * {unit}e0 + 5e-1) AS BIGINT)"
    return (
        f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
        f" || CAST(CAST({whole} AS BIGINT) + CASE WHEN {part} >= {unit} THEN 1 ELSE 0 END AS VARCHAR)"
        f" || '.' || lpad(CAST({part} % {unit} AS VARCHAR), {digits}, '0')"
    )


def gapped(words_: int) -> list[Shape]:
    return [s for s in chunk_shapes(words_, MAX_GAP) if s.words == words_ and s.gap]


def oracle_sql() -> dict[str, str]:
    documents, conversations = DOCUMENT_LINES, CONVERSATION_LINES
    fields = "string_split(rtrim(value, '|'), '|')"
    tokens = TOKENS.format(line="line")
    full = chunk_shapes(MAX_WORDS, MAX_GAP)
    kept_full = kept(conversations, MAX_WORDS, MAX_GAP)
    return {
        "corpus_lines": documents,
        "parallel_parse": f"SELECT value, {fields}[1] AS dst, {fields}[2] AS src FROM ({MIXED}) WHERE len({fields}) >= 2",
        "parallel_rejects": f"SELECT value FROM ({MIXED}) WHERE len({fields}) < 2",
        "parallel_line_counts": f"""SELECT count(*) AS lines, CAST(count_if(len({fields}) >= 2) AS BIGINT) AS accepted,
            CAST(count_if(len({fields}) < 2) AS BIGINT) AS rejected FROM ({MIXED})""",
        "corpus_size": f"SELECT count(*) AS lines FROM ({documents})",
        "tokenize": f"""SELECT line, CAST(len({tokens}) AS INTEGER) AS n_tokens,
            coalesce(array_to_string({tokens}, chr(10)), '') AS tokens FROM ({documents})""",
        "unigram_counts": counted(documents, [Shape(1)]),
        "ngram_counts": counted(documents, chunk_shapes(MAX_WORDS, 0)),
        "skip_bigram_counts": counted(documents, gapped(2)),
        "skip_trigram_counts": counted(conversations, gapped(3)),
        "skip_4gram_counts": counted(conversations, gapped(4)),
        "chunk_counts": counted(documents, all_shapes(2, 1)),
        "chunk_counts_full": counted(conversations, all_shapes(MAX_WORDS, MAX_GAP)),
        "chunk_constituents": f"""SELECT text, type, {halves('left', full)}, {halves('right', full)}
            FROM ({counted(conversations, full)})""",
        "chunk_contingency": cells(documents),
        "chi_square_expr": f"""SELECT n11, n10, n01, n00, {chi2()} AS chi2 FROM
            (SELECT DISTINCT CAST(n11 AS BIGINT) AS n11, CAST(n10 AS BIGINT) AS n10,
                    CAST(n01 AS BIGINT) AS n01, CAST(n00 AS BIGINT) AS n00
             FROM (WITH t(n11, n10, n01, n00) AS MATERIALIZED (
                       WITH single AS MATERIALIZED ({cells(documents)})
                       SELECT n11, n10, n01, n00 FROM single
                       UNION ALL SELECT sum(n11), sum(n10), sum(n01), sum(n00) FROM single GROUP BY text)
                   SELECT * FROM t UNION ALL SELECT n11, n10, n01, -n00 FROM t
                   UNION ALL SELECT 0, n10, n01, n00 FROM t))""",
        "chunk_scores": f"SELECT text, type, chi2 FROM ({scores(documents)})",
        "chunk_scores_full": scores(conversations, MAX_WORDS, MAX_GAP),
        "filtered_chunks": kept(documents),
        "filtered_chunks_no_hapax": kept(documents, where="n <> 1"),
        "chunk_type_groups": f"""SELECT text, string_agg(type || ':' || n, '#' ORDER BY type) AS types
            FROM ({counted(documents, chunk_shapes(2, 1))}) GROUP BY text""",
        "group_scores": groups(documents),
        "group_scores_full": groups(conversations, MAX_WORDS, MAX_GAP),
        "filtered_groups": groups(documents, having="chi2 < 6.63"),
        "origin_counts": counted(PAIRS, all_shapes(2, 1), "src"),
        "destination_counts": counted(PAIRS, all_shapes(2, 1), "dst"),
        "match_substring": matched(kept(conversations, MAX_WORDS, 0), MAX_WORDS, 0),
        "match_gapped": matched(
            f"SELECT * FROM ({kept_full}) WHERE type % 100 > 0", MAX_WORDS, MAX_GAP, "token"
        ),
        "chunk_line_matches": matched(kept(documents), 2, 1),
        "joint_counts": joint(),
        "translation_scores": candidates(),
        "ranked_translations": f"{ranked('DESC')} SELECT text, type, rank, dst_text, dst_type, score FROM ranked",
        "top_translations": best("DESC", 5),
        "top_translations_token": best("DESC", 5, "token"),
        "weakest_translations": best("ASC", 3),
        "render_chunks": f"SELECT '[' || text || '@' || type || '@' || {fixed('chi2')} || ']' AS line FROM ({kept(documents)})",
        "render_groups": f"""SELECT '[' || string_agg(text || '@' || {fixed('chi2')} || '@' || level || '@' ||
                CASE level WHEN 1 THEN CAST(type AS VARCHAR) ELSE types END, ', ' ORDER BY level, type) || ']' AS line
            FROM ({groups(documents, having="chi2 < 6.63")}) GROUP BY text""",
        "render_translations": f"""SELECT '(' || text || '@' || type || '@' || {fixed('chunk_chi2')} || ',' || string_agg(
                '(' || dst_text || '@' || dst_type || ',' || {fixed('score')} || ')', ',' ORDER BY rank) || ')' AS line
            FROM ({best("DESC", 5)}) GROUP BY text, type, chunk_chi2""",
        "parsed_chunks": f"SELECT text, type, chi2 FROM ({kept(documents)})",
        "parsed_groups": f"""SELECT text, level, CASE level WHEN 1 THEN CAST(type AS VARCHAR) ELSE types END AS member, chi2
            FROM ({groups(documents, having="chi2 < 6.63")})""",
        "parsed_translations": best("DESC", 5),
    }
