"""SQL for DuckDB with the rows of queries whose results SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """CRC-32 of a text of U+0000 to U+007F and U+00C0 to U+00FF, bit by bit."""
    steps = "[-1, -1, -1, -1, -1, -1, -1, -1]"
    one = "CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END"
    codes = f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda ch: {one})), lambda b: list_concat([b], {steps})))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"


VARIANTS = f"""
    WITH RECURSIVE e AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents
    ), r AS (SELECT doc_id, run, count(*) AS c FROM e GROUP BY ALL),
    h AS (SELECT run, c, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM r),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
    v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    s AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM p),
    d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM p),
    near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS m FROM s a JOIN s b ON a.k = b.k AND a.word <> b.word
        UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.k = v.word
        UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.k = v.word
    ), b AS (SELECT word, n, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS rn, count(*) OVER (PARTITION BY word) AS n_near FROM near),
    f AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
        FROM v LEFT JOIN b ON b.word = v.word AND rn = 1
    ), c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.at WHERE g.form IS NULL
"""

# Roles before: 0 none, 1 system, 2 user, 3 assistant; what is put in leads to NEXT.
NEXT, NAMES = (2, 2, 3, 2), ("", "system", "user", "assistant")


def _edit(cost: str, letter: str, line: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'o': {line} || {rest}.o}}"


def _put_in(state: int) -> str:
    """The best from a role, with no, one or two rows put in before the next row."""
    one = NEXT[state]
    two = NEXT[one]
    first, second = (f"'{NAMES[s]}:' || chr(10)" for s in (one, two))
    return f"least(y{state}, {_edit('3', 'I', first, f'y{one}')}, {_edit('6', 'II', f'{first} || {second}', f'y{two}')})"


def _row(state: int) -> str:
    """The best from a role before a row of the conversation."""
    own, cut = "role || ':' || text || chr(10)", "CASE fault WHEN 3 THEN 3 ELSE 0 END"
    never = "{'c': 1000000000, 'a': '', 'o': ''}"
    kept = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
    keep = " ".join(f"WHEN initial = '{x}' THEN {_edit(cut, 'K', own, f'b{to}')}" for x, to in kept)
    new = NEXT[state]
    reroled = _edit(f"3 + {cut}", "R", f"'{NAMES[new]}:' || text || chr(10)", f"b{new}")
    gone = _edit("4", "D", "''", f"b{state}")
    return f"CASE WHEN fault IN (1, 2) THEN {gone} ELSE least({gone}, {reroled}, CASE {keep} ELSE {never} END) END"


REPAIRS = f"""
    WITH RECURSIVE k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
    ), g AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM k
    ), o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM g),
    q AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, rtrim(text, {WHITE}) AS bare,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o
    ), r AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM q),
    t AS (
        SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM r GROUP BY conv_id
    ), a AS (SELECT DISTINCT conv_id FROM conversations),
    z AS (
        SELECT a.conv_id, coalesce(n, 0) + 1 AS i, {{'c': 0, 'a': '', 'o': ''}} AS y0, {{'c': 1000000000, 'a': '', 'o': ''}} AS y1,
               {{'c': 1000000000, 'a': '', 'o': ''}} AS y2, {{'c': 0, 'a': '', 'o': ''}} AS y3
        FROM a LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
    ), dp AS (
        SELECT conv_id, i, {", ".join(f"{_put_in(s)} AS b{s}" for s in range(4))} FROM z
        UNION ALL
        SELECT conv_id, i, {", ".join(f"{_put_in(s)} AS b{s}" for s in range(4))} FROM (
            SELECT dp.conv_id, r.pos AS i, {", ".join(f"{_row(s)} AS y{s}" for s in range(4))}
            FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.i - 1
        )
    )
    SELECT dp.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(b0.c AS BIGINT) AS cost, b0.a AS audit, sha256(CASE WHEN b0.o = '' THEN '' ELSE left(b0.o, length(b0.o) - 1) END) AS repaired_sha256
    FROM dp LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = 1
"""
