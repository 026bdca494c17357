r"""DuckDB SQL for the queries of this subpackage that SQL can express.

Learnt models, tokenizers and parsed pages (op1, op2, op4, op5, op8, op9) and approximate search (op10)
are beyond it; their tests compare with plain versions or measure held-out rows.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Five hexadecimal digits of the digest are four base-32 digits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (list_sum(list_transform(range(5), lambda k: (instr('0123456789abcdef', hex[5 * (i // 4) + k + 1]) - 1) << (4 * (4 - k))))
     >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1)), '')"""


# The standard checksum, bit by bit, of the decimal digits of doc_id.
CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, s: list_reduce(list_prepend(xor(c, s), CAST(range(8) AS BIGINT[])),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _leaf(n_chars: str) -> str:
    field = lambda v: (f"CASE WHEN {v} IS NULL THEN '-' ELSE "  # noqa: E731
                       f"concat(strlen(CAST({v} AS VARCHAR)), ':', CAST({v} AS VARCHAR)) END")
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _linked(width: int, more: str) -> str:
    """Components of documents whose sets of ``width``-word shingles are at least 80 percent alike."""
    return rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1),
        lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle)
         WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
FROM low LEFT JOIN n USING (doc_id)"""


SQL: dict[str, str] = {
    "op3_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY 1),
x AS (SELECT *, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM p JOIN first USING (hex))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to FROM x""",
    "op6_near_duplicates": _linked(4, ", doc_id = component_id AS kept"),
    "op7_decontamination": rf"""WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS win
          FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM i)),
found AS (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS win
          FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos, n, item_id FROM found JOIN known USING (win, n)),
places AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS place FROM hit) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_set_join": _linked(5, ""),
    "op13_merkle_manifest": rf"""WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER () AS row, {_leaf('n_chars')} AS leaf,
         CASE WHEN {CRC32} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS received FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, received NULLS FIRST, row) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM d),
node AS (SELECT lang, n, 0 AS level, pos AS idx, leaf AS h FROM l
  UNION ALL SELECT lang, (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM node
            WHERE n > 1 GROUP BY lang, n, level, idx // 2),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM node WHERE n = 1),
top AS (SELECT n, 0 AS level, pos AS idx, subroot AS h FROM sub
  UNION ALL SELECT (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top
            WHERE n > 1 GROUP BY n, level, idx // 2),
fold AS (SELECT row, lang, false AS upper, n, 0 AS level, pos AS idx, received AS h, '' AS proof FROM l
  UNION ALL
  SELECT f.row, f.lang, f.upper OR f.n = 1, CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 1) // 2 END,
         CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN s.pos ELSE f.idx // 2 END,
         CASE WHEN f.n = 1 THEN f.h
              WHEN f.idx % 2 = 1 THEN sha256(coalesce(a.h, b.h) || f.h) ELSE sha256(f.h || coalesce(a.h, b.h, '')) END,
         f.proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(a.h, b.h, '') END
  FROM fold f JOIN sub s ON s.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN node a ON NOT f.upper AND a.lang IS NOT DISTINCT FROM f.lang AND a.level = f.level AND a.idx = xor(f.idx, 1)
  LEFT JOIN top b ON f.upper AND b.level = f.level AND b.idx = xor(f.idx, 1)
  WHERE NOT (f.upper AND f.n = 1))
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM l JOIN fold f ON f.row = l.row AND f.upper AND f.n = 1 JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN top t ON t.n = 1""",
}
