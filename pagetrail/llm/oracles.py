"""DuckDB SQL of the queries whose arithmetic SQL has no function for: checksums and permutations, written out."""

from __future__ import annotations

#: crc32 by its definition: the table of 256 remainders of the reflected polynomial, then a fold over the bytes.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""


def crc32(text: str, table: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text; ``table`` is a column with CRC_TABLE."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, {table}[1 + (xor(c, x) & 255)]), 4294967295), 4294967295)"


def _stirred(half: str, key: int) -> str:
    wrapped = lambda x, by: f"(({x})::UHUGEINT * {by} % 18446744073709551616)::UBIGINT"
    first = wrapped(f"xor({half}, {key}::UBIGINT)", 0xBF58476D1CE4E5B9)
    return f"({wrapped(f'xor({first}, {first} >> 32)', 0x9E3779B97F4A7C15)} >> 32)"


def _network(source: str, seed: int) -> str:
    """Six rounds over the columns number, x, a, b, total of ``source``."""
    sql = f"SELECT number, total, a, b, x // b AS l, x % b AS r FROM {source}"
    for i in range(6):
        key = (seed + 1 + i) * 0x9E3779B97F4A7C15 % 2**64
        if i % 2:
            sql = f"SELECT number, total, a, b, l, (r + {_stirred('l', key)} % b) % b AS r FROM ({sql})"
        else:
            sql = f"SELECT number, total, a, b, (l + {_stirred('r', key)} % a) % a AS l, r FROM ({sql})"
    return f"SELECT number, total, a, b, l * b + r AS x FROM ({sql})"


def sharding(shards: int, seed: int) -> str:
    return f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
        docs AS MATERIALIZED (
          SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc32("coalesce(text, '')", 't')} AS text_crc32
          FROM documents, t),
        numbered AS MATERIALIZED (
          SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::UBIGINT AS number FROM docs),
        start AS (
          SELECT number, number AS x, total, a, ceil(total / a)::UBIGINT AS b
          FROM numbered, (SELECT count(*)::UBIGINT AS total, ceil(sqrt(count(*)))::UBIGINT AS a FROM docs)),
        walk AS (
          {_network("start", seed)}
          UNION ALL
          {_network("(SELECT * FROM walk WHERE x >= total)", seed)})
        SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot,
               NULL::INTEGER AS grown_shard
        FROM numbered JOIN walk USING (number) WHERE x < total"""


def spelling(every: int, letters: int, occurrences: int, times: int) -> str:
    return f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
        runs AS (
          SELECT doc_id, run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
                FROM documents)
          GROUP BY doc_id, run),
        hashed AS (SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run", "t")} AS h FROM runs, t),
        shaped AS (
          SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                 ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (
          SELECT word, sum(n)::BIGINT AS n FROM shaped WHERE length(word) >= {letters} GROUP BY word HAVING sum(n) >= {occurrences}),
        holes AS MATERIALIZED (
          SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS hole
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
        near AS MATERIALIZED (
          SELECT a.word, a.n, b.word AS other, b.n AS other_n
          FROM holes a JOIN holes b ON a.hole = b.hole AND a.p = b.p AND a.word <> b.word
          UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.hole = w.word
          UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.hole = w.word),
        best AS MATERIALIZED (
          SELECT word, count(*) AS n_near, arg_min(other, {{'less': -other_n, 'other': other}}) AS other,
                 max(other_n) AS other_n, max(other_n) >= {times} * any_value(n) AS fits
          FROM near GROUP BY word),
        chain AS (
          SELECT word, other AS goal, 1 AS steps FROM best WHERE fits
          UNION ALL SELECT c.word, b.other, c.steps + 1 FROM chain c JOIN best b ON b.word = c.goal WHERE b.fits),
        roots AS (SELECT word, arg_max(goal, steps) AS root FROM chain GROUP BY word)
        SELECT word, CASE WHEN fits THEN other END AS form, coalesce(root, word) AS root, n,
               coalesce(n_near, 0) AS n_near, CASE WHEN fits THEN other_n END AS form_n
        FROM words LEFT JOIN best USING (word) LEFT JOIN roots USING (word)"""
