"""SQL that DuckDB can run, for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_groups(words: int, num: int, den: int) -> str:
    return f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}') AS w FROM documents),
 runs AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS s FROM split),
 sets AS (SELECT DISTINCT doc_id, s FROM runs), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 half AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
 links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
 reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
 SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def top_k(k: int, modulus: int) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {modulus} = 0)
 SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= {k}"""


def _crc_table() -> str:
    """The 256 remainders of the CRC-32 polynomial, as a list."""
    rows = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        rows.append(f"{n}::BIGINT")
    return f"[{', '.join(rows)}]"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes."""
    data = f"hex(encode({text}))"
    each = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc_row[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), {step}), 4294967295::BIGINT)"


def consistent_shards(shards: int) -> str:
    key = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT"
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, {key} AS key, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_crc32("coalesce(text, '')")} AS crc
   FROM documents, (SELECT {_crc_table()} AS crc_row)),
 jump AS (SELECT DISTINCT key, key AS k, n, -1::BIGINT AS place, 0::BIGINT AS following FROM rows, (VALUES ({shards}), ({shards + 1})) s(n)
   UNION ALL SELECT key, k2, n, following, CAST(floor((following + 1) * (2147483648.0::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE)) AS BIGINT)
   FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump) WHERE following < n),
 ends AS (SELECT key, any_value(place) FILTER (WHERE n = {shards}) AS shard, any_value(place) FILTER (WHERE n = {shards + 1}) AS grown FROM jump WHERE following >= n GROUP BY 1)
 SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM rows JOIN ends USING (key)"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked_search(k: int) -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""WITH words AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS w FROM documents),
 lengths AS (SELECT d, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0), totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lengths),
 tfs AS (SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS t FROM words) GROUP BY 1, 2),
 asked AS (SELECT item_id, text, unnest(list_distinct({terms})) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 dfs AS (SELECT t, count(*)::BIGINT AS df FROM tfs WHERE t IN (SELECT t FROM asked) GROUP BY 1),
 weights AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM dfs, totals),
 ms AS (SELECT d, doc_id, 10 + (90 * n * nn) // ll AS m FROM lengths, totals),
 scored AS (SELECT item_id, text, d, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
   FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN ms USING (d) GROUP BY item_id, text, d),
 placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
 SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM placed WHERE r <= {k}"""
