"""The registered queries of the training-text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, exact_dedup, html_extract, licenses, line_dedup, minhash, packing, quality, search, substring, suffix, trie, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.page_texts(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digest(decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents, with their expected grade and the probability of the top grade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model).filter("_selected").select("doc_id", F.col("_grade").alias("expected_grade"), F.col("_tail").alias("p_top"), F.col("_selected").alias("kept"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.word_digest(substring.word_dedup(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.byte_digest(suffix.byte_dedup(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives in the shared folder, as read back from there."""
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_html, op4_decontamination, op5_quality, op6_substring, op7_exact_dedup, op8_minhash, op9_licenses, op10_suffix_array, op11_prefix_trie, op12_ranked_search, op13_warc)}

UPPER, LOWER = exact_dedup.UPPER, exact_dedup.LOWER
_PLAIN = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BLANK = "list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
        t AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        s AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
        h AS (SELECT doc_id, i, k, item_id FROM s JOIN t USING (k, win)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_substring": f"""
        WITH d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1 GROUP BY 1),
        u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS p, TRUE AS out FROM g) o USING (doc_id, p) WHERE out IS NULL GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
        f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT f.b, r.m FROM r JOIN f ON f.a = r.doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op10_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS win FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 98)) AS i FROM d)),
        g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100 AS apart FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
        v AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM (SELECT *, sum(coalesce(apart, TRUE)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
        o AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, list(a ORDER BY a) AS froms, list(z ORDER BY a) AS tos FROM v GROUP BY 1),
        k AS (SELECT d.doc_id, x, n_spans, n_removed, list_prepend(0, tos) AS tos, list_append(froms, len(x) // 2 + 1) AS froms FROM d LEFT JOIN o USING (doc_id))
        SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(tos) + 1), lambda j: substr(x, 2 * tos[j] + 1, 2 * (froms[j] - tos[j] - 1))), '') END)) AS kept_sha256 FROM k""",
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op1_line_dedup": """
        WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        hashed AS (SELECT *, trim(line, ' ') <> '' AND substr(md5(coalesce(lag(substr(md5(line), 1, 8)) OVER d, '') || substr(md5(line), 1, 8)), 1, 2) < 'f8' AS cut FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        placed AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM hashed),
        stretches AS (SELECT doc_id, stretch, string_agg(line, chr(10) ORDER BY pos) AS body, min(pos) AS a, max(pos) AS z FROM placed GROUP BY ALL),
        chunks AS (SELECT x.doc_id, x.a, y.z, x.body || chr(10) || y.body AS body FROM stretches x JOIN stretches y ON y.doc_id = x.doc_id AND y.stretch = x.stretch + 1),
        gone AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS r FROM chunks) WHERE r > 1),
        counts AS (SELECT doc_id, count(*) AS n_chunks FROM gone GROUP BY 1), dropped AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS pos FROM gone)
        SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_removed, coalesce(any_value(n_chunks), 0)::BIGINT AS n_chunks, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN dropped d ON d.doc_id = l.doc_id AND d.pos = l.pos LEFT JOIN counts c ON c.doc_id = l.doc_id GROUP BY l.doc_id""",
    "op9_licenses": f"""
        WITH templates(license_id, text) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.TEMPLATES.items())}),
        tw AS (SELECT license_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM templates),
        ts AS (SELECT license_id, least(5, len(w)) AS k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) AS t FROM tw),
        dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        ds AS (SELECT doc_id, k, list_distinct(list_transform(range(1, greatest(len(w) - k + 1, 1) + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s FROM dw CROSS JOIN (SELECT DISTINCT k FROM ts)),
        found AS (SELECT doc_id, license_id, len(list_intersect(s, t))::BIGINT AS n_shared, len(t)::BIGINT AS n_template FROM ds JOIN ts USING (k))
        SELECT *, n_shared / n_template AS containment FROM found WHERE n_shared / n_template >= {licenses.LEAST}""",
    "op11_prefix_trie": """
        WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (SELECT c, (xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4)::BIGINT AS h FROM (SELECT DISTINCT c FROM o)),
        b AS (SELECT crc.c, o.i AS d, role, text FROM crc JOIN o ON o.c = crc.c - crc.c % 20 AND o.i <= h),
        n AS (SELECT crc.c, h, count(b.d) AS k FROM crc LEFT JOIN b USING (c) GROUP BY ALL),
        t AS (SELECT * FROM b UNION ALL SELECT o.c, k + i - h, role, text FROM o JOIN n ON n.c = o.c AND i > h),
        p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS seq, len(list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '')) AS words FROM t
              UNION ALL SELECT c, 0, '', 0 FROM crc),
        m AS (SELECT c, d, words, min(c) OVER g AS node, count(*) OVER g AS n FROM p WINDOW g AS (PARTITION BY d, seq)),
        z AS (SELECT c, max(d) AS d FROM m GROUP BY 1),
        e AS (SELECT node, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM m JOIN z USING (c, d) GROUP BY ALL),
        v AS (SELECT m.node, m.d, any_value(m.n) AS n, any_value(u.node) AS parent, any_value(m.words) AS words FROM m LEFT JOIN m u ON u.c = m.c AND u.d = m.d - 1 GROUP BY ALL),
        k AS (SELECT v.node, v.d, count(w.node) AS children FROM v LEFT JOIN v w ON w.parent = v.node AND w.d = v.d + 1 GROUP BY ALL),
        x AS (SELECT v.node, v.d, n, parent, children, (n - 1) * words AS own FROM v JOIN k ON k.node = v.node AND k.d = v.d),
        s AS (SELECT m.node, m.d, count(*) FILTER (children = 0) AS leaves, sum(own) AS saved FROM x JOIN m ON m.c = x.node AND m.d <= x.d GROUP BY ALL)
        SELECT x.node AS conv_id, x.d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM x JOIN s ON s.node = x.node AND s.d = x.d LEFT JOIN e ON e.node = x.node AND e.d = x.d""",
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT row_number() OVER () AS q, item_id, {_PLAIN} AS w FROM benchmark),
        g AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d),
        t AS (SELECT q, term, count(*)::BIGINT AS times FROM (SELECT q, unnest(w) AS term FROM b) GROUP BY ALL),
        p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN t USING (term) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY term, N),
        m AS (SELECT r, 25 + (75 * len(w)::BIGINT * N) // L AS m FROM d, g WHERE len(w) > 0),
        s AS (SELECT q, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM t JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
        k AS (SELECT q, r, score, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN d USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 10""",
    "op13_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT *, row_number() OVER g AS i, first_value(page_id) OVER g AS first FROM p WINDOW g AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND i > 1 THEN first END AS refers_to FROM r""",
}
