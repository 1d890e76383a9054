"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat, licences, mixing, packing, pstable, quality, repeats, simhash, toxicity, warc
from corpusmill.sources.store import dealt, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_path())


def op2_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(dealt(table(spark, d, "documents")))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    groups = simhash.near_duplicates(dealt(table(spark, d, "documents")), words=3)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(dealt(table(spark, d, "documents")), table(spark, d, "labels"))


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.link_quotations(table(spark, d, "conversations"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    at = [F.get("positions", k).alias(f"position_{k + 1}") for k in range(mixing.MOST_PASSES)]
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", *at)


def op7_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan_licences(dealt(table(spark, d, "documents")))


def op8_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return pstable.embedding_links(table(spark, d, "embeddings"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(dealt(table(spark, d, "documents")), table(spark, d, "labels")).select("doc_id", "severity", "toxic")


def op10_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_repeats, op3_simhash, op4_quality, op5_chat, op6_mixing, op7_licences, op8_embeddings, op9_toxicity, op10_warc)}

# Lines with their levels, runs of one level, what of them can be quoted, the nearest earlier
# message that has it unquoted, votes, and threads followed one reply at a time.
MARKS = r"'^(?:[ \t]*>)+'"
FLAT = r"lower(trim(regexp_replace({0}, '[\x09-\x0D ]+', ' ', 'g')))"
UNITS = r"list_concat([array_to_string(ls, ' ')], string_split_regex(array_to_string(ls, chr(10)), '\n[\x09-\x0D ]*\n'), ls)"
QUOTATIONS = rf"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
        cut AS (SELECT r, conv_id, turn, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM m),
        marked AS (SELECT *, length(regexp_extract(l, {MARKS})) - length(replace(regexp_extract(l, {MARKS}), '>', '')) AS raw, regexp_replace(l, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM cut),
        lines AS (SELECT *, CASE WHEN raw = 0 AND regexp_matches(body, '{chat.ATTRIBUTION}') AND coalesce(lead(raw) OVER (PARTITION BY r ORDER BY i), 0) > 0 THEN -1 ELSE raw END AS level FROM marked),
        steps AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS step FROM lines),
        runs AS (SELECT *, sum(step) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM steps),
        passages AS (SELECT r, conv_id, turn, run, level, list(body ORDER BY i) AS ls FROM runs GROUP BY ALL),
        bodies AS (SELECT r, list(body ORDER BY i) FILTER (WHERE level = 0) AS ls FROM lines GROUP BY r),
        said AS (SELECT DISTINCT conv_id, turn, {FLAT.format("u")} AS k FROM (
            SELECT conv_id, turn, unnest({UNITS}) AS u FROM passages WHERE level = 0 UNION ALL SELECT conv_id, turn, array_to_string(b.ls, ' ') FROM m JOIN bodies b USING (r))),
        asked AS (SELECT DISTINCT conv_id, turn, level, {FLAT.format("u")} AS k FROM (SELECT conv_id, turn, level, unnest({UNITS}) AS u FROM passages WHERE level > 0)),
        found AS (SELECT a.conv_id, a.turn, a.level, a.k, max(s.turn) AS parent FROM asked a JOIN said s ON a.conv_id = s.conv_id AND a.k = s.k AND s.turn < a.turn WHERE a.k <> '' GROUP BY ALL),
        votes AS (SELECT conv_id, turn, parent, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, count(*) DESC, parent DESC) AS n FROM found GROUP BY conv_id, turn, level, parent),
        replies AS (SELECT conv_id, turn, parent FROM votes WHERE n = 1),
        walk AS (SELECT conv_id, turn, parent, parent AS top, 1 AS depth FROM replies UNION ALL SELECT w.conv_id, w.turn, w.parent, p.parent, w.depth + 1 FROM walk w JOIN replies p ON w.conv_id = p.conv_id AND w.top = p.turn),
        ends AS (SELECT conv_id, turn, parent, arg_max(top, depth) AS top, max(depth) AS depth FROM walk GROUP BY ALL),
        all_rows AS (SELECT m.r, m.conv_id, m.turn, role, coalesce(array_to_string(b.ls, chr(10)), '') AS body, (SELECT count(*) FROM passages p WHERE p.r = m.r AND level > 0) AS n_passages,
                     parent AS parent_turn, coalesce(top, m.turn) AS thread_turn, coalesce(depth, 0) AS depth FROM m JOIN bodies b ON m.r = b.r LEFT JOIN ends e ON m.conv_id = e.conv_id AND m.turn = e.turn)
        SELECT conv_id, turn, role, body, n_passages, parent_turn, thread_turn, depth::BIGINT AS depth,
               CASE WHEN conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(body)) END AS reply_order
        FROM all_rows"""

ORACLE_SQL = {
    "op5_chat": QUOTATIONS,
    "op6_mixing": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sizes),
        weighed AS (SELECT *, [5.0, 2.0, 1.0][(rnk - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM ranked),
        levels AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                          row_number() OVER o AS k FROM weighed WINDOW o AS (ORDER BY cap / w, rnk)),
        level AS (SELECT level FROM levels WHERE level <= cap / w ORDER BY k LIMIT 1),
        targets AS (SELECT source, rnk, source_size, least(cap, (SELECT level FROM level) * w) AS target FROM weighed),
        placed AS (SELECT s.*, rnk, source_size, target,
                          (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS st
                   FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        slopes AS (SELECT p.*, [-0.5, 0.0, 0.5][(rnk - 1) % 3 + 1]::DOUBLE AS a,
                          greatest(0, least(size, floor(target)::BIGINT - st)) AS t1, greatest(0, least(size, floor(target)::BIGINT - st - source_size)) AS t2,
                          st::DOUBLE / target AS u1, (st + source_size)::DOUBLE / target AS u2
                   FROM placed p)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (t1 + t2)::BIGINT AS taken,
               CASE WHEN t1 > 0 THEN 2::DOUBLE * u1 / ((1::DOUBLE - a) + sqrt((1::DOUBLE - a) * (1::DOUBLE - a) + 4::DOUBLE * a * u1)) END AS position_1,
               CASE WHEN t2 > 0 THEN 2::DOUBLE * u2 / ((1::DOUBLE - a) + sqrt((1::DOUBLE - a) * (1::DOUBLE - a) + 4::DOUBLE * a * u2)) END AS position_2
        FROM slopes""",
    "op8_embeddings": """
        WITH RECURSIVE pairs AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
        reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
        SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE u = e.vec_id) AS n_links, min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
        FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
}
