"""Text, quality-control, fingerprint and scoring queries over documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import labeling, near_dup, qc, rouge, summarize
from corpusmill.sources.store import dealt, table, written


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def q_word_count(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n"))


def q_normalize_text(spark, d):
    return dealt(docs(spark, d)).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


def q_boilerplate_lines(spark, d):
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(F.filter(lines, T.is_boilerplate)).cast("bigint").alias("n_boilerplate"))


def q_min_words_50(spark, d):
    return docs(spark, d).where(T.word_count(F.col("text")) >= 50).agg(F.count("*").alias("n"))


def q_top_n_per_source(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs(spark, d).select("source", "doc_id", F.row_number().over(w).alias("pos")).where("pos <= 3")


def q_dense_article_id(spark, d):
    """Ranks over the whole order by way of offsets of ranges of bounded size, so no task holds all rows."""
    kept, _ = written(docs(spark, d).where(T.word_count(F.col("text")) >= 50).select("doc_id"), "ids")
    ranges = max(1, -(-kept.count() // RANGE_ROWS))
    placed, _ = written(kept.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()), "ranged-ids")
    base = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("doc_id"))
    return placed.withColumn("r", rank).join(base, "range").select("doc_id", (F.col("base") + F.col("r")).alias("article_id"))


#: Ids that one task ranks.
RANGE_ROWS = 1_000_000


def q_sentence_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n"))


def q_numeric_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.numerics(F.col("text")), " ").alias("tokens"))


def q_entities(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.entities(F.col("text")), "|").alias("names"))


def summaries(spark, d):
    """First, middle and last sentence of each text as its summary; the source is the text without the last one.

    Together they read every sentence, and what only the last one holds is unsupported.
    """
    parts = dealt(docs(spark, d)).select("doc_id", T.sentences(F.col("text")).alias("s")).withColumn("n", F.size("s"))
    chosen = F.array_compact(F.array(F.get("s", 0), F.get("s", F.floor(F.col("n") / 2).cast("int")), F.get("s", F.col("n") - 1)))
    rest = F.slice("s", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))
    return parts.select(F.col("doc_id").alias("article_id"), F.array_join(chosen, " ").alias("summary"), F.array_join(rest, " ").alias("source_text"), F.when(F.col("doc_id") % 50 == 0, "not news").alias("refusal_reason"))


def q_unsupported_numbers(spark, d):
    numbers = F.filter(T.numerics(F.col("summary")), lambda t: ~T.contains_numeric(F.col("source_text"), t))
    return summaries(spark, d).select("article_id", F.array_join(numbers, " ").alias("missing"))


def q_unsupported_entities(spark, d):
    names = F.filter(T.entities(F.col("summary")), lambda t: ~T.contains_entity(F.col("source_text"), t))
    return summaries(spark, d).select("article_id", F.array_join(names, "|").alias("missing"))


def q_qc_reasons(spark, d):
    done = qc.run_qc(summaries(spark, d), fuzzy=False)
    return done.select("article_id", F.array_join(F.filter("qc_details.reasons", lambda r: ~r.startswith("unsupported")), ";").alias("reasons"))


def q_qc_full(spark, d):
    done = qc.run_qc(summaries(spark, d))
    return done.select("article_id", "qc_passed", F.array_join("qc_details.reasons", ";").alias("reasons"))


def q_qc_pass_rate(spark, d):
    return qc.qc_counts(qc.run_qc(summaries(spark, d), fuzzy=False).withColumn("qc_passed", F.size(F.filter("qc_details.reasons", lambda r: ~r.startswith("unsupported"))) == 0))


def q_ngram_weights(spark, d):
    return near_dup.gram_totals(dealt(docs(spark, d)))


def prints(spark, d):
    return dealt(docs(spark, d)).select("doc_id", F.col("doc_id").alias("seq"), near_dup.simhash64("text").alias("fp"))


def q_simhash64(spark, d):
    return prints(spark, d).select("doc_id", "fp")


def q_hamming_pairs(spark, d):
    distinct = prints(spark, d).groupBy("fp").agg(F.min("seq").alias("seq"))
    return near_dup.edges(distinct)


def q_near_dup_kept(spark, d):
    return near_dup.near_dup_kept(prints(spark, d)).select("doc_id")


def q_exact_dup_groups(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def q_prompt_render(spark, d):
    prompt = labeling.render_prompt(F.substring_index("text", "\n", 1), F.lit(None).cast("string"), F.col("source"), F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(prompt).alias("digest"), F.length(prompt).cast("bigint").alias("chars"))


def q_parse_label_json(spark, d):
    """Responses made of every document: some bad, some refusing, some with a confidence above 1."""
    good = F.to_json(F.struct(F.col("text").alias("summary"), F.array("lang", "source").alias("key_entities"), (F.col("n_chars") / 2000).alias("confidence"), F.when(F.col("doc_id") % 5 == 0, "not news").alias("refusal_reason")))
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{"), "text")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    rows = dealt(docs(spark, d)).select("doc_id", raw.alias("raw")).select("doc_id", labeling.parse_labels("raw").alias("p"))
    return rows.select("doc_id", F.md5("p.summary").alias("summary"), F.array_join("p.key_entities", ",").alias("names"), "p.confidence", F.when(F.col("p.error").isNull(), F.col("p.refusal_reason")).alias("refusal"), F.col("p.error").isNotNull().alias("failed"))


def halves(spark, d):
    """The first half of each text's characters as prediction of the second."""
    half = "length(text) div 2"
    return dealt(docs(spark, d)).select(F.col("doc_id").alias("id"), F.expr(f"substring(text, 1, cast({half} as int))").alias("prediction"), F.expr(f"substring(text, cast({half} as int) + 1)").alias("reference"))


def q_rouge1(spark, d):
    return rouge.mean_f(rouge.rouge_n(halves(spark, d), 1), "rouge1").select(F.round("rouge1", 9).alias("rouge1"))


def q_rouge2(spark, d):
    return rouge.mean_f(rouge.rouge_n(halves(spark, d), 2), "rouge2").select(F.round("rouge2", 9).alias("rouge2"))


def q_rouge_l(spark, d):
    return rouge.rouge_l(halves(spark, d)).select("id", F.round("f", 9).alias("f"))


def q_summarize(spark, d):
    return docs(spark, d).select("doc_id", summarize.summarizer()(F.col("text")).alias("summary"))


def q_call_labeler(spark, d):
    """The label stage with a model that answers from the prompt alone."""
    rows = docs(spark, d).select(F.col("doc_id").alias("article_id"), F.lit("").alias("title"), F.lit(None).cast("string").alias("category"), "source", F.col("text").alias("content_text"))
    out = labeling.label_rows(rows, both_ends_model)
    return out.select("article_id", F.md5("summary").alias("summary"), "confidence", "prompt_version")


def both_ends_model(system: str, user: str) -> str:
    """The first and last 25 words of the content."""
    body = user.split('"""\n', 1)[1].rsplit('\n"""', 1)[0].split()
    return json.dumps({"summary": " ".join(body[:25] + body[-25:]), "key_entities": [], "confidence": 0.5, "refusal_reason": None})


QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}

S, NS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BOILER = rf"(?im)^{S}*(?:{'|'.join(T.BOILERPLATE)})"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{S}+|{S}+$', '', 'g')), lambda s: s <> '')"
NUMERICS = rf"list_filter(list_transform(regexp_extract_all(text, '{NS}*[0-9]{NS}*'), lambda x: regexp_replace(x, '^[.,;:%()\[\]{{}}]+|[.,;:%()\[\]{{}}]+$', '', 'g')), lambda x: x <> '')"
NAME_RE = rf"[{T.CAPITALS}][\p{{L}}\p{{N}}_À-ỹ]*"
#: Distinct elements in order of first appearance.
NAMES = rf"(SELECT list(n ORDER BY k) FROM (SELECT n, min(k) AS k FROM (SELECT unnest(a) AS n, generate_subscripts(a, 1) AS k FROM (SELECT list_transform(regexp_extract_all(text, '{NAME_RE}(?:{S}+{NAME_RE})+'), lambda x: x) AS a)) GROUP BY n))"
COLLAPSED = r"trim(regexp_replace({0}, '[\s\-–—.,;:()\[\]{{}}/]+', ' ', 'g'))"
SUMMARY = f"""SELECT doc_id AS article_id, array_to_string(list_filter([s[1], s[n // 2 + 1], s[n]], lambda x: x IS NOT NULL), ' ') AS text, array_to_string(s[1:n - 1], ' ') AS src, refused
    FROM (SELECT *, len(s) AS n FROM (SELECT doc_id, {SENTENCES} AS s, doc_id % 50 = 0 AS refused FROM documents))"""
REASONS = f"""
    SELECT article_id, concat_ws(';', CASE WHEN refused THEN 'llm_refusal:not news' END, CASE WHEN w < 40 THEN 'too_short:' || w || '<40' END, CASE WHEN w > 90 THEN 'too_long:' || w || '>90' END,
           CASE WHEN n < 2 THEN 'too_few_sentences:' || n || '<2' END, CASE WHEN n > 4 THEN 'too_many_sentences:' || n || '>4' END) AS reasons
    FROM (SELECT *, len(regexp_extract_all(text, '{NS}+')) AS w, len({SENTENCES}) AS n FROM ({SUMMARY}))"""
RUN_OF = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), '')"
GRAMS = f"""
    SELECT doc_id, gram, least(count(*), 50) AS weight FROM (
        SELECT doc_id, unnest(list_transform(range(1, greatest(length(t) - 3, 1) + 1), lambda i: t[i:i + 3])) AS gram FROM (SELECT doc_id, {RUN_OF} AS t FROM documents) WHERE t <> '') GROUP BY ALL"""
#: Signed fingerprint: bit i is set if over half of the weight has it; the top bit counts negative.
PRINTS = f"""
    SELECT d.doc_id, coalesce(p.fp, 0) AS fp FROM documents d LEFT JOIN (
        SELECT doc_id, (sum(CASE WHEN 2 * v > total THEN CASE WHEN i = 63 THEN -(2::HUGEINT ** 63)::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END))::BIGINT AS fp
        FROM (SELECT doc_id, i, sum(CASE WHEN get_bit(h, (63 - i)::INT) = 1 THEN weight ELSE 0 END) AS v, sum(weight) AS total
              FROM (SELECT doc_id, weight, ('0x' || md5(gram)[17:32])::UBIGINT::BIT AS h, unnest(range(64)) AS i FROM ({GRAMS})) GROUP BY doc_id, i) GROUP BY doc_id) p USING (doc_id)"""
PROMPT = "'Tiêu đề: ' || split_part(text, chr(10), 1) || chr(10) || 'Chuyên mục: ' || chr(10) || 'Nguồn: ' || source || chr(10) || chr(10) || 'Nội dung:' || chr(10) || '\"\"\"' || chr(10) || body || '" + labeling.USER_PROMPT.partition("{content_text}")[2] + "'"
BODY = "CASE WHEN length(text) > 6000 THEN CASE WHEN contains(text[1:6000], ' ') THEN regexp_extract(text[1:6000], '(?s)^(.*) ', 1) ELSE text[1:6000] END || ' [...]' ELSE text END"


def rouge_sql(n: int) -> str:
    gram = "w" if n == 1 else f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    return f"""
        WITH s AS (SELECT doc_id, side, unnest({gram}) AS gram FROM (
            SELECT doc_id, 0 AS side, regexp_extract_all(lower(text[1:length(text) // 2]), '[a-z0-9]+') AS w FROM documents
            UNION ALL SELECT doc_id, 1, regexp_extract_all(lower(substring(text, length(text) // 2 + 1)), '[a-z0-9]+') FROM documents)),
        c AS (SELECT doc_id, gram, count(*) FILTER (WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) AS r FROM s GROUP BY ALL),
        f AS (SELECT doc_id, CASE WHEN sum(least(p, r)) > 0 THEN 2.0::DOUBLE * sum(least(p, r)) / (sum(p) + sum(r)) ELSE 0 END AS f FROM c GROUP BY ALL)
        SELECT round(sum(coalesce(f, 0)) / count(*), 9) AS rouge{n} FROM documents LEFT JOIN f USING (doc_id)"""


ORACLE_SQL = {
    "word_count": f"SELECT doc_id, len(regexp_extract_all(text, '{NS}+')) AS n FROM documents",
    "normalize_text": f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(nfc_normalize(text), '{BOILER}.*$', '', 'g'), '{S}+', ' ', 'g'))) AS digest FROM documents",
    "boilerplate_lines": f"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{BOILER}'))) AS n_boilerplate FROM documents",
    "min_words_50": f"SELECT count(*) AS n FROM documents WHERE len(regexp_extract_all(text, '{NS}+')) >= 50",
    "top_n_per_source": "SELECT source, doc_id, pos FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) WHERE pos <= 3",
    "dense_article_id": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS article_id FROM documents WHERE len(regexp_extract_all(text, '{NS}+')) >= 50",
    "sentence_counts": f"SELECT doc_id, len({SENTENCES}) AS n FROM documents",
    "numeric_tokens": f"SELECT doc_id, array_to_string({NUMERICS}, ' ') AS tokens FROM documents",
    "entities": f"SELECT doc_id, coalesce(array_to_string({NAMES}, '|'), '') AS names FROM documents",
    "unsupported_numbers": rf"""
        SELECT article_id, array_to_string(list_filter({NUMERICS}, lambda t: NOT (contains(src, t) OR ({COLLAPSED.format("t")} <> '' AND contains({COLLAPSED.format("src")}, {COLLAPSED.format("t")}))
            OR (len(regexp_extract_all(t, '[0-9]{{3,}}')) > 0 AND len(list_filter(regexp_extract_all(t, '[0-9]{{3,}}'), lambda g: NOT contains(src, g))) = 0))), ' ') AS missing FROM ({SUMMARY})""",
    "unsupported_entities": rf"""
        SELECT article_id, coalesce(array_to_string(list_filter({NAMES}, lambda t: NOT (contains(src, t) OR ({COLLAPSED.format("t")} <> '' AND contains({COLLAPSED.format("src")}, {COLLAPSED.format("t")}))
            OR len(list_filter(regexp_split_to_array(t, '{S}+'), lambda w: length(w) >= 4 AND contains(src, w))) > 0)), '|'), '') AS missing FROM ({SUMMARY})""",
    "qc_reasons": REASONS,
    "qc_pass_rate": f"SELECT count(*) AS total, count(*) FILTER (WHERE reasons = '') AS passed, count(*) FILTER (WHERE reasons <> '') AS failed FROM ({REASONS})",
    "ngram_weights": f"SELECT doc_id, count(*) AS grams, sum(weight)::BIGINT AS weight FROM ({GRAMS}) GROUP BY doc_id",
    "simhash64": PRINTS,
    "hamming_pairs": f"""
        WITH p AS (SELECT fp, min(doc_id) AS seq FROM ({PRINTS}) GROUP BY fp)
        SELECT a.seq AS earlier, b.seq AS later FROM p a JOIN p b ON a.seq < b.seq WHERE bit_count(xor(a.fp, b.fp)) <= 3""",
    "exact_dup_groups": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "prompt_render": f"SELECT doc_id, md5(p) AS digest, length(p) AS chars FROM (SELECT doc_id, {PROMPT} AS p FROM (SELECT *, {BODY} AS body FROM documents))",
    "near_dup_kept": f"""
        WITH RECURSIVE p AS (SELECT fp, min(doc_id) AS seq FROM ({PRINTS}) GROUP BY fp),
        o AS MATERIALIZED (SELECT fp, seq, row_number() OVER (ORDER BY seq) AS n FROM p),
        walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS seq UNION ALL
                 SELECT n, CASE WHEN near THEN kept ELSE list_append(kept, fp) END, CASE WHEN near THEN NULL ELSE seq END
                 FROM (SELECT o.n, o.fp, o.seq, w.kept, len(list_filter(w.kept, lambda k: bit_count(xor(k, o.fp)) <= 3)) > 0 AS near FROM walk w JOIN o ON o.n = w.n + 1))
        SELECT seq AS doc_id FROM walk WHERE seq IS NOT NULL""",
    "parse_label_json": """
        SELECT doc_id, md5(CASE WHEN bad THEN '' ELSE text END) AS summary, CASE WHEN bad THEN '' ELSE lang || ',' || source END AS names,
               CASE WHEN bad THEN 0::DOUBLE ELSE least(n_chars::DOUBLE / 2000, 1::DOUBLE) END AS confidence, CASE WHEN NOT bad AND doc_id % 5 = 0 THEN 'not news' END AS refusal, bad AS failed
        FROM (SELECT *, doc_id % 7 = 0 OR doc_id % 11 = 0 AS bad FROM documents)""",
    "call_labeler": rf"""
        SELECT doc_id AS article_id, md5(array_to_string(list_concat(w[:25], w[greatest(len(w) - 24, 1):]), ' ')) AS summary, 0.5::DOUBLE AS confidence, '{labeling.PROMPT_VERSION}' AS prompt_version
        FROM (SELECT doc_id, regexp_extract_all(body, '{NS}+') AS w FROM (SELECT doc_id, {BODY} AS body FROM documents))""",
    "rouge1": rouge_sql(1),
    "rouge2": rouge_sql(2),
}
