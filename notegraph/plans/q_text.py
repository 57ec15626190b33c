"""Queries of discovery, parsing, segmentation and claim annotation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegraph.functions import blocks as B
from notegraph.functions import lexicon as L
from notegraph.functions import text as T
from notegraph.operators import claims as C
from notegraph.operators.records import distinct_claims
from notegraph.plans import sql
from notegraph.plans.registry import query
from notegraph.session import table

W = T.BLANK.replace("\\", "\\")
EVENTS = "(SELECT DISTINCT * FROM scanner_events)"


def docs(spark, d):
    return table(spark, d, "documents")


def events(spark, d):
    return table(spark, d, "scanner_events").distinct()


@query("s03_file_filter", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 20000 THEN 'too_large' END AS reason FROM documents) GROUP BY 1")
def s03(spark, d):
    reason = F.when(F.col("text").isNull(), "missing").when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") > 20000, "too_large")
    return docs(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("s05_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def s05(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("s06_exact_duplicates", "SELECT doc_key, first_value(doc_key) OVER (PARTITION BY sha256(text) ORDER BY doc_key) AS canonical_key, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_key) = 1 AS is_canonical FROM documents WHERE text IS NOT NULL")
def s06(spark, d):
    from notegraph.sources.files import duplicates

    return duplicates(docs(spark, d).where("text is not null").select("doc_key", F.sha2("text", 256).alias("hash")), "doc_key")


@query("s07_changed", "SELECT doc_key FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND ingested_at < TIMESTAMP '2024-07-01 00:00:00')")
def s07(spark, d):
    now = docs(spark, d).where("text is not null").select("doc_key", F.sha2("text", 256).alias("hash"), "ingested_at")
    before = now.where("ingested_at < timestamp_ntz'2024-07-01 00:00:00'").select("hash").distinct()
    return now.join(before, "hash", "left_anti").select("doc_key")


NORMAL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '^﻿', ''), '\\r\\n?', chr(10), 'g'), '(?m){W}+$', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\A(?:{W}*\\n)+|(?:\\n{W}*)+\\z', '', 'g')"


@query("n01_normalized", f"SELECT doc_id, sha256({NORMAL}) AS hash, length({NORMAL}) AS n FROM documents")
def n01(spark, d):
    out = T.normalize(docs(spark, d).select("doc_id", "text"))
    return out.select("doc_id", F.sha2("normalized_text", 256).alias("hash"), F.length("normalized_text").cast("bigint").alias("n"))


@query("n09_provenance", "SELECT doc_id, CASE WHEN s <> '' THEN trim(s) END AS source_line, CAST(CASE WHEN f <> '' THEN f END AS DATE) AS published FROM (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?m)^\\*\\*Source:\\*\\*[ \\t]*([^\\n]+)', 1) AS s, regexp_extract(coalesce(text, ''), '\\A---\\ndate: (\\d{4}-\\d\\d-\\d\\d)\\n---', 1) AS f FROM documents)")
def n09(spark, d):
    p = T.provenance(F.col("text"))
    return docs(spark, d).select("doc_id", T.source_line(F.col("text")).alias("source_line"), p["publication_date"].cast("date").alias("published"))


@query("a07_text_statistics", f"SELECT doc_id, length(t) AS character_count, len(regexp_extract_all(t, '[^ \\t\\x0B\\f\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\n\\r]+')) AS word_count, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS line_count, CASE WHEN t = '' THEN 0 ELSE length(k) - length(replace(k, 'b', '')) END AS blank_line_count, len(regexp_extract_all(k, 'x+')) AS paragraph_count FROM (SELECT doc_id, t, CASE WHEN t = '' THEN '' ELSE array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^(?:{W}|\\r)*$') THEN 'b' ELSE 'x' END), '') END AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def a07(spark, d):
    return docs(spark, d).select("doc_id", *[c.alias(n) for n, c in T.statistics(F.col("text")).items()])


@query("x01_blocks")
def x01(spark, d):
    return B.block_table(docs(spark, d)).groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.count_distinct("doc_id").alias("n_documents"))


@query("x02_block_prose", f"SELECT event_id, CASE WHEN t = '' OR regexp_matches(t, '[.?!]$') THEN t ELSE t || '.' END AS prose FROM (SELECT event_id, trim(text) AS t FROM {EVENTS} WHERE block_type IN ('bullet_item', 'ordered_item', 'block_quote') AND text IS NOT NULL)")
def x02(spark, d):
    t = F.trim("text")
    rows = events(spark, d).where(F.col("block_type").isin("bullet_item", "ordered_item", "block_quote") & F.col("text").isNotNull())
    return rows.select("event_id", F.when((t == "") | t.rlike("[.?!]$"), t).otherwise(F.concat(t, F.lit("."))).alias("prose"))


def _levels(expr):
    return ", ".join(expr.format(k=k) for k in range(1, 7))


HEAD = "(block_type = 'heading' AND coalesce(regexp_matches(text, '[\\pL\\pN]'), false) AND heading_level = {k})"
FRAME = "OVER (PARTITION BY doc_id ORDER BY event_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("x03_heading_context", f"""SELECT event_id, concat_ws(' > ', CASE WHEN p1 > -1 THEN t1 END, {', '.join(f"CASE WHEN p{k} > greatest({', '.join(f'coalesce(p{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(2, 7))}) AS context FROM (SELECT event_id, {_levels("max(CASE WHEN " + HEAD + " THEN event_no END) " + FRAME + " AS p{k}")}, {_levels("last_value(CASE WHEN " + HEAD + " THEN trim(text) END IGNORE NULLS) " + FRAME + " AS t{k}")} FROM {EVENTS})""")
def x03(spark, d):
    return B.contexts(events(spark, d)).select("event_id", "context")


@query("x04_rule_sentences")
def x04(spark, d):
    return B.sentences(B.block_table(docs(spark, d))).select("doc_id", "position", "sentence_id", "text", "char_start", "context")


@query("x06_sentence_ids", f"SELECT event_id, left(sha256(concat_ws(':', CAST(doc_id AS VARCHAR), text, CAST(char_start AS VARCHAR))), 16) AS sentence_id FROM {EVENTS} WHERE block_type = 'paragraph'")
def x06(spark, d):
    return events(spark, d).where("block_type = 'paragraph'").select("event_id", T.short_id(F.col("doc_id"), F.col("text"), F.col("char_start")).alias("sentence_id"))


_SENT = f"(SELECT CAST(doc_id AS VARCHAR) AS document_id, left(sha256(coalesce(text, '')), 16) AS sentence_id, event_no AS position, text, coalesce(char_start, 0) AS char_start, coalesce(char_end, 0) AS char_end, event_id FROM {EVENTS})"


@query("x07_sentence_problems", f"""SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN times > 1 THEN 'duplicate_id' END, CASE WHEN char_start >= char_end AND char_end > 0 THEN 'bad_offsets' END]) AS problem FROM (SELECT *, count(*) OVER (PARTITION BY document_id, sentence_id) AS times FROM {_SENT})) WHERE problem IS NOT NULL GROUP BY 1""")
def x07(spark, d):
    e = events(spark, d).select(
        F.col("doc_id").cast("string").alias("document_id"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("sentence_id"), F.col("event_no").alias("position"), "text",
        F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"),
    )
    # rows without offsets have no order among themselves
    return B.sentence_problems(e).where("problem != 'position_order'").groupBy("problem").agg(F.count("*").alias("n"))


@query("a08_block_counts", f"SELECT block_type, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM {EVENTS} GROUP BY 1")
def a08(spark, d):
    return events(spark, d).groupBy("block_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))


GATE = """CASE WHEN t = '' THEN 'empty' WHEN block_type = 'table' THEN 'table' WHEN block_type = 'code_block' THEN 'code_block' WHEN block_type = 'block_quote' THEN 'block_quote' WHEN regexp_matches(t, '^\\*\\*[^*\\n]+:\\*\\*\\s*\\S') THEN 'metadata'
 WHEN regexp_matches(t, '^#{1,6}\\s+\\S') OR regexp_matches(t, '^\\*\\*[^*:\\n]+\\*\\*[.\\s]*$') THEN 'heading' WHEN regexp_matches(t, '\\?["'')\\]]*$') THEN 'question'
 WHEN regexp_matches(t, '^[A-Z][A-Za-z0-9-]*( ([A-Z][A-Za-z0-9-]*|of|and|the|for|in|on|to|a)){0,7}$') THEN 'heading' ELSE 'declarative_assertion' END"""


@query("c02_assertion_gate", f"SELECT event_id, {GATE} AS assertion_type FROM (SELECT event_id, block_type, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {EVENTS})")
def c02(spark, d):
    return events(spark, d).select("event_id", T.assertion_type(F.col("text"), F.col("block_type")).alias("assertion_type"))


def has(words):
    items = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"list_has_any(w, [{items}])"


WORDS = f"(SELECT *, list_filter(string_split_regex(lower(coalesce(claim_text, '')), '(?:{W}|[\\n\\r])+'), lambda x: x <> '') AS w FROM {sql.CLAIMS})"


@query("c06_annotations", f"""SELECT claim_id, {has(L.NEGATION_MARKERS)} AS negated, CASE WHEN {has(L.MODALITY['impossible'])} THEN 'impossible' WHEN {has(L.MODALITY['required'])} THEN 'required' WHEN {has(L.MODALITY['probable'])} THEN 'probable' WHEN {has(L.MODALITY['possible'])} THEN 'possible' ELSE 'certain' END AS modal, {has(L.CONDITIONAL_MARKERS)} AS conditional, {has(L.COMPARISON_MARKERS)} AS comparative, coalesce(regexp_matches(claim_text, '["'']'), false) AS quoted FROM {WORDS}""")
def c06(spark, d):
    t = F.col("claim_text")
    return distinct_claims(table(spark, d, "claims")).select("claim_id", L.is_negated(t).alias("negated"), L.modality(t).alias("modal"), L.is_conditional(t).alias("conditional"), L.is_comparative(t).alias("comparative"), L.is_quoted(t).alias("quoted"))


def sentences_of(spark, d):
    """Blocks as sentences of their own, which is what their claims are without a parser."""
    e = events(spark, d)
    return e.select(F.concat_ws(":", "doc_id", "event_no", "event_id").alias("sentence_id"), F.col("doc_id").cast("string").alias("document_id"), "text", F.col("block_type").alias("origin_block_type"))


_CLAIMED = f"(SELECT sid, text, kind, left(sha256(sid || ':' || text || ':0'), 16) AS claim_id FROM (SELECT concat_ws(':', doc_id, event_no, event_id) AS sid, text, {GATE} AS kind FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {EVENTS})))"


@query("c11_claims", f"SELECT DISTINCT sid AS sentence_id, claim_id, CASE WHEN kind <> 'declarative_assertion' THEN kind END AS discarded_as, CASE WHEN kind = 'declarative_assertion' THEN 'whole_sentence' END AS extraction_mode, CASE WHEN kind = 'declarative_assertion' THEN left(sha256(text), 16) END AS content_hash FROM (SELECT * REPLACE (CASE WHEN kind = 'declarative_assertion' THEN claim_id END AS claim_id) FROM {_CLAIMED})")
def c11(spark, d):
    return C.extract(sentences_of(spark, d)).select("sentence_id", "claim_id", "discarded_as", "extraction_mode", "content_hash")


@query("a09_extraction_counts", f"""SELECT * FROM (SELECT 'mode:whole_sentence' AS kind, count(*) AS n FROM (SELECT DISTINCT sid, text FROM {_CLAIMED} WHERE kind = 'declarative_assertion') UNION ALL SELECT 'discarded:' || kind, count(*) FROM {_CLAIMED} WHERE kind <> 'declarative_assertion' GROUP BY 1
 UNION ALL SELECT 'negated', count(*) FILTER (WHERE {has(L.NEGATION_MARKERS)}) FROM (SELECT list_filter(string_split_regex(lower(text), '(?:{W}|[\n\r])+'), lambda x: x <> '') AS w FROM {_CLAIMED} WHERE kind = 'declarative_assertion')
 UNION ALL SELECT 'modal', count(*) FILTER (WHERE {has(sum(L.MODALITY.values(), ()))}) FROM (SELECT list_filter(string_split_regex(lower(text), '(?:{W}|[\n\r])+'), lambda x: x <> '') AS w FROM {_CLAIMED} WHERE kind = 'declarative_assertion')
 UNION ALL SELECT 'attributed', 0 UNION ALL SELECT 'failed', 0)""")
def a09e(spark, d):
    return C.counts(C.extract(sentences_of(spark, d)))


@query("c09_content_hash", "SELECT DISTINCT claim_id, content_hash = left(sha256(text), 16) AS matches FROM claims")
def c09(spark, d):
    return table(spark, d, "claims").select("claim_id", (F.col("content_hash") == F.substring(F.sha2("text", 256), 1, 16)).alias("matches")).distinct()


@query("c10_claim_problems", """SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN claim_id IS NULL THEN 'no_id' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN document_id IS NULL OR document_id NOT IN (SELECT doc_key FROM documents) THEN 'unknown_document' END,
 CASE WHEN count(*) OVER (PARTITION BY claim_id) > 1 THEN 'repeated_id' END, CASE WHEN context IS NULL THEN 'no_context' END]) AS problem FROM claims) WHERE problem IS NOT NULL GROUP BY 1""")
def c10(spark, d):
    return C.problems(table(spark, d, "claims"), docs(spark, d).select(F.col("doc_key").alias("document_id"))).groupBy("problem").agg(F.count("*").alias("n"))


@query("a09_claim_counts", f"SELECT extraction_mode, count(*) AS n, count(*) FILTER (WHERE is_negated) AS n_negated, count(*) FILTER (WHERE modality <> 'certain') AS n_modal FROM {sql.CLAIMS} GROUP BY 1")
def a09(spark, d):
    return distinct_claims(table(spark, d, "claims")).groupBy("extraction_mode").agg(F.count("*").alias("n"), F.count_if("is_negated").alias("n_negated"), F.count_if(F.col("modality") != "certain").alias("n_modal"))


@query("r14_naive_extraction")
def r14(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.naive_sentences(F.col("text"))).alias("n", "sentence"))
