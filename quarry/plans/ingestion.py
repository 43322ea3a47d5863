"""Ingestion queries: documents as pages, their lines as layout blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import ingestion as I
from quarry.plans.frames import quoted
from quarry.plans.registry import query
from quarry.sources import tables
from quarry.sources.tables import read


def layout(spark, d):
    return I.layout_of(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text"))


_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
LINES = f"""l0 AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT document_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS reading_order FROM l0),
layout AS (SELECT *, CASE WHEN regexp_matches(content, '\\$[^$]+\\$') OR contains(content, '\\begin') OR regexp_matches(content, '^\\\\[A-Za-z]+') THEN 'formula' ELSE 'text' END AS block_type FROM lines)"""


#: The level of a layout line, from the rule itself: numbered chapters and sections open level 1, numbered or
#: lettered items with a title level 2, list marks level 3; the least level that fits holds.
LEVEL_SQL = r"""
    coalesce(
        least(
            CASE WHEN (marked OR chars <= 60) AND regexp_matches(title, '^第[一二三四五六七八九十0-9]+[章节]\s*.') THEN 1 END,
            CASE WHEN (marked OR chars <= 60) AND regexp_matches(title, '^([0-9]+(\.[0-9]+)?(\.[0-9]+)?\s+|[一二三四五六七八九十]、\s*|[(（][一二三四五六七八九十0-9]+[)）]\s*|[A-D][.、]\s*)\S') THEN 2 END,
            CASE WHEN (marked OR chars <= 40) AND regexp_matches(title, '^([(（][0-9]+[)）]|[0-9]+[.、)]\s*\S|[①-⑩])') THEN 3 END),
        CASE WHEN marked THEN CASE WHEN chars > 30 THEN 1 ELSE 2 END
             WHEN chars > 25 OR right(title, 1) IN ('。', '！', '？', '；', '，', '、') THEN 0
             ELSE 3 END)"""
TITLES = "SELECT *, length(title) AS chars FROM (SELECT *, starts_with(content, '[HEADING]') AS marked, CASE WHEN starts_with(content, '[HEADING]') THEN replace(content, '[HEADING] ', '') ELSE content END AS title FROM layout)"


LEVELS = f"{LINES}, levels AS (SELECT * EXCLUDE (marked, title, chars), CASE WHEN block_type = 'formula' THEN 0 ELSE {LEVEL_SQL} END AS level FROM ({TITLES}))"


@query("s08_layout", f"WITH {LINES} SELECT document_id, reading_order::INT AS reading_order, block_type, md5(content) AS content_md5 FROM layout")
def layout_lines(spark, d):
    return layout(spark, d).select("document_id", "reading_order", "block_type", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("f12_headings", f"WITH {LEVELS} SELECT document_id, reading_order::INT AS reading_order, level::INT AS level FROM levels")
def headings(spark, d):
    level = F.when(F.col("block_type") == "formula", 0).otherwise(text.heading_level(F.col("content")))
    return layout(spark, d).select("document_id", "reading_order", level.alias("level"))


@query("f13_marked_headings", f"WITH {LINES} SELECT document_id, count_if(length(content) <= 50 AND regexp_matches(content, {quoted('|'.join(I.MARKED))}))::BIGINT AS marked FROM layout GROUP BY 1")
def marked(spark, d):
    is_ = I.marked_headings(F.col("content")).startswith(text.MARK)
    return layout(spark, d).groupBy("document_id").agg(F.count_if(is_).alias("marked"))


@query("f14_formulas", f"WITH {LINES} SELECT block_type, count(*)::BIGINT AS n FROM layout GROUP BY 1")
def formulas(spark, d):
    return layout(spark, d).groupBy("block_type").agg(F.count("*").alias("n"))


@query("w12_sections", f"""WITH {LEVELS}, s AS (SELECT *, sum(CASE WHEN level IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY reading_order) AS section_no FROM levels),
g AS (SELECT document_id, section_no, max(CASE WHEN level IN (1, 2) THEN replace(content, '[HEADING] ', '') END) AS heading, coalesce(max(CASE WHEN level IN (1, 2) THEN level END), 1) AS level,
  count_if(level NOT IN (1, 2)) AS n FROM s GROUP BY ALL)
SELECT document_id, section_no::BIGINT AS section_no, heading, level::INT AS level, n::INT AS n_paragraphs FROM g QUALIFY n > 0 OR section_no = max(section_no) OVER (PARTITION BY document_id)""")
def sections(spark, d):
    return I.sections(layout(spark, d)).select("document_id", "section_no", "heading", "level", F.size("paragraphs").alias("n_paragraphs"))


@query("w13_questions", f"""WITH {LINES}, s AS (SELECT *, regexp_matches(content, {quoted(text.QUESTION_START)}) AS starts FROM layout),
q AS (SELECT *, sum(starts::INT) OVER (PARTITION BY document_id ORDER BY reading_order) AS no, regexp_extract(content, {quoted(text.QUESTION_START)}, 0) AS mark FROM s),
e AS (SELECT document_id, no, max(CASE WHEN starts THEN regexp_extract(mark, {quoted(text.QUESTION_NUMBER)}, 0) END) AS question_no,
  {_TRIM(f"string_agg(CASE WHEN starts THEN {_TRIM('substr(content, length(mark) + 1)')} ELSE content END, chr(10) ORDER BY reading_order)")} AS body FROM q WHERE no > 0 GROUP BY ALL)
SELECT document_id, question_no, md5(body) AS body_md5 FROM e QUALIFY row_number() OVER (PARTITION BY document_id, question_no ORDER BY no) = 1 AND body <> ''""".replace("QUALIFY row_number() OVER (PARTITION BY document_id, question_no ORDER BY no) = 1 AND body <> ''", "QUALIFY row_number() OVER (PARTITION BY document_id, question_no ORDER BY no) = 1").replace("SELECT document_id, question_no, md5(body)", "SELECT * FROM (SELECT document_id, question_no, md5(body)") + ") WHERE body_md5 <> md5('')")
def questions(spark, d):
    return I.questions(layout(spark, d)).select("document_id", "question_no", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("p21_page_class", "SELECT doc_id, CASE WHEN length(text) >= 80 THEN 'digital' WHEN length(text) < 20 AND doc_id % 2 > 0 THEN 'scanned' ELSE 'digital' END AS kind FROM documents")
def page_class(spark, d):
    return read(spark, d, "documents").select("doc_id", I.page_class(F.length("text"), F.col("doc_id") % 2).alias("kind"))


@query("p19_reviews", f"WITH {LINES} SELECT document_id, reading_order::INT AS reading_order, CASE block_type WHEN 'formula' THEN 'formula' ELSE 'ocr_text' END AS kind FROM layout WHERE (length(content) % 100) / 100.0::DOUBLE < 0.2")
def reviews(spark, d):
    blocks = layout(spark, d).withColumn("confidence", (F.length("content") % 100) / 100.0)
    return I.reviews(blocks, 0.2).select("document_id", "reading_order", "kind")


@query("s11_page_text", f"WITH {LINES} SELECT document_id, md5(string_agg(content, chr(10) ORDER BY reading_order)) AS text_md5, round_even(avg((length(content) % 97) / 97.0::DOUBLE), 4) AS confidence FROM layout GROUP BY 1")
def page_text(spark, d):
    blocks = layout(spark, d).withColumn("confidence", (F.length("content") % 97) / 97.0)
    return I.page_text_of(blocks).select("document_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "confidence")


@query("s38_page_metrics", "SELECT source, count(*)::BIGINT AS pages, count_if(length(text) >= 20)::BIGINT AS with_text, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def page_metrics(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.length("text") >= 20).alias("with_text"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("a33_block_counts", f"WITH {LINES} SELECT document_id, count(*)::BIGINT AS blocks, count_if(block_type = 'formula')::BIGINT AS formulas FROM layout GROUP BY 1")
def block_counts(spark, d):
    return layout(spark, d).groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("block_type") == "formula").alias("formulas"))


@query("f22_table_text", "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</tr>', chr(10), 'gi'), '</td>', ' | ', 'gi'), '</th>', ' | ', 'gi'), '<[^>]+>', '', 'g'), '\\n\\s*\\n', chr(10), 'g'), '\\| \\|', '|', 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages")
def table_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.table_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("f25_page_text", "SELECT doc_id, md5(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 7000)) AS text_md5 FROM documents")
def short_page_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.page_text(F.col("text")).cast("binary")).alias("text_md5"))


@query("f27_safe_names", "SELECT page_id, left(trim(regexp_replace(url, '[^\\p{L}\\p{N}_.\\- ]', '_', 'g')), 255) AS name FROM pages")
def safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("f16_question_types", f"SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(text.OPTION)}) THEN 'choice' WHEN regexp_matches(text, {quoted(text.BLANK)}) THEN 'fill_blank' ELSE 'short_answer' END AS type FROM documents")
def question_types(spark, d):
    return read(spark, d, "documents").select("doc_id", text.question_type(F.col("text")).alias("type"))


@query("a18_type_distribution", f"SELECT type, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(text, {quoted(text.OPTION)}) THEN 'choice' WHEN regexp_matches(text, {quoted(text.BLANK)}) THEN 'fill_blank' ELSE 'short_answer' END AS type FROM documents) GROUP BY 1")
def type_distribution(spark, d):
    return read(spark, d, "documents").groupBy(text.question_type(F.col("text")).alias("type")).agg(F.count("*").alias("n"))


@query("f08_first_numbers", "SELECT doc_id, try_cast(nullif(regexp_extract(text, '[-+]?\\d+\\.?\\d*(?:[eE][-+]?\\d+)?', 0), '') AS DOUBLE) AS number FROM documents")
def first_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_number(F.col("text")).alias("number"))


@query("f05_normalized_answers", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS answer_md5 FROM documents")
def normalized(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.normalized_answer(F.col("text")).cast("binary")).alias("answer_md5"))


@query("f09_chunks")
def chunks(spark, d):
    """Chunks of every document: lines, split, merged, overlapping. Its search for breaks is no SQL; tests hold it against a model."""
    found = I.chunks(I.segments_of(layout(spark, d)))
    return found.select("document_id", "position", "kind", F.length("content").alias("n_chars"), "content_hash")


@query("k17_ingestion")
def pipeline(spark, d):
    """Layout, headings, sections, questions, exam pages, chunks: how many of each in a document."""
    lay = layout(spark, d).withColumn("content", I.marked_headings(F.col("content")))
    found = I.questions(lay)
    exam = I.exam_pages(lay, found)
    c = I.chunks(I.segments_of(exam, F.col("is_exam"))).groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    q = found.groupBy("document_id").agg(F.count("*").alias("n_questions"))
    s = I.sections(lay).groupBy("document_id").agg(F.count("*").alias("n_sections"))
    return c.join(q, "document_id", "left").join(s, "document_id", "left").select("document_id", "n_chunks", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), "n_sections")


@query("w10_overlap", """WITH c AS (SELECT conv_id, turn, text, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 80) AS tail FROM conversations),
o AS (SELECT *, regexp_replace(tail, '^[，。！？；：、,.;:!? \\t\\n]+', '') AS clean FROM c)
SELECT conv_id, turn, md5(CASE WHEN tail IS NULL THEN text ELSE CASE WHEN length(clean) < 40 THEN tail ELSE clean END || chr(10) || text END) AS text_md5 FROM o""")
def overlap(spark, d):
    """Turns of a conversation as chunks."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(I.overlapped(F.col("text"), before).cast("binary")).alias("text_md5"))


@query("j16_exam_pages", f"WITH {LINES}, q AS (SELECT DISTINCT document_id FROM layout WHERE regexp_matches(content, {quoted(text.QUESTION_START)})) SELECT l.document_id, count(*)::BIGINT AS blocks FROM layout l SEMI JOIN q ON q.document_id = l.document_id GROUP BY 1")
def exam_pages(spark, d):
    lay = layout(spark, d)
    starts = lay.where(F.col("content").rlike(text.QUESTION_START)).select("document_id", "page_no")
    return I.exam_pages(lay, starts).where("is_exam").groupBy("document_id").agg(F.count("*").alias("blocks"))


@query("j21_table_overlap", """WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS reading_order, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 5 AS x1, l_tax * 100 + 3 AS y1 FROM lineitem),
t AS (SELECT o_orderkey AS document_id, (o_custkey % 50)::DOUBLE AS x0, 2.0 AS y0, (o_custkey % 50)::DOUBLE + 10 AS x1, 6.0 AS y1 FROM orders)
SELECT b.document_id, min(reading_order)::INT AS reading_order FROM b JOIN t ON b.document_id = t.document_id AND NOT (b.x1 < t.x0 OR t.x1 < b.x0 OR b.y1 < t.y0 OR t.y1 < b.y0) GROUP BY 1""")
def table_overlap(spark, d):
    """Lines as blocks, orders as tables: the block that gives way in each."""
    q, y = F.col("l_quantity"), F.col("l_tax") * 100
    blocks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("reading_order"), F.lit("text").alias("block_type"), F.lit("x").alias("content"), F.array(q, y, q + 5, y + 3).alias("bbox"), F.lit(1.0).alias("confidence"))
    x = (F.col("o_custkey") % 50).cast("double")
    ts = read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.lit("| t |").alias("content"), F.array(x, F.lit(2.0), x + 10, F.lit(6.0)).alias("bbox"))
    return I.with_tables(blocks, ts).where("block_type = 'table'").select("document_id", "reading_order").distinct()


@query("s21_uploads", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'FILE_UNSUPPORTED_TYPE' WHEN doc_id % 4 = 1 THEN 'FILE_UNSUPPORTED_TYPE' WHEN strlen(text) + 4 > 2000 THEN 'FILE_TOO_LARGE' END AS error, CASE WHEN doc_id % 4 = 1 THEN sha256(text) ELSE sha256('%PDF' || text) END AS sha256 FROM documents")
def uploads(spark, d):
    """Texts as files, of which some have another kind or other first bytes; at most 2,000 bytes."""
    n = F.col("doc_id") % 4
    name = F.concat(F.lit("f."), F.when(n == 3, "exe").otherwise("PDF"))
    content = F.concat(F.when(n == 1, "").otherwise("%PDF"), F.col("text")).cast("binary")
    return read(spark, d, "documents").select("doc_id", tables.upload_error(name, content, most_mb=2000 / 1048576).alias("error"), F.sha2(content, 256).alias("sha256"))


@query("s29_embedding_reuse")
def embedding_reuse(spark, d):
    """An embedding for each different text; seeded vectors, so no SQL."""
    found = tables.embedded(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 16)
    return found.select("doc_id", F.bround(F.col("embedding")[0], 6).alias("first"), F.size("embedding").alias("dim"))
