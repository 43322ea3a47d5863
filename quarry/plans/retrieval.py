"""Retrieval queries: every benchmark item against all documents and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import numeric, text
from quarry.operators import retrieval as R
from quarry.operators import segmentation
from quarry.operators.keyword_index import KeywordIndex
from quarry.operators.vector_index import VectorIndex
from quarry.plans import frames
from quarry.plans.frames import BM25_SQL, CHUNKS_SQL, COSINE_SQL, FUSED_SQL, quoted, sql_tokens
from quarry.plans.registry import query
from quarry.sources.store import Store
from quarry.sources.tables import read, shared_dir


def score6(c: str = "score"):
    return F.bround(c, 6).alias("score")


def flagship(spark, d):
    """Hybrid retrieval: BM25 and cosine, each 20 best, fused, visible to a member, the 8 best with evidence."""
    found = R.retrieve(frames.queries(spark, d), frames.chunks(spark, d), frames.vectors(spark, d))
    return found.select("query_id", "rank", "chunk_id", score6(), "document_name", "excerpt")


SHOWN = "shown AS (SELECT f.query_id, f.chunk_id, f.score, c.document_id, left(content, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END AS excerpt, row_number() OVER (PARTITION BY f.query_id ORDER BY round_even(f.score, 6) DESC, f.chunk_id) AS rank FROM fused f JOIN chunks c USING (chunk_id) WHERE visibility <> 'staff_only' QUALIFY rank <= 8)"
query("t03_hybrid_evidence", f"WITH {BM25_SQL}, {COSINE_SQL}, {FUSED_SQL}, {SHOWN} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score, left(document_id, 8) AS document_name, excerpt FROM shown")(flagship)


@query("f02_tokens", f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokens(spark, d):
    t = text.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query("f04_token_set", f"SELECT doc_id, len(list_distinct({sql_tokens('text')}))::INT AS n FROM documents")
def token_set(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.token_set(F.col("text"))).alias("n"))


@query("a16_corpus_stats", f"SELECT count(*)::BIGINT AS n, round_even(avg(len({sql_tokens('text')})), 6) AS mean_len FROM documents")
def corpus(spark, d):
    return R.corpus_stats(frames.chunks(spark, d)).select("n", F.bround("mean_len", 6).alias("mean_len"))


@query("a16_document_frequency", f"WITH {BM25_SQL} SELECT token, df::BIGINT AS df FROM df")
def document_frequency(spark, d):
    return R.postings(frames.chunks(spark, d)).groupBy("token").agg(F.count("*").alias("df"))


@query("s30_postings", f"WITH {BM25_SQL} SELECT chunk_id, token, tf::BIGINT AS tf, dl::INT AS doc_len FROM post")
def postings(spark, d):
    return R.postings(frames.chunks(spark, d)).select("chunk_id", "token", "tf", "doc_len")


@query("s31_keyword_query", f"SELECT item_id AS query_id, array_to_string({sql_tokens('text')}, ' & ') AS expression FROM benchmark")
def keyword_query(spark, d):
    return frames.queries(spark, d).select("query_id", F.array_join(text.tokens(F.col("query")), " & ").alias("expression"))


@query("s32_index_remove", f"WITH {BM25_SQL} SELECT p.token, count(*)::BIGINT AS df FROM post p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.chunk_id AND l.toxic = 1) GROUP BY p.token")
def index_remove(spark, d):
    gone = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return R.postings(frames.chunks(spark, d)).join(gone, "chunk_id", "left_anti").groupBy("token").agg(F.count("*").alias("df"))


@query("t02_bm25_topk", f"WITH {BM25_SQL} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score FROM words")
def bm25_top(spark, d):
    return R.bm25_top(frames.queries(spark, d), frames.chunks(spark, d), 20).select("query_id", "rank", "chunk_id", score6())


@query("t01_cosine_topk", f"WITH {COSINE_SQL} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score FROM near")
def cosine_top(spark, d):
    return R.top(R.cosine_top(frames.queries(spark, d), frames.vectors(spark, d), 20), 20).select("query_id", "rank", "chunk_id", score6())


@query("m01_cosine", "SELECT a.vec_id, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def cosine(spark, d):
    own = read(spark, d, "embeddings")
    one = own.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row against all
    return own.join(F.broadcast(one)).select("vec_id", F.bround(numeric.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))


@query("j10_rank_fusion", f"WITH {BM25_SQL}, {COSINE_SQL}, {FUSED_SQL} SELECT query_id, chunk_id, round_even(score, 9) AS score FROM fused")
def fusion(spark, d):
    q = frames.queries(spark, d)
    words = R.bm25_top(q, frames.chunks(spark, d), 20)
    return R.fuse(R.top(R.cosine_top(q, frames.vectors(spark, d), 20), 20), words).select("query_id", "chunk_id", F.bround("score", 9).alias("score"))


@query("p01_metadata_filter", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id FROM chunks WHERE (contains(document_id || ' > ' || lang, 'src1') OR contains(document_id || ' > ' || lang, 'fr')) AND (lang IS NULL OR lang IN ('en', 'fr')) AND (n_chars IS NULL OR (n_chars >= 500 AND n_chars <= 5000))")
def metadata_filter(spark, d):
    c = frames.chunks(spark, d).withColumns({"section_path": F.array("document_id", "lang"), "question_type": F.col("lang"), "year": F.col("n_chars")})
    f = R.Filters(chapters=["src1", "fr"], question_types=["en", "fr"], year_from=500, year_to=5000)
    return c.where(f.predicate(c.columns)).select("chunk_id", "document_id")


@query("p02_keyword_filter", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE contains(document_id, 'src1') AND document_id NOT IN ('src10', 'src11')")
def keyword_filter(spark, d):
    c = frames.chunks(spark, d).withColumn("section_path", F.array("document_id"))
    return c.where(R.Filters(chapters=["src1"]).predicate(c.columns) & ~F.col("document_id").isin("src10", "src11")).select("chunk_id")


@query("p03_visibility", f"WITH {CHUNKS_SQL} SELECT chunk_id, visibility FROM chunks WHERE visibility <> 'staff_only'")
def visibility(spark, d):
    return frames.chunks(spark, d).where(R.visible("member")).select("chunk_id", "visibility")


@query("p03_visibility_admin", f"WITH {CHUNKS_SQL} SELECT visibility, count(*)::BIGINT AS n FROM chunks GROUP BY visibility")
def visibility_admin(spark, d):
    return frames.chunks(spark, d).where(R.visible("admin")).groupBy("visibility").agg(F.count("*").alias("n"))


@query("p04_excerpt", f"WITH {CHUNKS_SQL} SELECT chunk_id, left(content, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END AS excerpt FROM chunks")
def excerpt(spark, d):
    return frames.chunks(spark, d).select("chunk_id", F.concat(F.left("content", F.lit(300)), F.when(F.length("content") > 300, "...").otherwise("")).alias("excerpt"))


@query("p05_term_search", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE contains(lower(content), 'license') OR contains(lower(content), 'apache') ORDER BY chunk_id LIMIT 8")
def term_search(spark, d):
    return R.term_search(frames.chunks(spark, d), "License, Apache").select("chunk_id")


_SCOPE = "(SELECT item_id AS query_id, b.text AS query, d.source AS document_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"
_PAGES_SQL = f"""WITH sc AS {_SCOPE}, qt AS (SELECT query_id, document_id, unnest(list_distinct({sql_tokens('query')})) AS token FROM sc),
pt AS (SELECT doc_id AS chunk_id, source AS document_id, unnest(list_distinct({sql_tokens('text')})) AS token FROM documents),
words AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank FROM qt JOIN pt USING (document_id, token) GROUP BY query_id, chunk_id QUALIFY rank <= 20),
near AS (SELECT query_id, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round_even(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, d.doc_id) AS rank
  FROM sc JOIN documents d ON d.source = sc.document_id JOIN embeddings v ON v.vec_id = d.doc_id JOIN embeddings e ON e.vec_id = sc.query_id QUALIFY rank <= 20),
{FUSED_SQL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 6) DESC, chunk_id)::INT AS rank FROM fused QUALIFY rank <= 5"""


@query("t04_page_search", _PAGES_SQL)
def page_search(spark, d):
    """Each benchmark item in the scope of the source of the document with its id."""
    chunks = frames.chunks(spark, d)
    cases = frames.queries(spark, d).join(chunks.select(F.col("chunk_id").alias("query_id"), F.array("document_id").alias("scope")), "query_id")
    return R.page_search(cases, chunks, frames.vectors(spark, d)).select("query_id", "chunk_id", "rank")


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"
_SUFFICIENT = f"""WITH {BM25_SQL}, {COSINE_SQL}, {FUSED_SQL}, {SHOWN},
sums AS (SELECT query_id, count(*) AS refs, count_if(NOT {_ANY('excerpt', R.STAFF)}) AS pub, max(score) AS best, bool_or(regexp_matches(excerpt, {quoted(R.NUMERIC)})) AS numbers,
  count_if({_ANY('excerpt', R.DENY)}) AS denials FROM shown GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN coalesce(refs, 0) = 0 THEN 'no_results' WHEN pub = 0 THEN 'staff_only' WHEN best < 0.02 THEN 'topic_mismatch'
  WHEN {_ANY('lower(text)', R.COMPUTE)} AND NOT numbers THEN 'missing_condition' ELSE 'sufficient' END AS reason FROM benchmark LEFT JOIN sums ON query_id = item_id"""


@query("p22_sufficiency", _SUFFICIENT)
def sufficiency(spark, d):
    q = frames.queries(spark, d)
    refs = R.retrieve(q, frames.chunks(spark, d), frames.vectors(spark, d))
    return R.sufficiency(q, refs, 0.02).select("query_id", "reason")


@query("x10_answer_or_refuse", _SUFFICIENT.replace("SELECT item_id AS query_id, CASE", "SELECT reason, count(*)::BIGINT AS n FROM (SELECT item_id AS query_id, CASE") + ") GROUP BY reason")
def answer_or_refuse(spark, d):
    """Retrieve, judge, and pick the refusal's text: how many queries end in each reason."""
    found = sufficiency(spark, d).withColumn("refusal", F.when(F.col("reason") != "sufficient", text.refusal(F.col("reason"))))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("j18_citations", "WITH a AS (SELECT doc_id, source, unnest(list_transform(generate_series(1, 3), lambda i: {'pos': i - 1, 'doc': 'src' || ((doc_id + i * i) % 6), 'page': i})) AS c FROM documents), r AS (SELECT DISTINCT source, (n_chars % 4)::INT AS page FROM documents) SELECT doc_id AS query_id, arg_min(c.doc, c.pos) AS bad_document, arg_min(c.page, c.pos)::INT AS bad_page FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = c.doc AND r.page = c.page AND r.source = a.source) GROUP BY doc_id")
def citations(spark, d):
    """Answers made of three citations each, against what a query's source holds."""
    docs = read(spark, d, "documents")
    cite = lambda i: F.format_string("[src%d, p. %d]", (F.col("doc_id") + i * i) % 6, F.lit(i))
    answers = docs.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", *[cite(i) for i in (1, 2, 3)]).alias("answer"))
    held = docs.select("source", (F.col("n_chars") % 4).cast("int").alias("page_number")).distinct()
    refs = docs.select(F.col("doc_id").alias("query_id"), "source").join(held, "source").select("query_id", F.col("source").alias("document_name"), "page_number")
    found = R.bad_citations(answers, refs)
    return found.select("query_id", F.col("first_bad.document_name").alias("bad_document"), F.col("first_bad.page_number").alias("bad_page"))


@query("j17_labels", "SELECT doc_id, 'chunk-' || doc_id || ',REF_9' AS used FROM documents")
def labels(spark, d):
    known = F.create_map(F.lit("REF_1"), F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")))
    return read(spark, d, "documents").select("doc_id", F.array_join(R.relabelled(F.array(F.lit("REF_1"), F.lit("REF_9")), known), ",").alias("used"))


@query("u05_unique_terms", f"SELECT item_id AS query_id, len(list_distinct({sql_tokens('text')}[1:1000000]))::INT AS n_all, least(20, len(list_distinct({sql_tokens('text')})))::INT AS n_kept FROM benchmark")
def unique_terms(spark, d):
    t = text.token_set(F.col("query"))
    return frames.queries(spark, d).select("query_id", F.size(t).alias("n_all"), F.size(F.slice(t, 1, 20)).alias("n_kept"))


@query("f34_cache_key", "SELECT item_id, md5(lower(text) || '|member') AS cache_key FROM benchmark")
def cache_key(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.cache_key(F.col("text"), F.lit("member")).alias("cache_key"))


def changed_index(spark, d):
    """An index of all chunks that came about by changes: texts of two languages are wrong at first and replaced, others removed and added again."""
    index, all_ = KeywordIndex(Store(spark, f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}")), frames.chunks(spark, d)
    wrong = F.col("lang").isin("fr", "de")
    index.add(all_.withColumn("content", F.when(wrong, F.concat_ws(" ", F.reverse("content"), F.lit("license license"))).otherwise(F.col("content"))))
    index.remove(all_.where("lang = 'es'"))
    index.add(all_.where(wrong | (F.col("lang") == "es")))
    return index


@query("x02_indexed_topk", f"WITH {BM25_SQL} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score FROM words")
def indexed_top(spark, d):
    """The rows of t02_bm25_topk, from an index with replaced and removed chunks."""
    return changed_index(spark, d).search(frames.queries(spark, d), 20).select("query_id", "rank", "chunk_id", score6())


_PUBLIC_SQL = CHUNKS_SQL.replace("LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id", "LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id WHERE l.toxic IS NULL")


@query("s32_incremental_index", f"WITH {BM25_SQL.replace(CHUNKS_SQL, _PUBLIC_SQL)} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score FROM words")
def incremental_index(spark, d):
    """The same after chunks that only staff may see are removed and the segments compacted."""
    index = changed_index(spark, d)
    index.remove(frames.chunks(spark, d).where("visibility = 'staff_only'"))
    index.compact()
    return index.search(frames.queries(spark, d), 20).select("query_id", "rank", "chunk_id", score6())


#: Letters of the documents' languages, and an ideograph for each, so that their texts without spaces are runs as in Chinese.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëíìîïñóòôöõœúùûüýÿß"
_IDEOGRAPHS = "".join(chr(0x4E8C + 97 * i) for i in range(len(_LETTERS)))


def in_ideographs(df, column, spaced):
    """The column's texts letter by letter in ideographs, with or without spaces between words."""
    own = F.translate(F.lower(column), _LETTERS, _IDEOGRAPHS)
    return df.withColumn(column, own if spaced else F.regexp_replace(own, "(?<=[一-鿿]) (?=[一-鿿])", ""))


def fitted_words(spark, chunks):
    found = in_ideographs(chunks, "content", True).select(F.explode_outer(F.regexp_extract_all("content", F.lit("([一-鿿]+)"), F.lit(1))).alias("word"))  # rows without a word are no ideographs
    return segmentation.word_splitter(segmentation.fit(found), spark)


@query("f01_segments")
def segments(spark, d):
    """Words found in texts without spaces, against the words that are there; no SQL finds a best path over a dictionary."""
    chunks = frames.chunks(spark, d)
    found = in_ideographs(chunks, "content", False).select("chunk_id", fitted_words(spark, chunks)(F.col("content")).alias("t"))
    there = in_ideographs(chunks, "content", True).select("chunk_id", F.size(text.words(F.col("content"))).alias("n_words"))
    return there.join(found.select("chunk_id", F.size("t").alias("n_found"), F.md5(F.array_join("t", " ").cast("binary")).alias("found_md5")), "chunk_id")


@query("f01_keyword_recall")
def keyword_recall(spark, d):
    """Of the 20 best chunks of each query when words are known, how many are found without spaces, with runs as tokens and with segmented runs."""
    chunks, queries = frames.chunks(spark, d).select("chunk_id", "content"), frames.queries(spark, d).select("query_id", "query")
    best = lambda spaced, **how: R.bm25_top(in_ideographs(queries, "query", spaced), in_ideographs(chunks, "content", spaced), 20, **how).select("query_id", "chunk_id")
    want = best(True).withColumn("wanted", F.lit(1))
    runs, words = best(False).withColumn("by_run", F.lit(1)), best(False, words=fitted_words(spark, chunks)).withColumn("by_word", F.lit(1))
    found = want.join(runs, ["query_id", "chunk_id"], "left").join(words, ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("wanted", "by_run", "by_word")])


def changed_vectors(spark, d):
    """An index of all vectors of chunks that came about by changes: some vectors are wrong at first and replaced, others removed and added again."""
    index, all_ = VectorIndex(Store(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")), frames.vectors(spark, d)
    wrong, late = F.pmod("chunk_id", F.lit(3)) == 1, F.pmod("chunk_id", F.lit(5)) == 2
    index.add(all_.withColumn("embedding", F.when(wrong, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.remove(all_.where(late))
    index.add(all_.where(wrong | late))
    index.compact()
    return index


@query("x01_exact_topk", f"WITH {COSINE_SQL} SELECT query_id, rank::INT AS rank, chunk_id, round_even(score, 6) AS score FROM near")
def exact_top(spark, d):
    """The rows of t01_cosine_topk, from an index with replaced and removed vectors."""
    return changed_vectors(spark, d).search(frames.queries(spark, d), 20, probes=None).select("query_id", "rank", "chunk_id", score6())


@query("x01_recall")
def recall(spark, d):
    """Of the 20 nearest of each query, how many a search of the nearest cells finds; held against its exact mode, so without SQL."""
    index, queries = changed_vectors(spark, d), frames.queries(spark, d)
    want = index.search(queries, 20, probes=None).select("query_id", "chunk_id", F.lit(1).alias("wanted"))
    near = index.search(queries, 20).select("query_id", "chunk_id", F.lit(1).alias("found"))
    found = want.join(near, ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg(F.sum("wanted").alias("n_wanted"), F.coalesce(F.sum("found"), F.lit(0)).alias("n_found"))
