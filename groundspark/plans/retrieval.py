"""Retrieval queries: documents stand for sections, benchmark items for questions; embeddings are a vector index of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import STOP, stem_sql
from ..operators import index as I
from ..operators import retrieval as R
from ..operators import scoring
from ..operators import vectors as V
from ..sources import sinks
from ..sources.tables import broadcast_if_small, table


def header(s: SparkSession, d: str) -> DataFrame:
    """doc_id, lang and the text that is searched: a header of its source, language and number, and the document."""
    fields = [("Drug", F.nullif("source", F.lit("src0")), "Unknown"), ("Family", F.col("lang"), "unknown"), ("Section", F.col("doc_id"), "unknown")]
    return table(s, d, "documents").select("doc_id", "lang", R.embedding_text(fields, F.col("text")).alias("text"))


_written: dict[tuple, object] = {}


def once(s: SparkSession, d: str, name: str, make: Callable[[DataFrame, str], object], of: DataFrame | None = None) -> object:
    """What ``make`` writes of the documents' searched texts (or ``of``): written once for an application and the files that the table has, then read."""
    docs = header(s, d) if of is None else of
    key = (s.sparkContext.applicationId, name, *sorted(docs.inputFiles()))
    if key not in _written:
        _written[key] = make(docs, sinks.new_folder(s, name))
    return _written[key]


def document_index(s: SparkSession, d: str) -> I.Index:
    return once(s, d, "index", lambda docs, path: I.build(docs, "doc_id", "text", path))


def document_vectors(s: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, embedding."""

    def make(docs: DataFrame, path: str) -> str:
        sinks.rebuild(R.embedded(docs, element="double"), path)
        return path

    return s.read.schema("doc_id long, lang string, embedding array<double>").parquet(once(s, d, "vectors", make))


def question() -> F.Column:
    """A benchmark item as a search: without quotes and dashes, which would be operators; ``or`` stays one."""
    return F.regexp_replace("text", r'["\-]+', " ")


def lexical_queries(s: SparkSession, d: str) -> DataFrame:
    """Each whole benchmark item as a question; every third one asks for a language."""
    lang = F.when(F.col("item_id") % 3 == 0, "en")
    return table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), question().alias("query"), lang.alias("lang"))


def dense_queries(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector is a query."""
    e = table(s, d, "embeddings").filter("vec_id % 20 = 0")
    return e.select(F.floor(F.col("vec_id") / 20).cast("string").alias("query_id"), F.col("embedding").alias("vector"), "label")


def in_language(s: SparkSession, d: str, queries: DataFrame):
    """Of (query_id, block, key) the rows in the language that the query asks for."""
    wanted = queries.filter("lang IS NOT NULL").select("query_id", F.col("lang").alias("wanted"))
    held = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("own"))
    return lambda met: broadcast_if_small(met.join(broadcast_if_small(wanted), "query_id", "left")).join(held, "key").filter("wanted IS NULL OR wanted = own").select("query_id", "block", "key")


def lexical_top(s: SparkSession, d: str, k: int | None = R.POOL) -> DataFrame:
    q = lexical_queries(s, d)
    return I.search(document_index(s, d), q, k, keep=in_language(s, d, q)).withColumnRenamed("key", "doc_id")


def dense_top(s: SparkSession, d: str, k: int = R.POOL, filtered: str | None = None) -> DataFrame:
    return R.cosine_top(table(s, d, "embeddings"), dense_queries(s, d), "vec_id", k, filtered=filtered)


def vector_index(s: SparkSession, d: str) -> V.VectorIndex:
    rows = table(s, d, "embeddings")
    return once(s, d, "cells", lambda _, path: V.build(rows, "vec_id", path, label="label"), of=rows)


def vector_recall(s: SparkSession, d: str, least: float = 0.9) -> DataFrame:
    """How many of the ten nearest vectors the nearest cells alone find, and whether that is enough."""
    index = vector_index(s, d)
    # Chosen on the vectors whose numbers leave 7, not on the queries.
    others = table(s, d, "embeddings").filter("vec_id % 20 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = V.search(index, dense_queries(s, d), 10, exact=False, probes=V.probes_for(index, others, 10))
    right = R.cosine_top(table(s, d, "embeddings"), dense_queries(s, d), "vec_id", 10).withColumnRenamed("vec_id", "id")
    return V.recall(found, right).select("queries", "wanted", (F.col("recall") >= least).alias("enough"))


def meaning_top(s: SparkSession, d: str, k: int = R.POOL) -> DataFrame:
    """The documents nearest to each question by embeddings, both made by the same embedder."""
    asked = R.embedded(lexical_queries(s, d), "query", element="double").withColumnRenamed("embedding", "vector")
    return R.cosine_top(document_vectors(s, d), asked, "doc_id", k, filtered="lang")


def hybrid(s: SparkSession, d: str) -> DataFrame:
    return R.fuse(lexical_top(s, d), meaning_top(s, d), "doc_id")


def with_documents(s: SparkSession, d: str, rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``rows`` (doc_id, ...) with ``columns`` of their documents. Few rows are sent to the documents, whose texts then stay where they are."""
    return broadcast_if_small(sinks.materialised(rows)).join(table(s, d, "documents").select("doc_id", *columns), "doc_id")


def retrieval_debug(s: SparkSession, d: str) -> DataFrame:
    """What each arm says of the fused results: scores and ranks beside the fused ones, and how long the document is."""
    lexical, dense = sinks.materialised(lexical_top(s, d)), sinks.materialised(meaning_top(s, d))
    fused = R.fuse(lexical, dense, "doc_id").withColumnRenamed("score", "hybrid_score")
    scores = lambda arm, name: arm.select("query_id", "doc_id", F.col("score").alias(name))
    rows = fused.join(scores(lexical, "lexical_score"), ["query_id", "doc_id"], "left").join(scores(dense, "dense_score"), ["query_id", "doc_id"], "left")
    return with_documents(s, d, rows, "source", "lang", F.length("text").alias("chars"))


def evidence(s: SparkSession, d: str) -> DataFrame:
    rows = with_documents(s, d, hybrid(s, d).filter(F.col("rank") <= 15), "source", "lang", "text")
    return R.diversified(rows, "source")


def judged(s: SparkSession, d: str) -> DataFrame:
    """A result is relevant in a language that its case expects (none: any)."""
    languages = F.when(F.col("query_id").cast("long") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en"), F.lit("fr")))
    # What a case expects is in its rows, so that only the results' texts are looked at, not all documents'.
    expected = hybrid(s, d).select("query_id", "doc_id", "rank", languages.alias("languages"), F.array(F.lit("the"), F.lit("de")).alias("needles"))
    rows = with_documents(s, d, expected, "lang", "text")
    return rows.select("query_id", "rank", R.relevant(F.col("languages"), F.col("lang"), F.col("needles"), F.col("text")).alias("relevant"))


def asked_results(s: SparkSession, d: str) -> DataFrame:
    """The hybrid's results with their queries and texts."""
    return with_documents(s, d, hybrid(s, d).join(lexical_queries(s, d).drop("lang"), "query_id"), "text")


def reranked_by_model(s: SparkSession, d: str) -> DataFrame:
    """The hybrid's results in the order of a model's scores; the model is the overlap of the first PAIR_TOKENS words of question and document."""
    return R.reranked(asked_results(s, d), "doc_id", "query", "text", score=scoring.pair_score())


def web_questions(s: SparkSession, d: str) -> DataFrame:
    """Each whole benchmark item as a search, in turn as it is, with its first two words as a phrase, and as two halves that are alternatives, of which the second excludes a language."""
    words = F.filter(F.split(question(), r"\s+"), lambda w: w != "")
    half = F.floor(F.size(words) / 2).cast("int")
    some = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    form = F.col("item_id") % 3
    query = F.when(form == 0, some(F.lit(1), F.size(words))).when(form == 1, F.concat(F.lit('"'), some(F.lit(1), F.lit(2)), F.lit('" '), some(F.lit(3), F.size(words)))).otherwise(F.concat(some(F.lit(1), half), F.lit(" or "), some(half + 1, F.size(words)), F.lit(" -fr")))
    return table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), query.alias("query"))


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents").select("doc_id", "lang", "source", "text")
    q = {}
    q["word_chunks"] = lambda s, d: R.word_chunks(docs(s, d)).select("doc_id", "chunk_index", "start_word", "end_word", F.md5("chunk_text").alias("text_md5"))
    q["chunk_coverage"] = lambda s, d: R.word_chunks(docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_word").alias("words"), F.max("token_count").alias("largest")).filter((F.col("largest") > R.CHUNK_WORDS) | (F.col("chunks") != F.greatest(F.ceil((F.col("words") - R.CHUNK_WORDS) / 180), F.lit(0)) + 1))
    q["chunk_records"] = lambda s, d: R.word_chunks(docs(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.sum("char_count").alias("chars"))
    q["embedding_text"] = lambda s, d: header(s, d).select("doc_id", F.md5("text").alias("text_md5"))
    q["lexical_match"] = lambda s, d: lexical_top(s, d, None).drop("rank")
    q["lexical_topk"] = lambda s, d: lexical_top(s, d, 10)
    q["vector_topk"] = lambda s, d: V.search(vector_index(s, d), dense_queries(s, d), 10).withColumnRenamed("id", "vec_id")
    q["vector_topk_filtered"] = lambda s, d: V.search(vector_index(s, d), dense_queries(s, d), 10, filtered=True).withColumnRenamed("id", "vec_id")
    q["vector_recall"] = vector_recall
    q["meaning_topk"] = lambda s, d: meaning_top(s, d, 10)
    q["cosine_topk"] = lambda s, d: dense_top(s, d, 10)
    q["cosine_topk_filtered"] = lambda s, d: dense_top(s, d, 10, "label")
    q["rrf_fusion"] = lambda s, d: hybrid(s, d).select("query_id", "doc_id", "score", "lexical_rank", "dense_rank", "rank")
    q["retrieval_debug"] = retrieval_debug
    q["evidence_pack"] = lambda s, d: evidence(s, d).select("query_id", "evidence_id", "doc_id", "source", "rank", "score")
    q["evidence_prompt"] = lambda s, d: R.prompt_blocks(evidence(s, d), F.col("source"), F.col("text")).select("query_id", F.md5("prompt").alias("prompt_md5"))
    q["rerank"] = lambda s, d: R.reranked(asked_results(s, d), "doc_id", "query", "text").select("query_id", "doc_id", "rerank_score", "original_rank", "rank")
    q["rerank_by_model"] = lambda s, d: reranked_by_model(s, d).select("query_id", "doc_id", "rerank_score", "original_rank", "rank")
    q["hit_mrr"] = lambda s, d: R.retrieval_metrics(lexical_queries(s, d), judged(s, d))
    q["first_relevant_rank"] = lambda s, d: judged(s, d).filter("relevant").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    q["pass_rates"] = lambda s, d: table(s, d, "labels").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("status_rate"), F.count_if(F.col("toxic").isNotNull() & (F.col("quality") == 0)).alias("with_expectation"), F.round(F.coalesce(F.try_divide(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)), F.count_if(F.col("quality") == 0)), F.lit(0.0)), 6).alias("family_rate"))
    q["web_search"] = lambda s, d: I.search(document_index(s, d), web_questions(s, d), 10).withColumnRenamed("key", "doc_id")
    return q


_TOK = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CHUNKS = f"WITH w AS (SELECT doc_id, source, {_W} AS w FROM documents), c AS (SELECT doc_id, source, w, unnest(range(0, greatest(ceil((len(w) - 220) / 180), 0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0), k AS (SELECT doc_id, source, i::INT AS chunk_index, (i * 180)::INT AS start_word, least(i * 180 + 220, len(w))::INT AS end_word, array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ') AS chunk_text FROM c)"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOP)) + "]"
_HEADER = "'Drug: ' || CASE WHEN source = 'src0' THEN 'Unknown' ELSE source END || chr(10) || 'Family: ' || lang || chr(10) || 'Section: ' || doc_id || chr(10) || chr(10) || text"
_QUESTION = """regexp_replace(text, '["\\-]+', ' ', 'g')"""


def _search(name: str, items: str, keep: str) -> str:
    """CTEs for DuckDB: ``name`` (query_id, doc_id, score) of all matches by cover density.

    ``items``: CTEs that end in qi (q, alt, item, w1, w2, minus) from qw (q, alt, n, w: the words of each query): an item is a word, or two in a row.
    ``keep``: what joins a match (q, d) must fulfil. Covers end where an item ends; the last begin of each item up to there, the least over an alternative's items, the most over alternatives, is where a cover begins if no cover began there or later.
    """
    return f"""dt AS (SELECT doc_id AS d, unnest(w) AS w, unnest(range(0, len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower({_HEADER}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)),
{items},
words AS (SELECT DISTINCT w FROM (SELECT w FROM dt UNION ALL SELECT w1 FROM qi UNION ALL SELECT w2 FROM qi) WHERE w IS NOT NULL AND NOT list_contains({_STOP}, w)),
{stem_sql("words")},
qt AS (SELECT DISTINCT q, alt, min(item) AS item, s1, s2, minus FROM (SELECT q, alt, item, a.stem AS s1, b.stem AS s2, minus FROM qi JOIN stems a ON a.w = w1 LEFT JOIN stems b ON b.w = w2) GROUP BY q, alt, s1, s2, minus),
wanted AS (SELECT DISTINCT unnest([s1, s2]) AS s FROM qt),
mk AS (SELECT d, p, stem AS s FROM dt JOIN stems USING (w) SEMI JOIN wanted ON wanted.s = stem),
pl AS (SELECT q, alt, item, minus, d, p AS b, p AS e FROM qt JOIN mk ON s = s1 WHERE s2 IS NULL UNION ALL SELECT q, alt, item, minus, x.d, x.p, y.p FROM qt JOIN mk x ON x.s = s1 JOIN mk y ON y.s = s2 AND y.d = x.d AND y.p = x.p + 1),
need AS (SELECT q, alt, count(*) AS n FROM qt WHERE NOT minus GROUP BY 1, 2),
al AS (SELECT q, alt, d FROM pl JOIN need USING (q, alt) GROUP BY q, alt, d HAVING count(DISTINCT item) FILTER (NOT minus) = any_value(n) AND count(*) FILTER (minus) = 0),
ok AS (SELECT al.* FROM al {keep}),
po AS (SELECT q, alt, item, d, b, e FROM pl JOIN ok USING (q, alt, d) WHERE NOT minus),
en AS (SELECT DISTINCT q, d, e FROM po),
gr AS (SELECT q, alt, item, d, en.e FROM en JOIN (SELECT DISTINCT q, alt, item, d FROM po) USING (q, d)),
la AS (SELECT gr.q, gr.alt, gr.item, gr.d, gr.e, po.b FROM gr ASOF JOIN po ON gr.q = po.q AND gr.alt = po.alt AND gr.item = po.item AND gr.d = po.d AND gr.e >= po.e),
ab AS (SELECT q, d, e, min(b) AS b FROM la JOIN need USING (q, alt) GROUP BY q, alt, d, e, n HAVING count(*) = n),
cv AS (SELECT q, d, b, min(e) AS e FROM (SELECT q, d, e, max(b) AS b FROM ab GROUP BY q, d, e) GROUP BY q, d, b),
mp AS (SELECT q, d, p, row_number() OVER (PARTITION BY q, d ORDER BY p) AS r FROM (SELECT DISTINCT ok.q, ok.d, mk.p FROM ok JOIN qt ON qt.q = ok.q JOIN mk ON mk.d = ok.d AND mk.s IN (qt.s1, qt.s2))),
{name} AS (SELECT cv.q AS query_id, cv.d AS doc_id, round(sum(0.1::DOUBLE / (1 + (e - b) - (y.r - x.r))), 6) AS score FROM cv JOIN mp x ON x.q = cv.q AND x.d = cv.d AND x.p = b JOIN mp y ON y.q = cv.q AND y.d = cv.d AND y.p = e GROUP BY 1, 2)"""


_RAW = f"qr AS (SELECT q, form, unnest(w) AS raw, unnest(range(0, len(w))) AS n, len(w) // 2 AS half FROM (SELECT item_id::VARCHAR AS q, item_id % 3 AS form, list_filter(regexp_split_to_array({_QUESTION}, '\\s+'), lambda x: x <> '') AS w FROM benchmark))"
#: Words of a raw word that punctuation cuts keep its place; ``or`` parts alternatives.
_SPLIT = "unnest(regexp_extract_all(lower(raw), '[\\p{L}\\p{N}]+')) AS w"
_PLAIN = f"{_RAW}, qo AS (SELECT *, sum((lower(raw) = 'or')::INT) OVER (PARTITION BY q ORDER BY n) AS alt FROM qr), qi AS (SELECT q, alt, n * 100 AS item, w AS w1, NULL::VARCHAR AS w2, false AS minus FROM (SELECT q, alt, n, {_SPLIT} FROM qo WHERE lower(raw) <> 'or'))"
_WEB = f"""{_RAW}, qo AS (SELECT *, sum((lower(raw) = 'or' AND NOT (form = 1 AND n < 2))::INT) OVER (PARTITION BY q ORDER BY n) + (form = 2 AND n >= half)::INT AS alt FROM qr),
qw AS (SELECT q, form, alt, n, {_SPLIT} FROM qo WHERE lower(raw) <> 'or' OR form = 1 AND n < 2),
ph AS (SELECT q, alt, list(w ORDER BY n) AS w FROM qw WHERE form = 1 AND n < 2 GROUP BY q, alt),
qi AS (SELECT q, alt, n * 100 AS item, w AS w1, NULL::VARCHAR AS w2, false AS minus FROM qw WHERE NOT (form = 1 AND n < 2)
  UNION ALL SELECT q, alt, -1, CASE WHEN list_contains({_STOP}, w[1]) THEN w[2] ELSE w[1] END, CASE WHEN len(w) = 2 AND NOT list_contains({_STOP}, w[1]) AND NOT list_contains({_STOP}, w[2]) THEN w[2] END, false FROM ph
  UNION ALL SELECT q, max(alt), -2, 'fr', NULL, true FROM qo WHERE form = 2 GROUP BY q)"""
_LANG = "JOIN documents ON doc_id = al.d WHERE al.q::BIGINT % 3 <> 0 OR lang = 'en'"
_LEX = f"WITH lq AS (SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 3 = 0 THEN 'en' END AS q_lang, {_QUESTION} AS question, list_distinct({_TOK.format(c=_QUESTION)}) AS rt FROM benchmark), {_search('lm', _PLAIN, _LANG)}"
_BYTE = lambda n: f"((instr('0123456789abcdef', substr(h, {2 * n + 1}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, {2 * n + 2}, 1)) - 1)"
_VECTOR = lambda key, text, of: f"SELECT {key} AS k, {_BYTE(0)} % 64 AS p, sum(CASE WHEN {_BYTE(1)} % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM {of}) GROUP BY 1, 2"
_MEANING = f"""dv AS ({_VECTOR('doc_id', _HEADER, 'documents')}), qv AS ({_VECTOR('query_id', 'question', 'lq')}), dn AS (SELECT k, sqrt(sum(v * v)) AS s FROM dv GROUP BY 1), qn AS (SELECT k, sqrt(sum(v * v)) AS s FROM qv GROUP BY 1),
dp AS (SELECT qv.k AS query_id, dv.k AS doc_id, sum(qv.v * dv.v) AS x FROM qv JOIN dv USING (p) GROUP BY 1, 2),
dm AS (SELECT query_id, d.doc_id, round(coalesce(x / nullif(a.s, 0) / nullif(b.s, 0), 0), 6) AS score FROM lq CROSS JOIN documents d LEFT JOIN dp USING (query_id, doc_id) LEFT JOIN qn a ON a.k = query_id LEFT JOIN dn b ON b.k = d.doc_id WHERE q_lang IS NULL OR q_lang = lang)"""
_TOP = "SELECT * FROM (SELECT {k}, score, query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {k})::INT AS rank FROM {t}) WHERE rank <= {n}"
_DENSE = "dm AS (SELECT (q.vec_id // 20)::VARCHAR AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 {f})"
_RRF = f"""{_LEX}, {_MEANING}, lt AS ({_TOP.format(k='doc_id', t='lm', n=30)}), vt AS ({_TOP.format(k='doc_id', t='dm', n=30)}),
u AS (SELECT query_id, doc_id, lt.rank AS lexical_rank, vt.rank AS dense_rank FROM lt FULL JOIN vt USING (query_id, doc_id)),
rr AS (SELECT *, round(coalesce(1 / (60.0::DOUBLE + lexical_rank), 0) + coalesce(1 / (60.0::DOUBLE + dense_rank), 0), 10) AS score FROM u),
rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(lexical_rank, 10000), coalesce(dense_rank, 10000), doc_id)::INT AS rank FROM rr)"""
_EVID = f"""{_RRF}, ev AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS s FROM rf JOIN (SELECT doc_id, source, lang, text FROM documents) USING (doc_id) WHERE rank <= 5),
ep AS (SELECT *, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM ev WHERE s <= 1)"""
_JUDGED = f"{_RRF}, jd AS (SELECT query_id, rank, (query_id::BIGINT % 3 = 0 OR lang IN ('en', 'fr')) AND (contains(lower(text), 'the') OR contains(lower(text), 'de')) AS relevant FROM rf JOIN documents USING (doc_id))"


def oracle_sql() -> dict[str, str]:
    return {
        "word_chunks": f"{_CHUNKS} SELECT doc_id, chunk_index, start_word, end_word, md5(chunk_text) AS text_md5 FROM k",
        "chunk_coverage": f"{_CHUNKS} SELECT doc_id, count(*) AS chunks, max(end_word) AS words, max(end_word - start_word) AS largest FROM k GROUP BY 1 HAVING largest > 220",
        "chunk_records": f"{_CHUNKS} SELECT source, count(*) AS chunks, sum(end_word - start_word)::BIGINT AS tokens, sum(length(chunk_text))::BIGINT AS chars FROM k GROUP BY 1",
        "embedding_text": f"SELECT doc_id, md5({_HEADER}) AS text_md5 FROM documents",
        "lexical_match": f"{_LEX} SELECT query_id, doc_id, score FROM lm",
        "lexical_topk": f"{_LEX} {_TOP.format(k='doc_id', t='lm', n=10)}",
        "meaning_topk": f"{_LEX}, {_MEANING} {_TOP.format(k='doc_id', t='dm', n=10)}",
        "web_search": f"WITH {_search('lm', _WEB, '')} {_TOP.format(k='doc_id', t='lm', n=10)}",
        "cosine_topk": f"WITH {_DENSE.format(f='')} {_TOP.format(k='vec_id', t='dm', n=10)}",
        "cosine_topk_filtered": f"WITH {_DENSE.format(f='AND e.label = q.label')} {_TOP.format(k='vec_id', t='dm', n=10)}",
        "vector_topk": f"WITH {_DENSE.format(f='')} {_TOP.format(k='vec_id', t='dm', n=10)}",
        "vector_topk_filtered": f"WITH {_DENSE.format(f='AND e.label = q.label')} {_TOP.format(k='vec_id', t='dm', n=10)}",
        "vector_recall": "SELECT count(*) AS queries, sum(least(10, n))::BIGINT AS wanted, true AS enough FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0), (SELECT count(*) AS n FROM embeddings)",
        "rrf_fusion": f"{_RRF} SELECT query_id, doc_id, score, lexical_rank, dense_rank, rank FROM rf",
        "retrieval_debug": f"{_RRF} SELECT rf.query_id, rf.doc_id, rf.score AS hybrid_score, rf.rank, lexical_rank, dense_rank, lt.score AS lexical_score, vt.score AS dense_score, source, lang, length(text)::INT AS chars FROM rf JOIN documents USING (doc_id) LEFT JOIN lt ON lt.query_id = rf.query_id AND lt.doc_id = rf.doc_id LEFT JOIN vt ON vt.query_id = rf.query_id AND vt.doc_id = rf.doc_id",
        "evidence_pack": f"{_EVID} SELECT query_id, evidence_id, doc_id, source, rank, score FROM ep",
        "evidence_prompt": f"{_EVID} SELECT query_id, md5(string_agg('[' || evidence_id || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS prompt_md5 FROM ep GROUP BY 1",
        "rerank": f"""{_RRF}, sc AS (SELECT rf.query_id, doc_id, rank AS original_rank, round(coalesce(len(list_filter(rt, lambda x: list_contains({_TOK.format(c='text')}, x))) / nullif(len(rt), 0), 0), 6) AS rerank_score FROM rf JOIN lq USING (query_id) JOIN documents USING (doc_id))
            SELECT query_id, doc_id, rerank_score, original_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank, doc_id)::INT AS rank FROM sc""",
        "rerank_by_model": f"""{_RRF}, sq AS (SELECT query_id, list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '') AS qw FROM lq),
            sd AS (SELECT rf.query_id, rf.doc_id, rank AS original_rank, list_distinct(regexp_extract_all(lower(array_to_string(qw[:512], ' ')), '[\\p{{L}}\\p{{N}}]+')) AS qt, regexp_extract_all(lower(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[:512 - least(512, len(qw))], ' ')), '[\\p{{L}}\\p{{N}}]+') AS pt FROM rf JOIN sq USING (query_id) JOIN documents USING (doc_id)),
            sc AS (SELECT query_id, doc_id, original_rank, round(coalesce(len(list_intersect(qt, pt)) / nullif(len(qt), 0), 0), 6) AS rerank_score FROM sd)
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank, doc_id)::INT AS rank FROM sc""",
        "hit_mrr": f"{_JUDGED}, fr AS (SELECT query_id, min(rank) FILTER (WHERE relevant AND rank <= 5) AS f FROM lq LEFT JOIN jd USING (query_id) GROUP BY 1) SELECT count(*) AS cases, round(avg(coalesce((f = 1)::INT, 0)), 6) AS hit_at_1, round(avg((f IS NOT NULL)::INT), 6) AS hit_at_k, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM fr",
        "first_relevant_rank": f"{_JUDGED} SELECT query_id, min(rank) AS first_rank FROM jd WHERE relevant GROUP BY 1",
        "pass_rates": "SELECT count(*) AS cases, round(avg((quality = 1)::INT), 6) AS status_rate, count(*) FILTER (WHERE toxic IS NOT NULL AND quality = 0) AS with_expectation, round(coalesce(count(*) FILTER (WHERE quality = 0 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 0), 0), 0), 6) AS family_rate FROM labels",
    }
