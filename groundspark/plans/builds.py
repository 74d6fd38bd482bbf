"""Builds: what sources and sinks write, read back; evaluation suites; the build's steps; the health of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..operators import corpus as C
from ..operators import planning as P
from ..operators import retrieval as R
from ..operators import sync as Y
from ..operators.builder import Builder, Step
from ..sources import sinks
from ..sources import tables as T
from ..sources.paged import TASK_PAGES, PagedListing
from ..sources.tables import table
from ..sources.versions import Change, Versions
from . import corpus, planning
from .sections import _PRODUCTS, _TREE, S, label_files, labels


def csv_export(s: SparkSession, d: str) -> DataFrame:
    path = sinks.new_folder(s, "csv")
    sinks.export_csv(table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations")), path)
    return s.read.csv(path, header=True, schema="n_regionkey int, nations string")


def json_export(s: SparkSession, d: str) -> DataFrame:
    path = sinks.new_folder(s, "json")
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    sinks.export_json(rows, path)
    return s.read.schema(rows.schema).json(path)


def csv_last_wins(s: SparkSession, d: str) -> DataFrame:
    """CSV files, one after the other, in which keys repeat: the last row of each is read."""
    path = sinks.new_folder(s, "keyed")
    table(s, d, "events").select("user_id", "event_type", "event_id").orderBy("event_id").write.csv(path, header=True)
    return T.keyed_csv(s, path, "user_id long, event_type string, event_id long", ["user_id", "event_type"])


def parsed_label_scan(s: SparkSession, d: str) -> DataFrame:
    path = sinks.new_folder(s, "parsed")
    tree = S.section_tree(labels(s, d))
    own = [x.split(":")[0].strip() for x in T.PARSED.split("STRUCT<")[1].rstrip(">").split(",")]
    tree.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("order_index", F.struct(*own).alias("x")))).alias("a")).select("label_id", F.transform("a", lambda x: x["x"]).alias("sections")).write.json(path)
    return T.parsed_labels(s, path)


def answers_of_orders(s: SparkSession, d: str) -> DataFrame:
    """An order is an answer, its lines the evidence, those with return flag R the citations."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("evidence_id"), F.col("l_partkey").alias("chunk_id"), "l_returnflag"))).alias("evidence"))
    return lines.select(F.col("l_orderkey").alias("query_id"), F.transform(F.filter("evidence", lambda e: e["l_returnflag"] == "R"), lambda e: e["evidence_id"]).alias("citations"), "evidence")


def log_tables(s: SparkSession, d: str) -> DataFrame:
    """Answers logged in two transactions, each of both logs, read back: each request with its evidence rows and how many were cited."""
    log = Versions(s, sinks.new_folder(s, "log"))
    answers = answers_of_orders(s, d)
    for half in (0, 1):
        log.commit({name: Change(rows) for name, rows in zip(("request", "evidence"), sinks.request_and_evidence_rows(answers.filter(F.col("query_id") % 2 == half)), strict=True)})
    evidence = log.read("evidence")
    per = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("was_cited").alias("cited"), F.max("evidence_position").alias("last_position"))
    return log.read("request").select("query_id", "evidence_count").join(per, "query_id", "left")


def chunk_rebuild(s: SparkSession, d: str) -> DataFrame:
    """Chunks written, then deleted and written anew with other windows: nothing of the first build is left."""
    path = sinks.new_folder(s, "chunks")
    docs = table(s, d, "documents").select("doc_id", "text")
    for words, overlap in ((50, 10), (R.CHUNK_WORDS, R.CHUNK_OVERLAP)):
        sinks.rebuild(R.word_chunks(docs, words=words, overlap=overlap).drop("chunk_text"), path)
    return s.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_word").alias("words"))


def chunk_record(s: SparkSession, d: str) -> DataFrame:
    rows = R.chunk_metadata(R.word_chunks(table(s, d, "documents").select("doc_id", "source", "lang", "text")), ["source", "lang", "doc_id"])
    return rows.select("doc_id", "chunk_index", "token_count", "char_count", "chunk_type", F.to_json("metadata").alias("metadata"))


def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Documents embedded and indexed; then every tenth again with another text, which takes the old one's place."""
    docs = table(s, d, "documents").select("doc_id", "text")
    path = sinks.new_folder(s, "index")
    sinks.rebuild(R.embedded(docs), path)
    new = R.embedded(docs.filter("doc_id % 10 = 0").select("doc_id", F.lit("another text").alias("text")))
    index = sinks.upsert(s.read.parquet(path), new, ["doc_id"])
    e = F.col("embedding")
    return index.select("doc_id", F.round(F.aggregate(e, F.lit(0.0), lambda t, x: t + x * x), 4).alias("norm"), F.size(F.filter(e, lambda x: x != 0)).alias("places"), F.round(e[17], 4).alias("at_17"))


#: Customers' numbers whose cases a file of a suite may have.
SUITE_KEYS = 25_000


def suite(s: SparkSession, d: str) -> DataFrame:
    """Evaluation suites of the customers' questions, YAML files of each nation's, read back with their defaults. A file has the cases of SUITE_KEYS numbers at most."""
    path, k = sinks.new_folder(s, "suite"), F.col("c_custkey")
    asked = planning.asked(s, d).select("query_id", "query", "drug")
    rows = table(s, d, "customer").join(asked, F.col("query_id") == F.concat(F.lit("c"), k.cast("string")))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)  # noqa: E731  a JSON string is one of YAML
    field = lambda name, given, value: F.when(given, F.concat(F.lit(f", {name}: "), value)).otherwise("")
    case = F.concat(
        F.lit("  - {case_id: "), "query_id", F.lit(", query: "), quoted("query"), F.lit(", expected_status: "), F.when(k % 2 == 1, "answered").otherwise("insufficient_evidence"),
        field("drug", F.col("drug").isNotNull(), quoted("drug")), field("top_k", k % 5 == 0, F.lit("3")), field("allowed_citation_prefixes", k % 3 > 0, F.when(k % 3 == 1, "[E]").otherwise("[R, E]")), field("required_headings", k % 4 == 0, F.lit("[h1, h2]")), F.lit("}"),
    )
    folders = ["c_nationkey", "part"]
    rows.groupBy("c_nationkey", F.floor(k / SUITE_KEYS).alias("part")).agg(F.concat(F.lit("cases:\n"), F.array_join(F.array_sort(F.collect_list(case)), "\n")).alias("value")).write.partitionBy(*folders).text(path)
    return T.eval_suite(s, path + "/*/*")


def suite_evaluation(s: SparkSession, d: str) -> DataFrame:
    """The suites run through the workflow: how many cases end as expected and cite as allowed, by expected status."""
    cases = sinks.materialised(suite(s, d))  # parsed once for all that reads it
    said = P.answers(cases.select(F.col("case_id").alias("query_id"), "query", "drug", "family"), *planning.concepts(s), planning.sections(s, d))
    rows = cases.join(said, F.col("case_id") == F.col("query_id"))
    status, cites = F.col("final_status") == F.col("expected_status"), P.prefixes_pass(F.col("citations"), F.col("allowed_citation_prefixes"))
    return rows.groupBy("expected_status").agg(F.count(F.lit(1)).alias("cases"), F.count_if(status).alias("status_pass"), F.count_if(cites).alias("citation_policy_pass"), F.count_if(status & cites).alias("overall_pass"))


def judged_answers(s: SparkSession, d: str) -> DataFrame:
    """Each judged answer of ``planning.cases`` as an evaluation case: what was expected, what came, and whether its citations may be."""
    cases = planning.cases(s, d)
    cites = F.coalesce(P.parsed_answer(F.col("raw"))["citations"], F.array().cast("array<string>"))
    own = cases.select("query_id", F.col("status").alias("expected_status"), P.prefixes_pass(cites, F.col("prefixes")).alias("citations_pass"))
    return own.join(P.answer_gates(cases), "query_id").withColumn("status_pass", F.col("final_status") == F.col("expected_status")).withColumn("overall_pass", F.col("status_pass") & F.col("citations_pass"))


def pass_rates(rows: DataFrame) -> DataFrame:
    """Counts and rates of an evaluation; a rate over the cases that expect something has only these below the line."""
    n = F.count(F.lit(1))
    rate = lambda part, whole: F.round(F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0)), 6)
    answered, refused = F.col("expected_status") == "answered", F.col("expected_status") == "insufficient_evidence"
    return rows.agg(
        n.alias("cases"), F.count_if("overall_pass").alias("overall_pass"), F.count_if("status_pass").alias("status_pass"), F.count_if("citations_pass").alias("citation_policy_pass"), rate(F.col("overall_pass"), F.lit(True)).alias("overall_rate"),
        rate(answered & F.col("overall_pass"), answered).alias("answered_rate"), rate(refused & F.col("overall_pass"), refused).alias("abstention_rate"), F.count_if(F.col("gate") == "verifier").alias("verifier_overrides"), F.count_if(F.col("gate").endswith("guardrail")).alias("guardrail_overrides"),
    )


def _histories(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return T.flatten_history(corpus.history_documents(customer, orders))


def _missing_files(files: DataFrame, histories: DataFrame) -> DataFrame:
    """Histories without a file, and files without text."""
    empty = files.filter("xml IS NULL OR xml = ''").select("label_id")
    return histories.select(F.col("set_id").alias("label_id")).distinct().join(files.select("label_id"), "label_id", "left_anti").unionByName(empty)


def _searched(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """The sections with text and a header of their label's title and their place."""
    rows = sections.filter("direct_text IS NOT NULL").join(documents.select("label_id", "title"), "label_id")
    fields = [("Label", F.col("title"), "Unknown"), ("Family", F.col("retrieval_family"), "unknown"), ("Section", F.array_join("heading_path", " > "), "unknown")]
    return rows.select("label_id", "order_index", F.col("direct_text").alias("text"), R.embedding_text(fields, F.lit("")).alias("header"))


def _uncovered(searched: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections of which some word is in no chunk."""
    last = chunks.groupBy("label_id", "order_index").agg(F.max("end_word").alias("end"), F.min("start_word").alias("start"))
    words = F.size(F.filter(F.split("text", WHITE), lambda w: w != ""))
    return searched.withColumn("words", words).join(last, ["label_id", "order_index"], "left").filter("words > 0 AND (end IS NULL OR start > 0 OR end < words)").select("label_id", "order_index")


def _counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("component"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


_CHUNK = ["label_id", "order_index", "chunk_index"]
#: A corpus build: from customers and orders to labels, sections, chunks, an index and the build's own record.
STEPS = [
    Step("histories", "ingestion", ("customer", "orders"), _histories),
    Step("label files", "ingestion", ("customer", "orders"), label_files),
    Step("missing files", "validation", ("label files", "histories"), _missing_files),
    Step("sections", "build", ("label files",), S.section_tree),
    Step("broken sections", "validation", ("sections",), S.hierarchy_violations),
    Step("documents", "build", ("label files",), S.document_fields),
    Step("products", "build", ("label files",), S.products),
    Step("unparsed labels", "validation", ("label files", "sections"), S.bad_labels),
    Step("searched sections", "build", ("sections", "documents"), _searched),
    Step("chunks", "build", ("searched sections",), lambda rows: R.word_chunks(rows.drop("header"))),
    Step("uncovered sections", "validation", ("searched sections", "chunks"), _uncovered),
    Step("vectors", "build", ("chunks",), lambda rows: R.embedded(rows.select(*_CHUNK, F.col("chunk_text").alias("text")))),
    Step("index differences", "validation", ("chunks", "vectors"), lambda chunks, vectors: C.reconciled(chunks.select(F.concat_ws(":", *_CHUNK).alias("id")), vectors.select(F.concat_ws(":", *_CHUNK).alias("id")), "id")),
    Step("corpus counts", "build", ("documents", "sections", "chunks", "vectors"), lambda documents, sections, chunks, vectors: _counts(documents=documents, sections=sections, chunks=chunks, vectors=vectors)),
    Step("build record", "build", ("corpus counts",), lambda counts: counts.groupBy().pivot("component", ["chunks", "documents", "sections", "vectors"]).agg(F.first("rows"))),
    Step("request log", "build", ("build record",), lambda record: record.limit(0).select(F.lit("").alias("query_id"), F.lit("").alias("query"), F.lit("").alias("final_status"))),
]


def sources(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: table(s, d, name) for name in ("customer", "orders")}


def build(s: SparkSession, d: str, leave_out: tuple[str, ...] = (), plan_only: bool = False, root: str | None = None) -> DataFrame:
    return Builder(s, root or sinks.new_folder(s, "build"), STEPS).run(sources(s, d), leave_out, plan_only)


def paged_scan(s: SparkSession, d: str) -> DataFrame:
    """Customers as a paged listing, a hundred a page, read page by page."""
    rows = table(s, d, "customer").select((F.floor(F.col("c_custkey") / 100) + 1).cast("int").alias("page"), F.struct(F.col("c_custkey").cast("string").alias("setid"), F.col("c_name").alias("title")).alias("row"))
    last = rows.agg(F.max("page")).first()[0]
    total, path = F.lit(last), sinks.new_folder(s, "pages")
    # A task writes about as many files as one reads: they cost more than their bytes.
    rows.repartition(max((last or 0) // TASK_PAGES, s.sparkContext.defaultParallelism), "page").groupBy("page").agg(F.to_json(F.struct(F.struct(total.alias("total_pages")).alias("metadata"), F.collect_list("row").alias("data"))).alias("value")).write.partitionBy("page").text(path)
    s.dataSource.register(PagedListing)
    return s.read.format("paged").option("url", f"{path if ':' in path else 'file://' + path}/page={{page}}").schema("setid string, title string").load()


def log_versions(s: SparkSession, d: str) -> DataFrame:
    """Requests and evidence rows of the log as each of its versions has them; the last transaction is sent twice."""
    log = Versions(s, sinks.new_folder(s, "log"))
    request, evidence = sinks.request_and_evidence_rows(answers_of_orders(s, d))
    for part in (0, 1, 2, 2):
        of = F.col("query_id") % 3 == part
        log.commit({"request": Change(request.filter(of)), "evidence": Change(evidence.filter(of))}, f"part-{part}")
    rows = [log.read(name, n).agg(F.lit(n).alias("version"), F.lit(name).alias("log"), F.count(F.lit(1)).alias("rows")) for n in log.numbers() for name in ("request", "evidence")]
    return reduce(lambda x, y: x.unionByName(y), rows)


def _index_and_table(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by digest, and an index that lacks some, has old texts of some and others that are gone."""
    rows = table(s, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    index = rows.filter("doc_id % 50 <> 7").withColumn("text_md5", F.when(F.col("doc_id") % 30 == 11, "old").otherwise(F.col("text_md5")))
    return rows, index.unionByName(rows.filter("doc_id % 40 = 3").withColumn("doc_id", F.col("doc_id") + 10_000_000))


def index_differences(s: SparkSession, d: str) -> DataFrame:
    return Y.differences(*_index_and_table(s, d), ["doc_id"])[0]


def index_mended(s: SparkSession, d: str) -> DataFrame:
    rows, index = _index_and_table(s, d)
    return Y.mended(rows, index, Y.differences(rows, index, ["doc_id"])[0], ["doc_id"])


def health(s: SparkSession, d: str, names: tuple[str, ...] = ("documents", "embeddings", "nation", "nowhere")) -> DataFrame:
    """component, status, rows: a table that can't be read is an error, and the whole is degraded with it. One bad table fails no other."""
    found = []
    for name in names:
        try:
            found.append((name, "ok", table(s, d, name).count()))
        except Exception:  # whatever a source raises
            found.append((name, "error", None))
    whole = "ok" if all(status == "ok" for _, status, _ in found) else "degraded"
    return s.createDataFrame([*found, ("overall", whole, None)], "component string, status string, rows long")


def queries() -> dict:
    return {
        "csv_export": csv_export, "json_export": json_export, "csv_last_wins": csv_last_wins, "parsed_label_scan": parsed_label_scan, "log_tables": log_tables, "chunk_rebuild": chunk_rebuild, "chunk_record": chunk_record, "vector_upsert": vector_upsert,
        "suite_evaluation": suite_evaluation, "eval_suite": lambda s, d: suite(s, d).select("case_id", "query", "expected_status", "drug", "top_k", F.array_join("allowed_citation_prefixes", ",").alias("prefixes"), F.size("required_headings").alias("headings")),
        "eval_pass_rates": lambda s, d: pass_rates(judged_answers(s, d)), "build_steps": build, "build_plan": lambda s, d: build(s, d, ("validation",), True), "health": health,
        "paged_scan": paged_scan, "log_versions": log_versions, "index_differences": index_differences, "index_mended": index_mended,
    }


def oracle_sql() -> dict[str, str]:
    words = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
    hexa = "0123456789abcdef"
    byte = lambda n: f"((instr('{hexa}', substr(h, {2 * n + 1}, 1)) - 1) * 16 + instr('{hexa}', substr(h, {2 * n + 2}, 1)) - 1)"
    o = planning.oracle_sql()
    return {
        "csv_export": "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS nations FROM nation GROUP BY 1",
        "json_export": "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer",
        "csv_last_wins": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2",
        "parsed_label_scan": f"{_TREE} SELECT label_id, uid AS section_uid, parent AS parent_section_uid, o AS order_index, dep AS depth, canon AS canonical_section_name, txt AS direct_text FROM t",
        "log_tables": "SELECT l_orderkey AS query_id, count(*)::INT AS evidence_count, count(*) AS rows, sum(c)::BIGINT AS cited, count(*)::INT AS last_position FROM (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) GROUP BY 1",
        "chunk_rebuild": f"SELECT doc_id, (greatest(ceil((len(w) - 220) / 180), 0) + 1)::BIGINT AS chunks, len(w)::INT AS words FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) > 0",
        "chunk_record": f"""WITH w AS (SELECT doc_id, source, lang, {words} AS w FROM documents), c AS (SELECT *, unnest(range(0, greatest(ceil((len(w) - 220) / 180), 0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
            SELECT doc_id, i::INT AS chunk_index, (least(i * 180 + 220, len(w)) - i * 180)::INT AS token_count, length(array_to_string(w[i * 180 + 1 : i * 180 + 220], ' '))::INT AS char_count, 'section_text' AS chunk_type, '{{"source":"' || source || '","lang":"' || lang || '","doc_id":' || doc_id || ',"chunking_strategy":"section_word_window","max_words":220,"overlap_words":40}}' AS metadata FROM c""",
        "vector_upsert": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'another text' ELSE text END AS text FROM documents), w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM d),
            p AS (SELECT doc_id, {byte(0)} % 64 AS p, sum(CASE WHEN {byte(1)} % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n, count(*) FILTER (WHERE v <> 0)::INT AS places, coalesce(sum(v) FILTER (WHERE p = 17), 0) AS x FROM p GROUP BY 1)
            SELECT doc_id, CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, coalesce(places, 0) AS places, round(coalesce(CASE WHEN n > 0 THEN x / n ELSE 0 END, 0), 4)::FLOAT AS at_17 FROM d LEFT JOIN n USING (doc_id)""",
        "eval_suite": f"""WITH {planning._ASKED} SELECT query_id AS case_id, query, CASE WHEN c_custkey % 2 = 1 THEN 'answered' ELSE 'insufficient_evidence' END AS expected_status, drug, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 5 END AS top_k, CASE c_custkey % 3 WHEN 1 THEN 'E' WHEN 2 THEN 'R,E' ELSE '' END AS prefixes, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS headings FROM a JOIN customer ON query_id = 'c' || c_custkey""",
        "suite_evaluation": f"""WITH w AS ({o["workflow_answers"]}), r AS (SELECT *, CASE WHEN c_custkey % 2 = 1 THEN 'answered' ELSE 'insufficient_evidence' END AS expected_status, CASE c_custkey % 3 WHEN 1 THEN ['E'] WHEN 2 THEN ['R', 'E'] ELSE []::VARCHAR[] END AS allowed, string_split(citations, ',') AS cites FROM w JOIN customer ON query_id = 'c' || c_custkey),
            k AS (SELECT expected_status, final_status = expected_status AS sp, len(allowed) = 0 OR citations = '' OR len(list_filter(cites, lambda c: NOT list_contains(allowed, c[1]))) = 0 AS cp FROM r) SELECT expected_status, count(*) AS cases, count(*) FILTER (sp) AS status_pass, count(*) FILTER (cp) AS citation_policy_pass, count(*) FILTER (sp AND cp) AS overall_pass FROM k GROUP BY 1""",
        "eval_pass_rates": f"""WITH g AS ({o["answer_gates"]}), c AS ({o["citation_policy"]}), j AS (SELECT query_id, gate, final_status, prefixes_pass, CASE WHEN query_id % 11 = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS e FROM g JOIN c USING (query_id)), k AS (SELECT *, final_status = e AS sp, final_status = e AND prefixes_pass AS op FROM j)
            SELECT count(*) AS cases, count(*) FILTER (op) AS overall_pass, count(*) FILTER (sp) AS status_pass, count(*) FILTER (prefixes_pass) AS citation_policy_pass, round(count(*) FILTER (op) / count(*), 6) AS overall_rate, round(coalesce(count(*) FILTER (op AND e = 'answered') / nullif(count(*) FILTER (e = 'answered'), 0), 0), 6) AS answered_rate,
            round(coalesce(count(*) FILTER (op AND e <> 'answered') / nullif(count(*) FILTER (e <> 'answered'), 0), 0), 6) AS abstention_rate, count(*) FILTER (gate = 'verifier') AS verifier_overrides, count(*) FILTER (gate LIKE '%guardrail') AS guardrail_overrides FROM k""",
        "build_steps": f"""{_TREE}, st(step, place, rows) AS (VALUES ('histories', 1, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey)), ('label files', 2, (SELECT count(*) FROM customer)), ('missing files', 3, 0), ('sections', 4, (SELECT count(*) FROM t)), ('broken sections', 5, 0), ('documents', 6, (SELECT count(*) FROM customer)),
            ('products', 7, (SELECT count(*) FROM ({_PRODUCTS}))), ('unparsed labels', 8, 0), ('searched sections', 9, (SELECT count(txt) FROM t)), ('chunks', 10, (SELECT count(txt) FROM t)), ('uncovered sections', 11, 0), ('vectors', 12, (SELECT count(txt) FROM t)), ('index differences', 13, 0), ('corpus counts', 14, 4), ('build record', 15, 1), ('request log', 16, 0))
            SELECT step, place, 'done' AS status, rows::BIGINT AS rows FROM st""",
        "build_plan": "SELECT step, row_number() OVER () AS place, CASE WHEN step IN ('missing files', 'broken sections', 'unparsed labels', 'uncovered sections', 'index differences') THEN 'left out' ELSE 'planned' END AS status, NULL::BIGINT AS rows FROM (SELECT unnest(['histories', 'label files', 'missing files', 'sections', 'broken sections', 'documents', 'products', 'unparsed labels', 'searched sections', 'chunks', 'uncovered sections', 'vectors', 'index differences', 'corpus counts', 'build record', 'request log']) AS step)",
        "paged_scan": "SELECT c_custkey::VARCHAR AS setid, c_name AS title FROM customer",
        "log_versions": "SELECT v AS version, log, count(*) AS rows FROM (SELECT unnest([1, 2, 3]) AS v), (SELECT 'evidence' AS log, l_orderkey AS k FROM lineitem UNION ALL SELECT DISTINCT 'request', l_orderkey FROM lineitem) WHERE k % 3 < v GROUP BY 1, 2",
        "index_differences": "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'missing' ELSE 'changed' END AS what FROM documents WHERE doc_id % 50 = 7 OR doc_id % 30 = 11 UNION ALL SELECT doc_id + 10000000, 'stale' FROM documents WHERE doc_id % 40 = 3",
        "index_mended": "SELECT doc_id, md5(text) AS text_md5, lang FROM documents",
        "health": "SELECT 'documents' AS component, 'ok' AS status, count(*) AS rows FROM documents UNION ALL SELECT 'embeddings', 'ok', count(*) FROM embeddings UNION ALL SELECT 'nation', 'ok', count(*) FROM nation UNION ALL SELECT 'nowhere', 'error', NULL UNION ALL SELECT 'overall', 'degraded', NULL",
    }
