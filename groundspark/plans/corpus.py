"""Corpus queries: region, nation, customer, orders and lineitem stand for document, version, section and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_list, uuid5
from ..operators import corpus as C
from ..sources import sinks
from ..sources.tables import flatten_history, last_by_key, locked, table

_SEED_SQL = "s AS (SELECT n_name AS concept_name, [r_name, 'TABLET'] AS prefer, CASE WHEN n_nationkey % 3 = 0 THEN ['BUILDING'] ELSE []::VARCHAR[] END AS exclude, CASE WHEN n_nationkey % 4 > 0 THEN 'set' || n_nationkey END AS set_id, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 7 END AS locked_spl_version FROM nation JOIN region ON r_regionkey = n_regionkey)"
_CANDIDATE_SQL = """c AS (SELECT n_name AS concept_name, c_custkey::VARCHAR AS setid, (c_custkey % 23)::VARCHAR AS spl_version, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) || ' ' ELSE '' END || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' tablet' WHEN 1 THEN ' of ' || r_name ELSE '' END AS title,
  CASE c_custkey % 4 WHEN 0 THEN 'bad date' WHEN 1 THEN '2024' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '15' ELSE CASE c_custkey % 3 WHEN 0 THEN 'Jan ' WHEN 1 THEN 'Apr ' ELSE 'Dec ' END || (c_custkey % 28 + 1) || ', 2024' END AS published_date
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_SCORED_SQL = f"""WITH {_SEED_SQL}, {_CANDIDATE_SQL}, m AS (SELECT c.*, list_filter(prefer, lambda t: contains(upper(title), upper(t))) AS matched_preferred,
  list_filter(exclude, lambda t: contains(upper(title), upper(t))) AS matched_excluded FROM c JOIN s USING (concept_name)),
w AS (SELECT *, (10 * len(matched_preferred) - 100 * len(matched_excluded) + CASE WHEN contains(upper(title), upper(concept_name)) THEN 5 ELSE 0 END)::INT AS score FROM m)"""


def seeds_of(s: SparkSession, d: str) -> DataFrame:
    """A seed for each nation."""
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    return rows.select(F.col("n_name").alias("concept_name"), F.array("r_name", F.lit("TABLET")).alias("prefer_title_contains"), F.when(k % 3 == 0, F.array(F.lit("BUILDING"))).otherwise(none).alias("exclude_title_contains"), F.when(k % 4 > 0, F.concat(F.lit("set"), k)).alias("set_id"), F.when(k % 5 > 0, k % 7).alias("locked_spl_version"), "n_nationkey", "r_name")


def candidates(s: SparkSession, d: str) -> DataFrame:
    """The customers of each seed's nation as labels to choose from, scored."""
    k = F.col("c_custkey")
    rows = table(s, d, "customer").join(F.broadcast(seeds_of(s, d)), F.col("c_nationkey") == F.col("n_nationkey"))  # a row for each nation
    title = F.concat(F.when(k % 2 == 0, F.concat(F.lower("concept_name"), F.lit(" "))).otherwise(""), "c_mktsegment", F.when(k % 3 == 0, " tablet").when(k % 3 == 1, F.concat(F.lit(" of "), "r_name")).otherwise(""))
    month = F.when(k % 3 == 0, "Jan ").when(k % 3 == 1, "Apr ").otherwise("Dec ")
    date = F.when(k % 4 == 0, "bad date").when(k % 4 == 1, F.concat(F.lit("2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("15"))).otherwise(F.concat(month, (k % 28 + 1).cast("string"), F.lit(", 2024")))
    rows = rows.select("concept_name", k.cast("string").alias("setid"), (k % 23).cast("string").alias("spl_version"), title.alias("title"), date.alias("published_date"), "prefer_title_contains", "exclude_title_contains")
    scored = C.title_score(F.col("title"), F.col("concept_name"), F.col("prefer_title_contains"), F.col("exclude_title_contains"))
    return rows.select("concept_name", "setid", "spl_version", "title", "published_date", *(v.alias(k) for k, v in scored.items()))


def corpus_counts(s: SparkSession, d: str) -> DataFrame:
    """Every table's size and the distinct counts, each table read once."""
    n = F.count(F.lit(1))
    parts = [
        table(s, d, "nation").agg(n.alias("documents")), table(s, d, "customer").agg(n.alias("versions"), F.countDistinct("c_mktsegment").alias("segments")),
        table(s, d, "orders").agg(n.alias("sections"), F.countDistinct("o_custkey").alias("versions_with_sections")), table(s, d, "lineitem").agg(n.alias("chunks")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def drug_summary(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    per_customer = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))
    customers = table(s, d, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    per_nation = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("versions"), F.sum(F.coalesce("orders", F.lit(0))).alias("sections"), F.sum(F.coalesce("lines", F.lit(0))).alias("chunks"))
    zero = {c: 0 for c in ("versions", "sections", "chunks")}
    return table(s, d, "nation").join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(zero).select("n_name", *zero).orderBy("n_name")


def label_summary(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    flag = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sections"), F.count_if(F.col("o_orderstatus") == "F").alias("mapped"), F.count_if(F.col("o_orderstatus") != "F").alias("unmapped"), F.max(F.substring("o_orderpriority", 1, 1).cast("int")).alias("depth"))
    return table(s, d, "customer").join(flag, F.col("c_custkey") == F.col("o_custkey"), "left").fillna({"sections": 0, "mapped": 0, "unmapped": 0, "depth": 0}).select("c_custkey", "sections", "mapped", "unmapped", F.col("depth").alias("max_depth"))


def join_retrievable(s: SparkSession, d: str) -> DataFrame:
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    c = c.filter(C.retrievable(F.col("c_mktsegment"), F.col("c_name")))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "c_name", "n_name", "r_name")


def join_optional_filters(s: SparkSession, d: str) -> DataFrame:
    """Question rows (n, concept, family) against nations and segments; a null filter passes all, the concept's case doesn't matter."""
    ask = s.createDataFrame([(1, "france", "BUILDING"), (2, None, "MACHINERY"), (3, "Germany", None), (4, "GERMANY", "building")], "query_id int, concept string, family string")
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    on = (F.col("concept").isNull() | (F.lower("concept") == F.lower("n_name"))) & (F.col("family").isNull() | (F.col("family") == F.col("c_mktsegment")))
    return rows.join(F.broadcast(ask), on).groupBy("query_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("customers").alias("customers"))  # four rows are broadcast


def upsert_merge(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter(F.col("c_custkey") % 10 == 0).select("c_custkey", F.concat(F.col("c_name"), F.lit(" (new)")).alias("c_name"), F.col("c_acctbal"))
    more = old.filter(F.col("c_custkey") % 100 == 0).select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_acctbal")
    return sinks.upsert(old, new.unionByName(more), ["c_custkey"])


def log_append(s: SparkSession, d: str) -> DataFrame:
    """Evidence rows of answers: an order is an answer, its lines the evidence, those with return flag R the citations."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.struct(F.concat(F.lit("E"), x["l_linenumber"].cast("string")).alias("evidence_id"), x["l_partkey"].alias("chunk_id"), x["l_returnflag"].alias("flag"))).alias("evidence")
    )
    answers = lines.select(F.col("l_orderkey").alias("query_id"), F.transform(F.filter("evidence", lambda e: e["flag"] == "R"), lambda e: e["evidence_id"]).alias("citations"), "evidence")
    return sinks.request_and_evidence_rows(answers)[1].select("query_id", "evidence_id", "chunk_id", "evidence_position", "was_cited")


def build_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The corpus's counts appended to the build log, and the log read back."""
    path = sinks.new_folder(s, "build-log")
    now = corpus_counts(s, d).crossJoin(table(s, d, "embeddings").agg(rows().alias("index_points")))  # one row each
    sinks.append(now, path)
    return s.read.schema(now.schema).parquet(path)


def histories_of(s: SparkSession, d: str) -> DataFrame:
    return history_documents(table(s, d, "customer"), table(s, d, "orders"))


def history_documents(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A history document for each customer: its orders are the versions, the newest first."""
    history = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_orderkey")).alias("k"), F.date_format("o_orderdate", "MMM d, yyyy").alias("date")))), lambda x: F.struct((-x["k"]).cast("int").alias("spl_version"), x["date"].alias("published_date")))
    per = orders.groupBy("o_custkey").agg(history.alias("history"))
    named = customer.join(per, F.col("c_custkey") == F.col("o_custkey"))
    return named.select(F.struct(F.struct(F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("setid")).alias("spl"), "history").alias("data"))


def locks(s: SparkSession, d: str) -> DataFrame:
    """set_id and locked version: for the customers with an even key that of their newest order."""
    newest = table(s, d, "orders").filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").cast("int").alias("locked_spl_version"))
    return locked(newest.select(F.col("o_custkey").cast("string").alias("set_id"), "locked_spl_version"))


def rows() -> Column:
    return F.count(F.lit(1))


def queries() -> dict:
    q = {"corpus_counts": corpus_counts, "drug_summary": drug_summary, "label_summary": label_summary, "join_retrievable": join_retrievable, "join_optional_filters": join_optional_filters, "upsert_merge": upsert_merge, "log_append": log_append}
    q["family_summary"] = lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("concepts"), F.countDistinct("o_orderkey").alias("sections"), rows().alias("chunks")).orderBy("o_orderpriority")
    q["filtered_counts"] = lambda s, d: table(s, d, "region").join(table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(table(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name").agg(rows().alias("versions"), F.count_if(F.col("c_acctbal") > 0).alias("with_family"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("unclassified"))
    q["chunk_join"] = lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "l_returnflag").agg(rows().alias("chunks"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    q["anti_orphans"] = lambda s, d: C.orphans(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")
    q["semi_cited"] = lambda s, d: table(s, d, "documents").join(table(s, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")
    q["full_reconcile"] = lambda s, d: C.reconciled(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id")
    q["index_reconcile"] = lambda s, d: table(s, d, "documents").agg(rows().alias("table_rows")).crossJoin(table(s, d, "embeddings").agg(rows().alias("index_points"))).select("*", (F.col("table_rows") == F.col("index_points")).alias("equal"))
    q["parent_resolution"] = lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent")).alias("a").join(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("parent_name")), F.col("parent") == F.col("k"), "left").select("p_partkey", "parent", "parent_name")
    q["manifest_lookup"] = lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
    q["dedup_last"] = lambda s, d: last_by_key(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
    q["dedup_first"] = lambda s, d: C.first_by_key(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
    q["distinct_concepts"] = lambda s, d: table(s, d, "documents").select("source").distinct().orderBy("source")
    q["candidate_score"] = lambda s, d: candidates(s, d).select("concept_name", "setid", "score", F.array_join("matched_preferred", ",").alias("preferred"), F.array_join("matched_excluded", ",").alias("excluded"))
    q["candidate_rank"] = lambda s, d: C.ranked_candidates(candidates(s, d)).select("concept_name", "setid", "place")
    q["locked_seeds"] = lambda s, d: locked(seeds_of(s, d)).select("concept_name", "set_id", "locked_spl_version")
    q["history_flatten"] = lambda s, d: flatten_history(histories_of(s, d)).join(locks(s, d), "set_id").select("set_id", "title", "history_spl_version", "published_date", (F.col("history_spl_version") == F.col("locked_spl_version").cast("string")).alias("is_locked_version"))
    q["largest_member"] = lambda s, d: table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))
    q["set_rollup"] = lambda s, d: C.set_rollup(table(s, d, "part"), "p_brand", ["p_type", "p_size"])
    q["top_reasons"] = lambda s, d: table(s, d, "part").groupBy("p_name").agg(rows().alias("n")).orderBy(F.desc("n"), "p_name").limit(20)
    q["chunk_stats"] = lambda s, d: table(s, d, "documents").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 2).alias("mean"), F.countDistinct("source").alias("sources"))
    q["outlier_probe"] = lambda s, d: table(s, d, "documents").filter("n_chars > 5000").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "source", "n_chars")
    q["ordered_union"] = lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("a")).select("lang", F.array_join(F.array_union(F.array(F.lit("src3"), F.lit("none")), "a"), ",").alias("matches"))
    q["latest_build"] = lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_totalprice")
    q["build_snapshot"] = build_snapshot
    q["list_export"] = lambda s, d: sinks.joined_lists(table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations")))
    q["hierarchy_rollup"] = lambda s, d: C.rollup_without_fan_out(table(s, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), "k", {"nations": table(s, d, "nation").select(F.col("n_regionkey").alias("k")), "suppliers": table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("k"))}).select("r_name", "nations", "suppliers")
    q["point_ids"] = lambda s, d: table(s, d, "customer").select("c_custkey", uuid5(F.concat_ws("|", F.lit("chunk"), "c_custkey", "c_name")).alias("point_id"))
    q["list_coercion"] = lambda s, d: table(s, d, "part").select("p_partkey", as_list(listed()).alias("x")).select("p_partkey", F.size("x").alias("n"), F.array_join("x", "|").alias("items"))
    return q


def listed() -> Column:
    """What a list column of a file may hold: a JSON array, plain text, an unclosed array, nothing."""
    k = F.col("p_partkey") % 5
    return F.when(k == 0, F.concat(F.lit('["'), F.col("p_name"), F.lit('", "'), F.col("p_type"), F.lit('"]'))).when(k == 1, F.col("p_name")).when(k == 2, "").when(k == 3, "[]")


def oracle_sql() -> dict[str, str]:
    counts = "(SELECT count(*) FROM nation) AS documents, (SELECT count(*) FROM customer) AS versions, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments, (SELECT count(*) FROM orders) AS sections, (SELECT count(DISTINCT o_custkey) FROM orders) AS versions_with_sections, (SELECT count(*) FROM lineitem) AS chunks"
    last = "SELECT user_id, event_type, {f}(event_id) AS event_id, arg_{f}(value, event_id) AS value FROM events GROUP BY 1, 2"
    return {
        "corpus_counts": f"SELECT {counts}",
        "build_snapshot": f"SELECT {counts}, (SELECT count(*) FROM embeddings) AS index_points",
        "drug_summary": "SELECT n_name, count(DISTINCT c_custkey) AS versions, count(DISTINCT o_orderkey) AS sections, count(l_orderkey) AS chunks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
        "label_summary": "SELECT c_custkey, count(o_orderkey) AS sections, count(*) FILTER (WHERE o_orderstatus = 'F') AS mapped, count(*) FILTER (WHERE o_orderstatus <> 'F') AS unmapped, coalesce(max(left(o_orderpriority, 1)::INT), 0) AS max_depth FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "join_retrievable": "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IS NOT NULL AND c_name IS NOT NULL AND length(trim(c_name)) > 0",
        "join_optional_filters": "WITH a AS (SELECT * FROM (VALUES (1, 'france', 'BUILDING'), (2, NULL, 'MACHINERY'), (3, 'Germany', NULL), (4, 'GERMANY', 'building')) t(query_id, concept, family)) SELECT query_id, count(DISTINCT (n_name, c_mktsegment)) AS groups, count(*) AS customers FROM a JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON (concept IS NULL OR lower(concept) = lower(n_name)) AND (family IS NULL OR family = c_mktsegment) GROUP BY 1",
        "upsert_merge": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' (new)' ELSE c_name END AS c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 100 = 0",
        "log_append": "SELECT l_orderkey AS query_id, 'E' || l_linenumber AS evidence_id, l_partkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)::INT AS evidence_position, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS was_cited FROM lineitem",
        "family_summary": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS concepts, count(DISTINCT o_orderkey) AS sections, count(*) AS chunks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
        "filtered_counts": "SELECT r_name, count(*) AS versions, count(*) FILTER (WHERE c_acctbal > 0) AS with_family, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS unclassified FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
        "chunk_join": "SELECT c_mktsegment, l_returnflag, count(*) AS chunks, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
        "anti_orphans": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "semi_cited": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "full_reconcile": "SELECT doc_id, d.doc_id IS NOT NULL AS in_a, l.doc_id IS NOT NULL AS in_b FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
        "index_reconcile": "SELECT a AS table_rows, b AS index_points, a = b AS equal FROM (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM embeddings) AS b)",
        "parent_resolution": "WITH a AS (SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part) SELECT a.p_partkey, a.parent, b.p_name AS parent_name FROM a LEFT JOIN part b ON a.parent = b.p_partkey",
        "manifest_lookup": "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
        "dedup_last": last.format(f="max"),
        "dedup_first": last.format(f="min"),
        "distinct_concepts": "SELECT DISTINCT source FROM documents",
        "candidate_score": f"{_SCORED_SQL} SELECT concept_name, setid, score, array_to_string(matched_preferred, ',') AS preferred, array_to_string(matched_excluded, ',') AS excluded FROM w",
        "candidate_rank": f"{_SCORED_SQL} SELECT concept_name, setid, row_number() OVER (PARTITION BY concept_name ORDER BY score DESC, coalesce(try_strptime(published_date, '%b %d, %Y'), try_strptime(published_date, '%Y%m%d'), TIMESTAMP '0001-01-01') DESC, spl_version DESC, setid)::INT AS place FROM w",
        "locked_seeds": f"WITH {_SEED_SQL} SELECT concept_name, set_id, locked_spl_version FROM s WHERE set_id IS NOT NULL AND locked_spl_version IS NOT NULL",
        "history_flatten": "SELECT o_custkey::VARCHAR AS set_id, c_name AS title, o_orderkey::VARCHAR AS history_spl_version, strftime(o_orderdate, '%b %-d, %Y') AS published_date, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_locked_version FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 2 = 0",
        "point_ids": "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('chunk|' || c_custkey || '|' || c_name)::BLOB) AS h FROM customer)",
        "list_coercion": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS n, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name ELSE '' END AS items FROM part",
        "largest_member": "SELECT source, arg_max(doc_id, n_chars * 1000000000 + doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1",
        "set_rollup": "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ' | ') AS p_type, array_to_string(list_sort(list(DISTINCT p_size::VARCHAR)), ' | ') AS p_size FROM part GROUP BY 1",
        "top_reasons": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20",
        "chunk_stats": "SELECT min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 2) AS mean, count(DISTINCT source) AS sources FROM documents",
        "outlier_probe": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 5000 ORDER BY n_chars DESC, doc_id LIMIT 10",
        "ordered_union": "SELECT lang, 'src3,none' || coalesce(',' || nullif(array_to_string(list_filter(list_sort(list(DISTINCT source)), lambda x: x <> 'src3' AND x <> 'none'), ','), ''), '') AS matches FROM documents GROUP BY 1",
        "latest_build": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
        "list_export": "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS nations FROM nation GROUP BY 1",
        "hierarchy_rollup": "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS suppliers FROM region",
    }
