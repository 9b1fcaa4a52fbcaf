"""Queries for output, listings, maintenance and joins of the index, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import incremental, lexical, queueing, ranking, report, store
from ..tables import table
from .core import CHUNK_SEM_SQL, CHUNKS_SQL, CODE_MODEL, CODE_TERMS, CODE_WORDS, DOC_TERMS, DOCS_MODEL, DOCS_SCOPE, DOCS_WORDS, EXCLUDED_SQL, PRESENT_FILES_SQL, PRESENT_PAGES_SQL, QUEUE_SQL, UNITS_SQL, _chunk_pages, _chunk_semantic, _chunks, _present_files, _queue, _rounded, _units, query, sql_bm25


# output
def sql_field(name: str, column: str) -> str:
    return f"""CASE WHEN {column} IS NOT NULL THEN '"{name}":' || to_json({column}) END"""


@query(f"SELECT DISTINCT id, docset_slug, '{{' || concat_ws(',', {sql_field('pageId', 'id')}, {sql_field('pageTitle', 'title')}, {sql_field('type', 'type')}) || '}}' AS json FROM pages")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON in camel case, without nulls."""
    rows = table(spark, d, "pages").withColumnsRenamed({"id": "page_id", "title": "page_title"})
    made = report.as_json(["page_id", "page_title", "type"], {"page_id": "pageId", "page_title": "pageTitle"})
    return rows.select(F.col("page_id").alias("id"), "docset_slug", made.alias("json")).distinct()


@query("SELECT DISTINCT id, docset_slug, json_object('id', id, 'type', type)::VARCHAR AS json FROM pages")
def results_json_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", "docset_slug", report.as_json(["id", "type"], drop_nulls=False).alias("json")).distinct()


@query("""WITH t AS (SELECT docset_slug, coalesce(max_chunk_chars::VARCHAR, '') AS m, coalesce(enabled::VARCHAR, '') AS e FROM embeddings_config), w AS (SELECT greatest(max(length(docset_slug)), 11) AS a, greatest(max(length(m)), 15) AS b, greatest(max(length(e)), 7) AS c FROM t)
SELECT docset_slug, rtrim(rpad(docset_slug, a::INT, ' ') || '  ' || rpad(m, b::INT, ' ') || '  ' || rpad(e, c::INT, ' ')) AS line FROM t, w""")
def aligned_table(spark: SparkSession, d: str) -> DataFrame:
    return report.aligned(table(spark, d, "embeddings_config"), ["docset_slug", "max_chunk_chars", "enabled"]).select("docset_slug", "line")


@query("SELECT seq, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updated FROM pages")
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("seq", text.iso_timestamp(F.col("updated_at")).alias("updated"))


@query("SELECT DISTINCT name, string_split(name, '_')[1] || array_to_string(list_transform(string_split(name, '_')[2:], lambda x: upper(x[1:1]) || x[2:]), '') AS camel FROM code_units WHERE name IS NOT NULL")
def camel_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_units").where("name is not null").select("name").distinct()
    return rows.select("name", text.camel_case(F.col("name")).alias("camel"))


@query("WITH v AS (SELECT DISTINCT docset_slug AS v FROM pages UNION SELECT DISTINCT path FROM pages WHERE path IS NOT NULL) SELECT v AS value, regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9._+~-]*') AS safe FROM v")
def safe_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages")
    values = rows.select(F.col("docset_slug").alias("value")).union(rows.where("path is not null").select("path")).distinct()
    return values.select("value", text.safe_segment(F.col("value")).alias("safe"))


METADATA_SQL = "CASE WHEN json_valid(metadata_json) AND json_type(metadata_json) = 'OBJECT' THEN {0} END"


@query(f"SELECT DISTINCT id, {METADATA_SQL.format("json_extract_string(metadata_json, '$.pageId')")} AS page, coalesce({METADATA_SQL.format('len(json_keys(metadata_json))')}, 0)::INT AS fields FROM search_chunks")
def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    parsed = text.metadata_map(F.col("metadata_json"))
    return table(spark, d, "search_chunks").select("id", parsed["pageId"].alias("page"), F.size(parsed).alias("fields")).distinct()


# listings
@query("WITH u AS (SELECT DISTINCT id, file_path, start_line, language, source FROM code_units WHERE starts_with(file_path, 'tide-api/')) SELECT id, file_path, start_line, source FROM u ORDER BY file_path, start_line, id LIMIT 20")
def list_units_source(spark: SparkSession, d: str) -> DataFrame:
    """Small pages of a listing may hold the source."""
    rows = _units(spark, d).where(paths.under_prefix(F.col("file_path"), "tide-api")).distinct()
    return store.listing(rows, 20, prefix="tide-api", include_source=True).select("id", "file_path", "start_line", "source")


@query(f"WITH {PRESENT_PAGES_SQL} SELECT docset_slug, count(*) AS pages, count(*) FILTER (WHERE content_hash IS NULL) AS unread FROM pp GROUP BY docset_slug ORDER BY docset_slug LIMIT 500")
def docset_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages")
    present = incremental.present_rows(rows, ["docset_slug", "id"], "content_hash")
    return present.groupBy("docset_slug").agg(F.count("*").alias("pages"), F.count_if(F.col("content_hash").isNull()).alias("unread")).orderBy("docset_slug").limit(500)


@query("""SELECT v.vec_id, v.label, row_number() OVER (ORDER BY o.n) - 1 AS mention FROM (VALUES (7, 0), (3, 1), (99999999, 2), (1, 4)) o(id, n) JOIN embeddings v ON v.vec_id = o.id""")
def ordered_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rows of given ids in the order in which the ids come first; unknown ids are left out."""
    made = ranking.in_order([7, 3, 99999999, 3, 1], table(spark, d, "embeddings"), "vec_id")
    rank = F.row_number().over(Window.orderBy("mention")) - 1
    return made.select("vec_id", "label", rank.alias("mention"))


@query("SELECT id, 0.0::DOUBLE AS rank FROM search_chunks WHERE FALSE")
def keyword_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A query without terms has no hits."""
    return lexical.bm25(_chunks(spark, d), "id", ["text"], ["?!", ""])


# joins of hits
@query(sql_bm25(UNITS_SQL, "id, file_path, start_line, name", ["unit_type", "name", "source"], CODE_WORDS) + "SELECT id, file_path, start_line, name, round(rank, 6) AS rank FROM ranked ORDER BY round(ranked.rank, 9), id LIMIT 50")
def search_units(spark: SparkSession, d: str) -> DataFrame:
    """The best keyword hits with their units."""
    best = lexical.top(lexical.bm25(_units(spark, d), "id", ["unit_type", "name", "source"], CODE_TERMS), "id", 50)
    rows = best.join(_units(spark, d).select("id", "file_path", "start_line", "name").distinct(), "id")
    return _rounded(rows.select("id", "file_path", "start_line", "name", "rank"), "rank")


@query(f"""WITH {CHUNK_SEM_SQL}, {PRESENT_PAGES_SQL}, b AS (SELECT * FROM sem ORDER BY round(score, 9) DESC, id LIMIT 200)
SELECT b.id, b.docset_slug, pp.title, pp.file_path, coalesce(c.max_chunk_chars, 2400) AS limit_chars, round(score, 6) AS score FROM b JOIN pp ON pp.docset_slug = b.docset_slug AND pp.id = b.page_id JOIN embeddings_config c ON c.docset_slug = b.docset_slug WHERE c.enabled""")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """The most similar chunks with their pages and the settings of their docset, where it is enabled."""
    best = _chunk_semantic(spark, d).orderBy(F.round("cosine", 9).desc(), "id").limit(200)
    rows = table(spark, d, "pages").withColumn("row", F.struct("title", "file_path"))
    pages = incremental.present_rows(rows, ["docset_slug", "id"], "row").select("docset_slug", F.col("id").alias("page_id"), "row.*")
    config = table(spark, d, "embeddings_config").where("enabled").select("docset_slug", F.coalesce("max_chunk_chars", F.lit(2400)).alias("limit_chars"))
    made = best.join(pages, ["docset_slug", "page_id"]).join(config, "docset_slug")
    return _rounded(made.select("id", "docset_slug", "title", "file_path", "limit_chars", F.col("cosine").alias("score")), "score")


@query(sql_bm25(CHUNKS_SQL, "id, text", ["text"], DOCS_WORDS) + """SELECT * FROM (SELECT 'docset' AS kind, docset_slug AS key, NULL AS snippet FROM (SELECT DISTINCT docset_slug FROM search_chunks) ORDER BY docset_slug LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'hit', id::VARCHAR, text[1:500] FROM ranked ORDER BY round(rank, 9), id LIMIT 4)""")
def session_context(spark: SparkSession, d: str) -> DataFrame:
    """What a session begins with: up to 25 docsets, and the beginnings of the four best hits."""
    known = _chunk_pages(spark, d).select("docset_slug").distinct().orderBy("docset_slug").limit(25)
    best = lexical.top(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS), "id", 4)
    hits = best.join(table(spark, d, "search_chunks", ["id", "text"]).distinct(), "id")
    return known.select(F.lit("docset").alias("kind"), F.col("docset_slug").alias("key"), F.lit(None).cast("string").alias("snippet")).unionByName(hits.select(F.lit("hit").alias("kind"), F.col("id").cast("string").alias("key"), F.substring("text", 1, 500).alias("snippet")))


# states
@query(f"""WITH p AS (SELECT docset_slug, count(DISTINCT id) AS pages FROM pages WHERE docset_slug IN ('brackenlib', 'quarry', 'wicket') GROUP BY 1), e AS (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE model = '{DOCS_MODEL}'),
c AS (SELECT docset_slug, count(DISTINCT id) AS chunks, count(DISTINCT chunk_id) AS vectors FROM search_chunks LEFT JOIN e ON chunk_id = id WHERE docset_slug IN ('brackenlib', 'quarry', 'wicket') GROUP BY 1)
SELECT coalesce(p.docset_slug, c.docset_slug) AS docset_slug, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors FROM p FULL JOIN c ON p.docset_slug = c.docset_slug""")
def docset_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.docset_counts(table(spark, d, "pages"), table(spark, d, "search_chunks"), table(spark, d, "chunk_embeddings"), DOCS_MODEL, DOCS_SCOPE)


STATE_SQL = "SELECT model, count(*) AS vectors, coalesce(strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S.%f'), '') AS updated_at, min(dimensions) AS low, max(dimensions) AS high FROM {0} GROUP BY model"


@query(STATE_SQL.format("(SELECT * FROM unit_embeddings UNION ALL SELECT vec_id, chunk_id::VARCHAR, model, dimensions, NULL, NULL, updated_at FROM chunk_embeddings)"))
def vector_states(spark: SparkSession, d: str) -> DataFrame:
    """Number, latest change and dimensions of the vectors of each model."""
    return store.vector_state(_all_vectors(spark, d), group=("model",))


def _all_vectors(spark: SparkSession, d: str) -> DataFrame:
    columns = ["vec_id", "model", "dimensions", "updated_at"]
    return table(spark, d, "unit_embeddings", columns).unionByName(table(spark, d, "chunk_embeddings", columns))


@query(f"""WITH v AS (SELECT vec_id, model, dimensions, updated_at FROM unit_embeddings UNION ALL SELECT vec_id, model, dimensions, updated_at FROM chunk_embeddings), s AS (SELECT * FROM v WHERE dimensions = 64), o AS (SELECT DISTINCT * FROM s WHERE model LIKE '%-2'),
n AS ({STATE_SQL.format('s')}), m AS ({STATE_SQL.format('o')}) SELECT coalesce(n.model, m.model) AS model, CASE WHEN coalesce(n.vectors, 0) = 0 THEN 'empty' WHEN n.low <> n.high THEN 'mixed' WHEN m.model IS NULL THEN 'missing' WHEN n.vectors = m.vectors AND n.updated_at = m.updated_at THEN 'fresh' ELSE 'stale' END AS state FROM n FULL JOIN m ON n.model = m.model""")
def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    """States of the indexes of all models against what was noted: of second models, before some rows were repeated."""
    now = _all_vectors(spark, d).where("dimensions = 64")
    noted = now.where("model like '%-2'").distinct()
    return store.freshness(store.vector_state(now, group=("model",)), store.vector_state(noted, group=("model",)), "model")


@query("SELECT (SELECT count(*) FROM ((SELECT DISTINCT id FROM code_units EXCEPT SELECT unit_id FROM unit_embeddings) UNION ALL (SELECT unit_id FROM unit_embeddings EXCEPT SELECT id FROM code_units))) = 0 AS equal")
def unit_sets_equal(spark: SparkSession, d: str) -> DataFrame:
    """Whether units and vectors name the same ids."""
    units, named = table(spark, d, "code_units").select("id").distinct(), table(spark, d, "unit_embeddings").select(F.col("unit_id").alias("id")).distinct()
    return spark.createDataFrame([(store.same_rows(units, named, ["id"]),)], "equal boolean")


# maintenance
@query("WITH u AS (SELECT DISTINCT id, file_path, unit_type FROM code_units) SELECT id, file_path, CASE WHEN starts_with(file_path, 'harbor-mono/') THEN 'anew' ELSE unit_type END AS unit_type FROM u")
def replace_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the files of one repository replaced, those of others left alone."""
    units = table(spark, d, "code_units", ["id", "file_path", "unit_type"]).distinct()
    return store.replace_rows(units, units.where(paths.under_prefix(F.col("file_path"), "harbor-mono")).withColumn("unit_type", F.lit("anew")), "file_path")


@query("SELECT f.seq, f.path, coalesce(f.hash, s.hash) AS hash FROM files f LEFT JOIN (SELECT path, max(hash) AS hash FROM source_files GROUP BY path) s ON s.path = f.path")
def backfill_hashes(spark: SparkSession, d: str) -> DataFrame:
    return store.backfilled(table(spark, d, "files", ["seq", "path", "hash"]), table(spark, d, "source_files", ["path", "hash"]), "path", "hash")


@query(f"WITH {PRESENT_FILES_SQL}, f AS (SELECT replace(path, '/store/', '/dist/') AS path FROM pf) SELECT path FROM f WHERE NOT list_has_any(string_split(path, '/'), {EXCLUDED_SQL}) AND len(list_filter(string_split(path, '/'), lambda x: suffix(x, '.egg-info') OR suffix(x, '.dist-info'))) = 0")
def purge_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Tracked files that a scan would still take."""
    tracked = _present_files(spark, d).select(F.replace("path", F.lit("/store/"), F.lit("/dist/")).alias("path"))
    return tracked.where(~paths.is_excluded(F.col("path")))


@query(f"""WITH {PRESENT_FILES_SQL}, s AS (SELECT path, bool_or(contents IS NOT NULL) AS readable FROM source_files WHERE starts_with(path, 'harbor-mono/') GROUP BY path), t AS (SELECT path FROM pf WHERE starts_with(path, 'harbor-mono/')),
c AS (SELECT pf.path FROM pf JOIN (SELECT path, max(hash) AS hash FROM source_files GROUP BY path) n ON n.path = pf.path AND n.hash = pf.hash WHERE status = 'indexed')
SELECT path, 'index' AS action FROM s WHERE readable AND path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'delete' FROM t WHERE path NOT IN (SELECT path FROM s WHERE readable)""")
def reconcile_directory(spark: SparkSession, d: str) -> DataFrame:
    """What a directory needs: to index what isn't indexed as it is, to delete what is tracked and gone."""
    below = paths.under_prefix(F.col("path"), "harbor-mono")
    found = table(spark, d, "source_files").groupBy("path").agg(F.bool_or(F.col("contents").isNotNull()).alias("readable"), F.max("hash").alias("hash"))
    tracked = _present_files(spark, d)
    complete = tracked.where("status = 'indexed'").join(found.select("path", F.col("hash").alias("now")), "path").select("path", (F.col("hash") == F.col("now")).alias("complete"))
    return queueing.reconcile(found.where(below), tracked.select("path"), complete, below)


OUTCOMES_SQL = f"{QUEUE_SQL}, o AS (SELECT event_id AS id, min(value > 20) AS done FROM events WHERE event_id % 2 = 0 GROUP BY 1)"


@query(f"WITH {OUTCOMES_SQL} SELECT q.id, CASE WHEN owner = 'w1' AND NOT done THEN 'pending' ELSE status END AS status, CASE WHEN owner = 'w1' AND NOT done THEN NULL ELSE owner END AS owner FROM q LEFT JOIN o ON o.id = q.id WHERE NOT coalesce(owner = 'w1' AND done, FALSE)")
def queue_finished(spark: SparkSession, d: str) -> DataFrame:
    """The queue after w1 reports on every second item: its own are gone or pending again."""
    outcomes = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") > 20).alias("done"))
    return queueing.finished(_queue(spark, d)[0], "w1", outcomes).select("id", "status", "owner")


@query(f"WITH {QUEUE_SQL} SELECT id, CASE WHEN owner = 'w1' AND id % 2 = 0 THEN now ELSE claimed_at END AS claimed_at FROM q, t WHERE status = 'in_progress'")
def queue_renewed(spark: SparkSession, d: str) -> DataFrame:
    """Claims after w1 renews those of its items whose number is even."""
    rows, now = _queue(spark, d)
    made = queueing.renewed(rows, "w1", rows.where("id % 2 = 0").select("id"), now)
    return made.where("status = 'in_progress'").select("id", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at"))


@query("WITH v AS (SELECT DISTINCT vec_id, unit_id, model FROM unit_embeddings), u AS (SELECT DISTINCT id, file_path FROM code_units) SELECT v.model, u.file_path, count(DISTINCT u.id) AS units FROM v JOIN u ON u.id = v.unit_id WHERE v.model = 'code-embed-2' GROUP BY 1, 2")
def units_of_model(spark: SparkSession, d: str) -> DataFrame:
    """Units with a vector of the model in use, by file."""
    held = table(spark, d, "unit_embeddings").where(F.col("model") == CODE_MODEL).select(F.col("unit_id").alias("id"), "model").distinct()
    return held.join(table(spark, d, "code_units", ["id", "file_path"]).distinct(), "id").groupBy("model", "file_path").agg(F.count_distinct("id").alias("units"))
