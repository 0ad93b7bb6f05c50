"""Queries that write what a sink writes and read it back, with their SQL twins on the source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoss.operators import absa as B
from veridoss.operators import relational as R
from veridoss.operators import validation as V
from veridoss.plans import dossier as D
from veridoss.plans import evidence as P
from veridoss.plans.registry import query, table
from veridoss.sources import archives, readers, writers
from veridoss.sources.workspace import workspace
from veridoss.streaming.resumed import infer_stream


def _written(spark, df, name: str) -> str:
    path = workspace(spark, name)
    df.write.parquet(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS hotel_id, '2020-01-01' AS review_date, CAST(doc_id % 5 + 1 AS DOUBLE) AS rating_normalized_5, length(text) AS n FROM documents")
def scan_reviews(spark, sf):
    """A table of reviews under its declared schema, ids as text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("hotel_id"), F.lit("2020-01-01").alias("review_date"), (F.col("doc_id") % 5 + 1).cast("double").alias("rating_normalized_5"), "text")
    r = readers.reviews(spark, _written(spark, d, "reviews"))
    return r.select("review_id", "hotel_id", "review_date", "rating_normalized_5", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id AS sample_row_position, CAST(doc_id AS VARCHAR) AS review_id, source AS hotel_id, doc_id + 7 AS source_input_row_position, doc_id * 2 AS source_minilm_embedding_row FROM documents")
def scan_mapping(spark, sf):
    """S2."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_row_position"), F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("hotel_id"), (F.col("doc_id") + 7).alias("source_input_row_position"), (F.col("doc_id") * 2).alias("source_minilm_embedding_row"))
    return readers.mapping(spark, _written(spark, d, "mapping"))


@query(f"SELECT review_id, hotel_id, embedding_row, embedding_verified, semantic_cluster_id FROM ({P._F}) WHERE hotel_id IN ('src1', 'src2', 'src3')")
def scan_features(spark, sf):
    """S3: features of some entities, with the names that aliases give."""
    f = P.features(spark, sf).withColumnsRenamed({"embedding_row": "minilm_embedding_row", "embedding_verified": "minilm_verified", "semantic_cluster_id": "cluster_id"})
    got = readers.features(spark, _written(spark, f, "features"), ["src1", "src2", "src3"])
    return got.select("review_id", "hotel_id", "embedding_row", "embedding_verified", "semantic_cluster_id")


@query("SELECT CAST(vec_id AS VARCHAR) AS review_id, len(embedding) AS n, round(CAST(embedding[7] AS DOUBLE), 5) AS s FROM embeddings")
def npz_round_trip(spark, sf):
    """Vectors as npz archives and back, with the method checked."""
    path = workspace(spark, "npz")
    writers.npz(table(spark, sf, "embeddings"), path, "vec_id", "embedding", "minilm", 300)
    got = readers.packed_embeddings(spark, path, "minilm")
    return got.select("review_id", F.size("embedding").cast("long").alias("n"), F.round(F.col("embedding")[6].cast("double"), 5).alias("s"))


def _npz_files(spark, sf) -> str:
    made, path = workspace(spark, "npz"), workspace(spark, "npz-files")
    writers.npz(table(spark, sf, "embeddings"), made, "vec_id", "embedding", "minilm", 20_000, packed=False)
    writers.files(spark.read.parquet(made).withColumn("name", F.concat("first", F.lit(".npz"))), "name", "content", path)
    return path


@query("SELECT CAST(vec_id AS VARCHAR) AS review_id, vec_id AS position, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s FROM embeddings")
def npz_ranges(spark, sf):
    """An npz file as a partitioned source; ranges of its rows are read by tasks of their own."""
    got = archives.npz_rows(spark, _npz_files(spark, sf), "minilm", 64)
    files = got.groupBy("file").agg(F.min(F.col("review_id").cast("long")).alias("first"))
    s = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return got.join(files, "file").select("review_id", (F.col("first") + F.col("position")).alias("position"), F.size("embedding").cast("long").alias("n"), F.round(s, 4).alias("s"))


@query("SELECT 'emb' AS member, count(*) AS rows, max(len(embedding)) AS width, '<f4' AS dtype FROM embeddings UNION ALL SELECT 'review_id', count(*), 0, '<U' FROM embeddings")
def npz_shapes(spark, sf):
    """Shapes and types from headers alone."""
    h = archives.npz_headers(spark, _npz_files(spark, sf)).where("member <> 'method'")
    return h.groupBy("member", F.regexp_replace("dtype", "U.*", "U").alias("dtype")).agg(F.sum(F.col("shape")[0]).alias("rows"), F.max(F.coalesce(F.get("shape", F.lit(1)), F.lit(0))).alias("width"))


@query("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 5) AS x FROM embeddings")
def ordered_embeddings(spark, sf):
    """Vectors opened once, their order asserted against the expected ids."""
    e = table(spark, sf, "embeddings")
    vectors = e.select("vec_id", F.col("vec_id").alias("position"), "embedding", "label")
    return readers.in_order(vectors, e.select("vec_id", F.col("vec_id").alias("position")), "vec_id", "position").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"))


@query("SELECT d.doc_id, round(CAST(e.embedding[2] AS DOUBLE), 5) AS x FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id * 3")
def gathered_rows(spark, sf):
    """Vectors by row number, in any order."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 3).alias("row"))
    return readers.gather(d, v, "row").select("doc_id", F.round(F.col("embedding")[1].cast("double"), 5).alias("x"))


def _text_files(spark, sf, name: str, suffix: str) -> str:
    """One file a nation, with its name as text, made by partition folders of a single file each."""
    path = workspace(spark, name)
    n = table(spark, sf, "nation").select(F.concat(F.col("n_name"), F.lit(suffix)).alias("stem"), F.col("n_name").alias("value"))
    n.repartition("stem").write.partitionBy("stem").text(path)
    return path


_HASHES = "SELECT replace(n_name, ' ', '%20') AS nation, sha256(n_name || chr(10)) AS sha256, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS size_bytes FROM nation"


@query(_HASHES)
def file_manifest(spark, sf):
    """Hashes and sizes of files, written as CSV and read again; excluded names stay out."""
    path = _text_files(spark, sf, "files", "")
    found = writers.manifest(spark, path, r"_SUCCESS|\.crc$")
    out = workspace(spark, "manifest")
    writers.manifest_csv(found, out)
    return readers.hash_manifest(spark, out).select(F.regexp_extract("path", "stem=([^/]+)/", 1).alias("nation"), "sha256", "size_bytes")


@query("SELECT replace(n_name, ' ', '%20') AS nation, CASE WHEN n_name LIKE '%1' THEN 'differs' ELSE 'missing' END AS fault FROM nation WHERE n_name LIKE '%1' OR n_name LIKE '%2'")
def manifest_faults(spark, sf):
    """Files that a manifest names and that are missing or differ."""
    found = writers.manifest(spark, _text_files(spark, sf, "files", ""), r"_SUCCESS|\.crc$")
    name = F.regexp_extract("path", "stem=([^/]+)/", 1)
    stated = found.withColumn("sha256", F.when(name.endswith("1"), "0").otherwise(F.col("sha256")))
    actual = found.where(~name.endswith("2"))
    return writers.verify_manifest(actual, stated).select(name.alias("nation"), "fault")


@query("SELECT source AS hotel_id, name FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1), (VALUES ('reviews.json', 1), ('features.json', 2), ('SOURCE_PROVENANCE.json', 3)) t(name, k) WHERE n % k <> 0")
def required_files(spark, sf):
    """Which of the files that each entity's folder must hold are missing."""
    path = workspace(spark, "sample")
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for n, k in (("reviews.json", 1), ("features.json", 2), ("SOURCE_PROVENANCE.json", 3))])
    wanted = d.select("source", "n", F.explode(names).alias("f")).select("source", "f.name", F.concat_ws("/", "source", "f.name").alias("path"), (F.col("n") % F.col("f.k") == 0).alias("there"))
    writers.files(wanted.where("there").withColumn("content", F.encode(F.lit("{}"), "UTF-8")), "path", "content", path)
    return V.missing_files(spark, path, wanted).select(F.col("source").alias("hotel_id"), "name")


@query("SELECT doc_id, arg_max(b, b) AS batch_no, arg_max(v, b) AS v FROM (SELECT doc_id, 0 AS b, lang AS v FROM documents UNION ALL SELECT doc_id, 1, source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'last' FROM documents WHERE doc_id % 7 = 0) GROUP BY 1")
def latest_checkpoint(spark, sf):
    """Numbered checkpoint parts; the last result of an id wins."""
    path, d = workspace(spark, "parts"), table(spark, sf, "documents")
    writers.checkpoint_part(d.select("doc_id", F.col("lang").alias("v")), path, 0)
    writers.checkpoint_part(d.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("v")), path, 1)
    writers.checkpoint_part(d.where("doc_id % 7 = 0").select("doc_id", F.lit("last").alias("v")), path, 2)
    return B.latest(readers.checkpoints(spark, path), "doc_id", "batch_no", "v").select("doc_id", "batch_no", "v")


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, 'success' AS inference_status, length(text) AS n FROM documents")
def resumed_inference(spark, sf):
    """M5: work in checkpointed parts; a second run finds nothing left to do."""
    path = workspace(spark, "resumed")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "text")
    work = lambda rows: rows.select("review_id", F.lit("success").alias("inference_status"), F.length("text").cast("long").alias("n"))
    B.resumed(spark, d, path, "review_id", work, 3)
    return B.resumed(spark, d, path, "review_id", work, 3)


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, 'success' AS inference_status, length(text) AS n FROM documents")
def streamed_inference(spark, sf):
    """M5: the same as a stream over files, in batches that are done once; a second run finds nothing left to do."""
    source, out = workspace(spark, "texts"), workspace(spark, "streamed")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "text")
    d.repartition(6, "review_id").write.parquet(source)
    work = lambda rows: rows.select("review_id", F.lit("success").alias("inference_status"), F.length("text").cast("long").alias("n"))
    for _ in range(2):
        done = infer_stream(spark, source, "review_id string, text string", work, out, 2)
    return done.drop("batch_no")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def json_lines(spark, sf):
    """Sorted JSON lines, and lines appended to them."""
    path = workspace(spark, "lines")
    writers.json_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_name", path)
    writers.append_json(table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(None).cast("long").alias("n_regionkey")), path)
    kinds = dict(table(spark, sf, "nation").dtypes)
    return spark.read.schema(f"n_nationkey {kinds['n_nationkey']}, n_name string, n_regionkey {kinds['n_regionkey']}").json(path)


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_and_parquet(spark, sf):
    """The same rows as Parquet and as CSV by group; the CSV is read back, and both agree."""
    path = workspace(spark, "both")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    writers.csv_and_parquet(c, path, "c_mktsegment")
    flat = spark.read.schema("c_custkey long, c_acctbal double").option("header", True).option("recursiveFileLookup", True).csv(f"{path}/csv")
    return R.join_one_to_one(spark.read.parquet(f"{path}/parquet").select("c_custkey", "c_mktsegment"), flat, ["c_custkey"], required=True).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT lang || '/' || doc_id || '.json' AS name, doc_id, source FROM documents")
def zip_packages(spark, sf):
    """JSON members in zip archives by group, unpacked where they are read."""
    path = workspace(spark, "zips")
    d = table(spark, sf, "documents").select("lang", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("doc_id", "source")).alias("body"))
    writers.packages(d, path, "lang", "name", "body", 20_000)
    got = readers.unzipped(spark.read.parquet(path), "content", "doc_id long, source string")
    return got.select("name", "document.doc_id", "document.source")


@query("SELECT lang || '/' || doc_id || '.json' AS name, doc_id, source, length(text) AS n FROM documents")
def zip_members(spark, sf):
    """Zip files whose members are planned from the directory at their end and read by ranges."""
    made, path = workspace(spark, "zips"), workspace(spark, "zip-files")
    d = table(spark, sf, "documents").select("lang", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("doc_id", "source", "text")).alias("body"))
    writers.packages(d, made, "lang", "name", "body")
    writers.files(spark.read.parquet(made).withColumn("name", F.concat("package", F.lit("-"), F.substring(F.sha2("content", 256), 1, 16), F.lit(".zip"))), "name", "content", path)
    got = archives.zip_members(spark, path, ".json", 100_000).withColumn("d", F.from_json(F.decode("content", "UTF-8"), "doc_id long, source string, text string"))
    return got.select("name", "d.doc_id", "d.source", F.length("d.text").cast("long").alias("n"))


@query(f"SELECT review_id, hotel_id, semantic_cluster_id FROM ({P._F})")
def document_pair(spark, sf):
    """Full and compact documents under the same stems; the cluster map read from the full ones."""
    path, (heads, records) = workspace(spark, "pair"), P.parts(spark, sf)
    writers.document_pair(D.nested(heads, records), D.compact_parts(heads, records), "hotel_id", path)
    full, compact = (spark.read.parquet(f"{path}/{n}") for n in ("full", "compact"))
    shape = "hotel_id string, review_evidence_records array<struct<review_id:string,semantic_cluster_id:string>>"
    ids = full.select("stem", F.from_json("value", shape).alias("d"))  # before the join: ids are shuffled, not texts
    return readers.cluster_map(ids.join(compact.select("stem"), "stem", "left_semi").select("d.*"))


@query("SELECT DISTINCT r_name AS hotel_id, CASE WHEN r_name IN (SELECT r_name FROM region WHERE r_regionkey < 3) THEN r_name END AS matched FROM region")
def requested_ids(spark, sf):
    """Requested ids from a text file, each once, matched by their exact text."""
    path, r = workspace(spark, "ids"), table(spark, sf, "region")
    r.select(F.concat(F.lit(" "), "r_name").alias("value")).union(r.select(F.col("r_name").alias("value"))).write.text(path)
    return readers.matched_requests(readers.id_list(spark, path), r.where("r_regionkey < 3").select(F.col("r_name").alias("hotel_id")), "hotel_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS input_row_position FROM documents WHERE lang = 'en'")
def numbered_rows(spark, sf):
    """Rows numbered once, as the table is taken in."""
    return readers.with_row_numbers(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, text IS NOT NULL AS has_text, 'none' AS absa_method FROM documents")
def export_columns(spark, sf):
    """The first present of a column's candidate names, else its default."""
    d = table(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    got = readers.export_columns(d, {"review_id": ("review_id", "doc_id"), "review_text": ("review_text", "body", "text"), "absa_method": ("absa_method",)}, {"absa_method": "none"})
    return got.select("review_id", F.col("review_text").isNotNull().alias("has_text"), "absa_method")


@query("SELECT doc_id, coalesce(lang, '?') AS lang, false AS exact_reuse FROM documents")
def defaulted_column(spark, sf):
    """P5: a column that may be absent."""
    return R.with_default(R.with_default(table(spark, sf, "documents").select("doc_id", "lang"), "exact_reuse", False), "lang", "?")


_DEFINED = """SELECT source, n, sha256('{"first_id":' || a || ',"langs":["' || array_to_string(l, '","') || '"],"last_id":' || b || ',"review_count":' || n || ',"source":"' || source || '"}') AS sha
FROM (SELECT source, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY 1)"""


@query(f"SELECT substr(sha256(source), 1, 12) AS stem, CASE WHEN source NOT LIKE '%3' THEN source END AS source, CASE WHEN source NOT LIKE '%3' THEN n END AS review_count, CASE WHEN source NOT LIKE '%3' THEN sha END AS digest, CASE WHEN source LIKE '%3' THEN 'the sample definition does not match its digest' END AS fault FROM ({_DEFINED})")
def signed_definition(spark, sf):
    """A definition for each entity in a JSON file under its own digest, renamed into place.

    Some are changed after they are signed; reading shows which.
    """
    path = workspace(spark, "definitions")
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("review_count"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.array_sort(F.collect_set("lang")).alias("langs"))
    s = writers.signed(d.withColumn("entity", F.col("source")), "entity")
    text = F.decode("content", "UTF-8")
    changed = F.when(text.rlike('"source": "[^"]*3"'), F.regexp_replace(text, '"review_count": ', '"review_count": 1')).otherwise(text)
    writers.files(s.withColumn("content", F.encode(changed, "UTF-8")), "name", "content", path)
    got = readers.signed_definitions(spark, path, "source string, review_count long, sample_definition_sha256 string")
    return got.select(F.regexp_extract("file", "_([0-9a-f]{12})[.]json$", 1).alias("stem"), "definition.source", "definition.review_count", F.col("definition.sample_definition_sha256").alias("digest"), "fault")


_REPORT = """WITH r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), f AS (SELECT lang, count(*) AS documents, sum(n_chars) AS characters FROM documents GROUP BY 1),
t AS (SELECT lang, count(*) AS rows, string_agg('| ' || source || ' | ' || n || ' |' || chr(10), '' ORDER BY source, n) AS body FROM r GROUP BY 1)
SELECT lang, documents, rows, sha256('# Run' || chr(10) || chr(10) || '- characters: ' || characters || chr(10) || '- documents: ' || documents || chr(10) || '- lang: ' || lang || chr(10) || chr(10) || '| source | n |' || chr(10) || '| --- | --- |' || chr(10) || body) AS markdown_sha256,
sha256('{"characters":' || characters || ',"documents":' || documents || ',"lang":"' || lang || '"}') AS json_sha256 FROM f JOIN t USING (lang)"""


@query(_REPORT)
def run_summary(spark, sf):
    """Each language's facts as JSON and, with a table of its sources, as Markdown; both are read again."""
    path, d = workspace(spark, "reports"), table(spark, sf, "documents")
    facts = d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    writers.files(writers.reports(facts, d.groupBy("lang", "source").agg(F.count("*").alias("n")), "lang"), "name", "content", path)
    read = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)[.][a-z]+$", 1).alias("stem"), F.col("path").endswith(".md").alias("md"), "content")
    text = F.decode("content", "UTF-8")
    j = read.where("NOT md").select("stem", F.from_json(text, "lang string, documents long").alias("d"), F.sha2("content", 256).alias("json_sha256"))
    rows = F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith("| "))).cast("long") - 2
    m = read.where("md").select("stem", rows.alias("rows"), F.sha2("content", 256).alias("markdown_sha256"))
    return R.join_one_to_one(j, m, ["stem"], required=True).select("d.lang", "d.documents", "rows", "markdown_sha256", "json_sha256")


def _settings(spark, sf):
    """A YAML file for each language, with its facts as settings and its sources as aspects."""
    path, d = workspace(spark, "settings"), table(spark, sf, "documents")
    aspect = F.concat(F.lit("  - canonical: "), "source", F.lit("\n    aliases: ["), F.concat_ws(", ", "source", F.concat("lang", F.lit("-"), F.col("n").cast("string")), "source", "lang"), F.lit("]\n"))
    by = d.groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.min("source").alias("a"), F.max("source").alias("b"), F.array_join(F.array_sort(F.collect_list(aspect)), "").alias("aspects"))
    n = F.col("n")
    whole = F.format_string("dataset_namespace: %s\nsemantic_similarity_threshold: 0.%d\nrepresentatives_per_cluster: %d\nforbidden_dataset_names: [%s, %s]\nwindows:\n  short: %d\n  long: %d\n%saspects:\n%s", F.upper("lang"), n % 90 + 10, n % 5 + 1, "a", "b", n % 30 + 1, n % 300 + 31, F.when(F.col("lang") == "es", "colour: red\n").otherwise(""), "aspects")
    writers.files(by.select(F.concat("lang", F.lit(".yaml")).alias("name"), F.encode(whole, "UTF-8").alias("content")), "name", "content", path)
    return readers.settings_files(spark, path)


@query("""SELECT lang || '.yaml' AS file, CASE WHEN ok THEN upper(lang) END AS dataset_namespace, CASE WHEN ok THEN CAST('0.' || (n % 90 + 10) AS DOUBLE) END AS similarity_threshold, CASE WHEN ok THEN n % 5 + 1 END AS representatives, CASE WHEN ok THEN 'short=' || (n % 30 + 1) || ',long=' || (n % 300 + 31) END AS windows,
CASE WHEN ok THEN a || ',' || b END AS forbidden, CASE WHEN ok THEN 'complete_linkage' END AS grouping_method, CASE WHEN NOT ok THEN 'unknown settings: [''colour'']' END AS fault FROM (SELECT lang, lang <> 'es' AS ok, count(*) AS n, min(source) AS a, max(source) AS b FROM documents GROUP BY 1)""")
def settings_files(spark, sf):
    """Settings from YAML files with the format's own keys, laid over defaults; an unknown key is a fault of its file."""
    s = F.col("settings")
    windows = F.array_join(F.transform(s["windows"], lambda w: F.concat_ws("=", w["name"], w["days"].cast("string"))), ",")
    return _settings(spark, sf).select("file", s["dataset_namespace"].alias("dataset_namespace"), s["similarity_threshold"].alias("similarity_threshold"), s["representatives_per_cluster"].cast("long").alias("representatives"), windows.alias("windows"), F.array_join(s["forbidden_tokens"], ",").alias("forbidden"), s["grouping_method"].alias("grouping_method"), "fault")


@query("SELECT lang || '.yaml' AS file, source AS canonical, source || ',' || lang || '-' || count(*) || ',' || lang AS aliases FROM documents WHERE lang <> 'es' GROUP BY lang, source")
def aspect_lists(spark, sf):
    """Categories from YAML files, each alias once and in order."""
    return _settings(spark, sf).select("file", F.explode("specs").alias("s")).select("file", "s.canonical", F.array_join("s.aliases", ",").alias("aliases"))
