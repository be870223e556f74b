"""The test tables seen as entries. Expressions that both engines evaluate are written once, as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.graph import shared_folder
from engram.operators.passages import phrase_hits
from engram.operators.search import Index

EPOCH = 1_700_000_000
NOW = EPOCH + 1_000_000


#: Tables of fewer bytes are spread over all cores, as they may be a single row group, which is one task.
SMALL = 64 << 20
_INDEXES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The search index of the documents, kept in the shared folder and made again when their files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, state = fs.listFiles(path, True), []
    while files.hasNext():
        x = files.next()
        state.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(sorted(state)))
    if key not in _INDEXES:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        Index.write(documents(spark, sf_dir), folder, inverted=False)
        _INDEXES[key] = folder
    return Index.read(spark, _INDEXES[key], inverted=False)


#: Column lists that are the same text in either dialect.
TURNS = (
    f"cast(conv_id as string) || '-' || cast(turn as string) AS id, text AS content, {EPOCH} + conv_id * 1000 + turn * 60 AS timestamp, role AS kind, 's' || cast(conv_id % 4 as string) AS scope, "
    "cast(conv_id as string) AS session_id, cast(null as bigint) AS token_count, cast(null as string) AS metadata"
)
DOCUMENTS = (
    f"cast(doc_id as string) AS id, text AS content, {EPOCH} + doc_id * 60 AS timestamp, 'message' AS kind, lang AS scope, source AS session_id, cast(null as bigint) AS token_count, cast(null as string) AS metadata"
)
_MD5 = "md5(cast(event_id as string))"
#: One secret of each kind, and texts that fall short of one by a sign.
SECRETS = f"""'user ' || cast(user_id as string) || ' sent ' || CASE event_id % 13
WHEN 0 THEN 'AKIA' || upper(substr({_MD5}, 1, 16)) WHEN 1 THEN 'ghp_' || {_MD5} || substr({_MD5}, 1, 8) WHEN 2 THEN 'sk-ant-' || {_MD5}
WHEN 3 THEN 'sk-' || substr({_MD5}, 1, 20) || 'T3BlbkFJ' || substr({_MD5}, 9, 20) WHEN 4 THEN 'sk-proj-' || {_MD5} WHEN 5 THEN 'xoxb-' || {_MD5}
WHEN 6 THEN 'M' || substr({_MD5}, 1, 25) || '.' || substr({_MD5}, 1, 6) || '.' || {_MD5} WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {_MD5} || chr(10) || '-----END RSA PRIVATE KEY-----'
WHEN 8 THEN 'eyJ' || {_MD5} || '.' || {_MD5} || '.' || {_MD5} WHEN 9 THEN 'Authorization: ' || {_MD5} || '==' WHEN 10 THEN 'AKIA' || upper(substr({_MD5}, 1, 15)) WHEN 11 THEN 'sk-ant-' || substr({_MD5}, 1, 19)
ELSE 'bearer ' || substr({_MD5}, 1, 19) END || ' at ' || event_type"""
#: Statements of all kinds about users.
STATEMENTS = """CASE event_id % 8
WHEN 0 THEN 'Server ' || cast(user_id as string) || ' is now ' || event_type WHEN 1 THEN 'We chose ' || event_type || ' over Redis because Postgres is slow for user ' || cast(user_id as string)
WHEN 2 THEN 'Do not use ' || event_type || ' for user ' || cast(user_id as string) WHEN 3 THEN 'Should we not use ' || event_type || '?' WHEN 4 THEN 'timeout set to ' || cast(user_id as string) || ' after ' || event_type
WHEN 5 THEN 'confirmed: the ' || event_type || ' of user ' || cast(user_id as string) || ' is right' WHEN 6 THEN 'never again said the one who had been there a long long time ago about ' || event_type
ELSE 'nothing happened with ' || event_type || ' -> ' || cast(user_id as string) END"""
#: Wordings that a lexicon knows, some negated.
WORDINGS = """CASE event_id % 9
WHEN 0 THEN 'I agree with ' || event_type WHEN 1 THEN 'that is not confirmed by ' || cast(user_id as string) WHEN 2 THEN 'Confirmed, we''ll go with ' || event_type WHEN 3 THEN 'never mind, ' || event_type || ' does it'
WHEN 4 THEN 'not so very soon confirmed: ' || event_type WHEN 5 THEN 'it was ' || event_type WHEN 6 THEN 'I was wrong about ' || event_type WHEN 7 THEN 'remember this: don''t forget ' || event_type
ELSE 'it''s hardly a good point by ' || event_type END"""
#: Transcripts with the marks of tools, code, shells and paths.
TRANSCRIPTS = """CASE turn % 4
WHEN 0 THEN '[user]' || chr(10) || text || chr(10) || '[tool_use: shell]' || chr(10) || '{"cmd": "ls"}' || chr(10) || '[tool_result]' || chr(10) || 'seen in src/main.rs and ./run.sh.' || chr(10) || 'end'
WHEN 1 THEN 'Assistant: hello' || chr(10) || '```sh' || chr(10) || 'rm x' || chr(10) || '```' || chr(10) || chr(10) || text || chr(10) || '$ ls -la' || chr(10) || 'me@host:/tmp$ cat x' || chr(10) || 'costs $ 5'
WHEN 2 THEN '{"a": "' || text || text || '"}' || chr(10) || 'short {json}' || chr(10) || 'Read (/etc/hosts), C:/x and docs/a.md; then tell ' || role
ELSE 'user:' || chr(10) || text || chr(10) || '```' || chr(10) || 'open' || chr(10) || '[tool_use' || chr(10) || '[tool_result]' || chr(10) || 'after   two  blanks' END"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "conversations"), TURNS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), DOCUMENTS)


def _select(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {columns} FROM {{rows}}", rows=df)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries (query_id, text, embedding)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def document_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scope, embedding) of documents that have a vector of their number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf_dir, "documents").join(vectors, "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("scope"), "embedding")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item): documents that hold a benchmark passage as it is."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item"), "text")
    return phrase_hits(docs, items).select(F.col("phrase_id").alias("query_id"), "item")
