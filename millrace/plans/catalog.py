"""The engine's operators as named queries over the test tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import RetrievalSettings, Settings
from millrace.functions import scores, text
from millrace.functions.udfs import hashed_terms, rouge_l_udf, token_match_f1_udf
from millrace.operators import cache, cascade, chunking, dedup, evaluate, metrics, promote, prompts, retrieval, sampling, text_quality, tiers, validate
from millrace.operators.providers import Backend, RateLimited
from millrace.sources import readers, sinks
from millrace.storage import modified, scratch_path, spread, table_cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WHITE = r"[ \t\n\x0B\f\r]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments, written apart from the operators


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WHITE}'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', ' ', 'g'), '{WHITE}', ' ', 'g'))"


def _tokens(x: str) -> str:
    return _words(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]', ' ', 'g')")


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\r\n|[\\n\\r\\x0B\\f]'), lambda l: {_strip('l')}), lambda l: l <> '')".replace("\r\n", r"\r\n")


def _sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


# DuckDB's distance counts bytes: letters beyond ASCII are put into one byte each first, which leaves the distance of characters.
_ONE_BYTE = lambda x: f"translate(lower({x}), 'ßàáâäçèéêëíîïñóôöùúûü', '{''.join(map(chr, [*range(1, 9), *range(14, 27)]))}')"


# Roles of the test tables


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "view", "cache").when(F.col("event_type") == "click", "retrieval").when(F.col("event_type") == "error", "none").otherwise("generative")
    backend = F.when(F.col("event_type") == "purchase", "primary").when(F.col("event_type") == "signup", "secondary")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), "ts", tier.alias("answered_by"), (F.pmod("event_id", F.lit(100)) / 100).alias("confidence"), F.col("value").alias("latency_ms"), backend.alias("backend"), "props",
    )


_LOG = """(SELECT event_id AS query_id, ts, CASE event_type WHEN 'view' THEN 'cache' WHEN 'click' THEN 'retrieval' WHEN 'error' THEN 'none' ELSE 'generative' END AS answered_by,
  (event_id % 100) / 100 AS confidence, value AS latency_ms, CASE event_type WHEN 'purchase' THEN 'primary' WHEN 'signup' THEN 'secondary' END AS backend, props FROM events)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the assistant turn after it; the conversation's texts together are the chunk."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("answer"))
    first = c.where("role <> 'assistant'").groupBy(F.col("conv_id").alias("k_conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("chunk"))
    rows = q.join(a, (F.col("conv_id") == F.col("a_conv")) & (F.col("turn") + 1 == F.col("a_turn"))).join(first, F.col("conv_id") == F.col("k_conv"))
    return rows.select("conv_id", "turn", "question", "answer", "chunk")


_PAIRS = """(SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, k.chunk
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user' AND a.role = 'assistant'
  JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS chunk FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) k ON k.conv_id = q.conv_id)"""


def _cache_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole texts: every fifth document's is a cache key, the others' are queries."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    keys = d.where("doc_id % 5 = 0").select(F.col("text").alias("question"), F.concat(F.lit("doc "), F.col("doc_id")).alias("answer"), "source", F.col("doc_id").alias("ordinal"))
    latest = cache.upsert(keys.limit(0), keys)
    return d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), "lang"), latest


_CACHE = "(SELECT text AS question, arg_max('doc ' || doc_id, doc_id) AS answer, arg_max(source, doc_id) AS source, max(doc_id) AS ordinal FROM documents WHERE doc_id % 5 = 0 GROUP BY 1)"
_ASKED_TEXTS = "(SELECT doc_id AS query_id, text AS query, lang FROM documents WHERE doc_id % 5 <> 0)"


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and cache keys: users' turns of even conversations are keys; all users' turns are asked, by conversation as they are, in lower case with a mark, or with their words in reverse, of these some without one or two characters."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    back = F.array_join(F.reverse(text.words(F.col("text"))), " ")
    without = lambda x, at: F.concat(F.substring(x, F.lit(1), at - 1), x.substr(at + 1, F.length(x)))
    place = lambda x, part: F.floor(F.length(x) * part / 12).cast("int") + 1
    one = without(back, place(back, 5))
    said = F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lower("text"), F.lit(" !"))).when(F.col("conv_id") % 9 == 2, back).when(F.col("conv_id") % 9 == 5, one).otherwise(without(one, place(one, 9)))
    keys = c.where("conv_id % 2 = 0").select(F.col("text").alias("question"), F.concat(F.lit("turn "), F.col("query_id")).alias("answer"), F.concat(F.lit("conv "), F.col("conv_id")).alias("source"), F.col("query_id").alias("ordinal"))
    return c.select("query_id", said.alias("query")), cache.upsert(keys.limit(0), keys)


_BACK = f"array_to_string(list_reverse({_words('text')}), ' ')"
_TURNS = f"""(SELECT query_id, CASE WHEN conv_id % 9 = 8 THEN one[1:length(one) * 9 // 12] || one[length(one) * 9 // 12 + 2:] WHEN conv_id % 9 = 5 THEN one ELSE query END AS query
  FROM (SELECT *, query[1:length(query) * 5 // 12] || query[length(query) * 5 // 12 + 2:] AS one
  FROM (SELECT conv_id, conv_id * 1000 + turn AS query_id, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN lower(text) || ' !' ELSE {_BACK} END AS query FROM conversations WHERE role = 'user')))"""
_TURN_KEYS = """(SELECT text AS question, arg_max('turn ' || (conv_id * 1000 + turn), conv_id * 1000 + turn) AS answer, arg_max('conv ' || conv_id, conv_id * 1000 + turn) AS source, max(conv_id * 1000 + turn) AS ordinal
  FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1)"""


# Text


@query(f"SELECT doc_id, {_norm('text')} AS norm, len({_words('text')})::INTEGER AS n_words, CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END AS shown FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(c).alias("norm"), text.word_count(c).alias("n_words"), text.truncate(c, 80).alias("shown"))


@query(f"SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens, count(DISTINCT t) AS n_kinds FROM (SELECT lang, doc_id, unnest({_tokens('text')}) AS t FROM documents) GROUP BY lang")
def text_tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(text.tokenize(F.col("text"))).alias("t"))
    return tokens.groupBy("lang").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_tokens"), F.count_distinct("t").alias("n_kinds"))


@query(
    rf"""SELECT doc_id, length(cleaned) AS n_clean, cleaned FROM (SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \t\x0B\f\r]*\.{4,}[ \t\x0B\f\r]*[0-9]+\s*$', '', 'g'), '(?m)^3GPP TS [0-9]+\.[0-9]+.*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")} AS cleaned FROM documents)"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text_quality.clean_text(F.col("text")).alias("cleaned"))
    return rows.select("doc_id", F.length("cleaned").cast("long").alias("n_clean"), "cleaned")


_QUALITY = rf"""(SELECT *, {_strip('text')} AS s, replace({_strip('text')}, ' ', '') AS solid, {_lines('text')} AS ls FROM documents)"""
_DENSE = r"""(length(s) >= 150 AND length(solid) > 0 AND length(solid) - length(replace(solid, '.', '')) <= 0.15 * length(solid)
  AND length(solid) - length(regexp_replace(solid, '[0-9]', '', 'g')) <= 0.60 * length(solid)
  AND len(list_filter(ls, lambda l: regexp_matches(l, '[\p{L}\p{N}_][ \t]+[0-9]{1,4}$'))) <= 0.40 * len(ls))"""
_REFERENCES = r"""(len(ls) > 0 AND len(list_filter(ls, lambda l: regexp_matches(l, '^\[[0-9]+\]') OR regexp_matches(l, '3GPP TS [0-9][0-9]\.[0-9][0-9][0-9]'))) > 0.40 * len(ls))"""
_BOILERPLATE = "(contains(text, 'All rights reserved') OR contains(text, 'Organizational Partners') OR contains(text, 'Postal address') OR contains(text, 'Internet http://') OR contains(text, 'shall not be construed'))"
_REASON = f"CASE WHEN NOT {_DENSE} THEN 'density' WHEN {_REFERENCES} THEN 'references' WHEN {_BOILERPLATE} THEN 'boilerplate' END"


@query(f"SELECT doc_id, {_DENSE} AS is_dense, {_REFERENCES} AS is_references, {_BOILERPLATE} AS is_boilerplate FROM {_QUALITY}")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text_quality.is_dense(c).alias("is_dense"), text_quality.is_references(c).alias("is_references"), text_quality.is_boilerplate(c).alias("is_boilerplate"))


@query(
    f"""SELECT source, count(*) AS n_in, count(*) FILTER (reason = 'density') AS n_density, count(*) FILTER (reason = 'front_matter') AS n_front_matter, count(*) FILTER (reason = 'references') AS n_references,
  count(*) FILTER (reason = 'boilerplate') AS n_boilerplate, count(*) FILTER (reason IS NULL) AS n_kept FROM (SELECT source, {_REASON} AS reason FROM {_QUALITY}) GROUP BY source"""
)
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.drop_counts(table(spark, sf_dir, "documents").select("source", text_quality.drop_reason(F.col("text")).alias("reason")), "source")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, chunk, drop front matter and the rest, number what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text_quality.clean_text(F.col("text")).alias("text"))
    # The chunks are read several times below: they meet the rest through a checkpoint.
    parts = dedup.cut(chunking.chunks(docs, "doc_id", "text").withColumnRenamed("doc_id", "doc"))
    start = text_quality.body_start(parts)
    rows = parts.join(start, "doc").withColumn("reason", text_quality.drop_reason(F.col("chunk"), F.col("idx") < F.col("start"))).where("reason is null")
    rows = dedup.cut(rows.select("doc", "idx", "chunk"))
    return sampling.running_ids(rows, "real_%05d", 0, "doc", "idx").select("id", "doc", "idx", F.length("chunk").alias("char_count"))


@query("SELECT source, count(*) AS n, list(n_chars ORDER BY n_chars)[count(*) // 4 + 1] AS p25, list(n_chars ORDER BY n_chars)[count(*) // 2 + 1] AS p50, list(n_chars ORDER BY n_chars)[3 * count(*) // 4 + 1] AS p75 FROM documents GROUP BY source")
def char_count_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank_quartiles(table(spark, sf_dir, "documents"), "n_chars", "source")


# Retrieval

_BM25_PARTS = """dl AS (SELECT doc_id, len(toks) AS dl FROM {p}t), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS w FROM {p}t) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM {p}tf GROUP BY w)"""


def _bm25_sql(p: str, column: str, k: int) -> str:
    parts = f"{p}t AS (SELECT doc_id, {_tokens(column)} AS toks FROM documents), " + _BM25_PARTS.replace("{p}", p).replace("dl AS (SELECT doc_id", f"{p}dl AS (SELECT doc_id").replace(", st AS", f", {p}st AS").replace("\ntf AS", f"\n{p}tf AS").replace(", df AS (", f", {p}df AS (")
    return f"""{parts}, {p}q AS (SELECT item_id AS query_id, unnest({_tokens("text")}) AS w FROM benchmark),
{p}s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM {p}q JOIN {p}df USING (w) JOIN {p}tf USING (w) JOIN {p}dl USING (doc_id), {p}st GROUP BY ALL),
{p}hits AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM {p}s WHERE score > 0) WHERE rank < {k})"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql('', 'text', 20)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.bm25_search(_index(spark, sf_dir), _asked(spark, sf_dir), 20))


@query(f"SELECT w AS token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS w FROM documents) GROUP BY w")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings().groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_DOT = "list_sum(list_transform(range(1, {n}), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))"


_DENSE_SQL = f"""SELECT query_id, doc_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_DOT.replace('{n}', '65')} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.replace('{n}', '65')}, 9) DESC, v.vec_id) - 1 AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank < 20"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_DENSE_SQL})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return _rounded(retrieval.dense(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), v, 20, exclude_self=True))


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_DENSE_SQL})")
def dense_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a clustered index written once and loaded."""
    path = scratch_path(spark, "saved-vectors")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    retrieval.dense_index(v, path)
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return _rounded(retrieval.dense_search(asked, retrieval.load_dense_index(spark, path), 20, exclude_self=True))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, count(*) OVER () AS n FROM embeddings WHERE vec_id IS NOT NULL")
def dense_index_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a dense index are numbered without a gap."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    index = retrieval.dense_index(v)
    return index.vectors.select("ordinal").crossJoin(F.broadcast(index.clusters.agg(F.sum("n").alias("n"))))  # one row


def _encode(c: Column) -> Column:
    return hashed_terms(text.tokenize(c))


def _searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, retrieval.Index, DataFrame]:
    """The benchmark's whole texts as queries, the documents, their sparse index, and their vectors by hashed terms."""
    docs = table(spark, sf_dir, "documents")
    return _asked(spark, sf_dir), docs, _index(spark, sf_dir), _once(spark, sf_dir, "vectors", lambda path: spread(docs.select("doc_id", "text")).select("doc_id", _encode(F.col("text")).alias("v")).write.parquet(path), spark.read.parquet)


_written: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, write: Callable[[str], object], load: Callable[[str], object]):
    """What is made of the documents, written once for a session and state of the table, and loaded by each query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, what, modified(spark, f"{sf_dir}/documents.parquet"))
    path = _written.get(key)
    if path is None or not modified(spark, path):
        path = scratch_path(spark, what)
        write(path)
        _written[key] = path
    return load(path)


def _index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    docs = table(spark, sf_dir, "documents")
    return _once(spark, sf_dir, "index", lambda path: retrieval.bm25_index(docs, path=path, lists=False), lambda path: retrieval.load_index(spark, path))


def _vectors_sql(name: str, key: str, source: str, column: str = "text") -> str:
    """Normalised sums of signed terms by dimension."""
    return f"""{name} AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (SELECT id, ('0x' || md5(w)[1:2])::INT % 64 AS dim, sum(CASE WHEN ('0x' || md5(w)[3:3])::INT >= 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
  FROM (SELECT {key} AS id, unnest({_tokens(column)}) AS w FROM {source}) GROUP BY ALL))"""


def _near_sql(name: str, source: str, key: str, column: str, k: int = 20) -> str:
    return f"""{_vectors_sql(f'{name}_d', 'doc_id', 'documents')}, {_vectors_sql(f'{name}_q', key, source, column)},
{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM
  (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS score FROM {name}_q q JOIN {name}_d d USING (dim) GROUP BY ALL)) WHERE rank < {k})"""


_FUSED = """fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, doc_id) - 1 AS rank FROM
  (SELECT query_id, doc_id, sum(1.0 / (60 + rank + 1)) AS score, min({'l': l, 'r': rank}) AS seen FROM (SELECT *, 0 AS l FROM one UNION ALL SELECT *, 1 FROM two) GROUP BY ALL))"""
_BOTH = f"{_bm25_sql('', 'text', 20)}, one AS (SELECT * FROM hits), {_near_sql('two', 'benchmark', 'item_id', 'text')}, {_FUSED}"


@query(f"WITH {_BOTH} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused WHERE rank < 10")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _, index, vectors = _searches(spark, sf_dir)
    near = retrieval.dense(asked.select("query_id", _encode(F.col("query")).alias("q")), vectors, 20)
    hits = retrieval.fuse([retrieval.bm25_search(index, asked, 20), near], 60, 10)
    return hits.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


_LEXICAL = f"(CASE WHEN len(list_distinct({_tokens('query')})) > 0 THEN 4.0 * len(list_intersect(list_distinct({_tokens('query')}), {_tokens('text')})) / len(list_distinct({_tokens('query')})) - 2.0 ELSE -2.0 END)"


def _rerank_sql(name: str, hits: str, k: int, asked: str = "(SELECT item_id AS query_id, text AS query FROM benchmark)") -> str:
    return f"""{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM
  (SELECT h.query_id, h.doc_id, {_LEXICAL} AS score FROM {hits} h JOIN documents USING (doc_id) JOIN {asked} USING (query_id))) WHERE rank < {k})"""


@query(f"WITH {_bm25_sql('', 'text', 20)}, {_rerank_sql('reranked', 'hits', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM reranked")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    return _rounded(retrieval.rerank(retrieval.bm25_search(_index(spark, sf_dir), asked, 20), asked, docs, 10))


@query(f"WITH {_bm25_sql('', 'text', 5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits")
def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written once, loaded, and searched."""
    path = scratch_path(spark, "saved-index")
    retrieval.bm25_index(table(spark, sf_dir, "documents"), path=path)
    return _rounded(retrieval.bm25_search(retrieval.load_index(spark, path), _asked(spark, sf_dir), 5))


_HYBRID = f"WITH {_BOTH}, top AS (SELECT * FROM fused WHERE rank < 10), {_rerank_sql('reranked', 'top', 5)}"


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, docs, index, vectors = _searches(spark, sf_dir)
    return retrieval.hybrid(asked, index, vectors, docs, _encode, RetrievalSettings())


@query(f"{_HYBRID} SELECT query_id, doc_id AS best_doc_id, round(score, 6) AS logit, round({_sigmoid('score')}, 6) AS confidence, score >= 0.2 AS passed FROM reranked WHERE rank = 0")
def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sparse and dense hits fused, reranked and gated for a batch of queries."""
    g = retrieval.gate(_hybrid(spark, sf_dir), RetrievalSettings().min_rerank_score)
    return g.select("query_id", "best_doc_id", F.round("logit", 6).alias("logit"), F.round("confidence", 6).alias("confidence"), "passed")


@query(f"{_HYBRID} SELECT query_id, string_agg(doc_id::VARCHAR || ':' || md5(text[1:800]), ',' ORDER BY rank) AS found FROM reranked JOIN documents USING (doc_id) WHERE rank < 3 GROUP BY query_id")
def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.candidates(_hybrid(spark, sf_dir), table(spark, sf_dir, "documents"))
    return c.select("query_id", F.array_join(F.transform("candidates", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), F.md5(x["answer"].cast("binary")))), ",").alias("found"))


@query(
    f"""WITH {_BOTH}, top AS (SELECT * FROM fused WHERE rank < 10), {_rerank_sql('reranked', 'top', 10)}, every AS (SELECT 'bm25' AS config, query_id, doc_id, rank FROM one UNION ALL SELECT 'dense', query_id, doc_id, rank FROM two
  UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM top UNION ALL SELECT 'rrf+rerank', query_id, doc_id, rank FROM reranked),
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), cnt AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
per AS (SELECT config, e.query_id, count(*) FILTER (r.doc_id IS NOT NULL AND rank < 1) AS h1, count(*) FILTER (r.doc_id IS NOT NULL AND rank < 5) AS h5, min(CASE WHEN r.doc_id IS NOT NULL THEN rank END) AS f
  FROM every e LEFT JOIN rel r ON e.query_id = r.query_id AND e.doc_id = r.doc_id GROUP BY ALL)
SELECT config, round(avg(coalesce(h1 / n, 0)), 6) AS recall_1, round(avg(coalesce(h5 / n, 0)), 6) AS recall_5, round(avg(coalesce(1 / (f + 1), 0)), 6) AS mrr, count(*) AS n_queries FROM per LEFT JOIN cnt USING (query_id) GROUP BY config"""
)
def recall_mrr_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse, dense, fused and reranked hits; a document is relevant if it holds the whole query."""
    asked, docs, index, vectors = _searches(spark, sf_dir)
    sparse = table_cut(retrieval.bm25_search(index, asked, 20), "sparse")
    near = table_cut(retrieval.dense(asked.select("query_id", _encode(F.col("query")).alias("q")), vectors, 20), "dense")
    fused = table_cut(retrieval.fuse([sparse, near], 60, 10), "fused")
    configs = {"bm25": sparse, "dense": near, "rrf": fused, "rrf+rerank": table_cut(retrieval.rerank(fused, asked, docs, 10), "reranked")}
    # The benchmark is the stated set of queries, against all documents.
    relevant = table_cut(retrieval.containing(asked, docs, index), "relevant")
    out = retrieval.ablation(configs, relevant)
    return out.select("config", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")], "n_queries")


@query(f"SELECT event_id, round({_sigmoid('(value - 50) / 20')}, 6) AS confidence, round(0.85 + 0.10 * (least(100, 90 + event_id % 10) - 90) / 10, 3) AS fuzzy FROM events")
def sigmoid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.lit(100.0), 90 + F.pmod("event_id", F.lit(10)))
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.confidence_of((F.col("value") - 50) / 20), 6).alias("confidence"), scores.fuzzy_confidence(score, 90.0).alias("fuzzy"))


# Cache and cascade


@query(f"SELECT query_id, question AS matched_key, answer, c.source FROM {_ASKED_TEXTS} q JOIN {_CACHE} c ON {_strip('query')} = question")
def cache_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, keys = _cache_roles(spark, sf_dir)
    return cache.exact_lookup(asked, keys)


_NORM_INDEX = f"(SELECT {_norm('question')} AS norm, arg_max(question, ordinal) AS question, arg_max(answer, ordinal) AS answer, arg_max(source, ordinal) AS source FROM {_CACHE} GROUP BY 1)"


@query(f"SELECT query_id, question AS matched_key, answer, n.source FROM {_ASKED_TEXTS} q JOIN {_NORM_INDEX} n ON {_norm('query')} = norm")
def cache_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, keys = _cache_roles(spark, sf_dir)
    return cache.normalized_lookup(asked, keys)


_TURN_INDEX = f"(SELECT {_norm('question')} AS norm, arg_max(question, ordinal) AS question, arg_max(answer, ordinal) AS answer, arg_max(source, ordinal) AS source FROM {_TURN_KEYS} GROUP BY 1)"
# Scores from the definition: the common tokens against each side, and what differs by its longest common subsequence, a bit for each
# character of one side in four numbers of 120 bits (more is an error). Where the counts of characters or of neighbours leave a pair below 90, no subsequence is sought.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 ßàáâäçèéêëíîïñóôöùúûü"
_LESS = f"list_sum(list_transform(string_split('{_LETTERS}', ''), lambda x: least(length(ls) - length(replace(ls, x, '')), length(rs) - length(replace(rs, x, ''))))) + least(length(translate(ls, '{_LETTERS}', '')), length(translate(rs, '{_LETTERS}', '')))"
_FULL = "1329227995784915872903807060280344576::HUGEINT"  # 2 to the 120th


def _lcs_sql() -> str:
    """``ls`` and ``rs``: for each character of rs, the sum of the bits that aren't matched yet and those that match it carries over from number to number."""
    limb = lambda j: f"coalesce(list_sum(list_transform(range(120), lambda i: CASE WHEN ls[i + {120 * j + 1}] = x THEN pow(2, i)::HUGEINT ELSE 0::HUGEINT END)), 0)::HUGEINT"
    at = lambda v, z: f"({v} & {z})"
    total, new = "0::HUGEINT", []
    for j in range(1, 5):
        total = f"(v[{j}] + {at(f'v[{j}]', f'z[{j}]')} + {total if j == 1 else f'{total} // {_FULL}'})"
        new.append(f"(({total} % {_FULL}) | (v[{j}] - {at(f'v[{j}]', f'z[{j}]')}))")
    start = ", ".join(f"pow(2, greatest(0, least(120, length(ls) - {120 * j})))::HUGEINT - 1" for j in range(4))
    within = [f"({x} & (pow(2, greatest(0, least(120, length(ls) - {120 * j})))::HUGEINT - 1))" for j, x in enumerate(new)]
    steps = f"list_transform(string_split(rs, ''), lambda x: [{', '.join(limb(j) for j in range(4))}])"
    left = f"list_sum(list_transform(list_reduce(list_prepend([{start}], {steps}), lambda v, z: [{', '.join(within)}]), lambda k: bit_count(k)))"
    return f"CASE WHEN length(ls) > 480 THEN error('too long') ELSE length(ls) - {left} END"


_LCS = _lcs_sql()
_LOOKED_UP = f"""asked AS (SELECT * FROM {_TURNS}), idx AS (SELECT *, list_distinct({_words('norm')}) AS kt FROM {_TURN_INDEX}), qn AS (SELECT query_id, list_distinct({_words(_norm('query'))}) AS qt FROM asked),
duo AS (SELECT query_id, question, answer, i.source, list_intersect(qt, kt) AS b, list_sort(list_filter(qt, lambda x: NOT list_contains(kt, x))) AS l, list_sort(list_filter(kt, lambda x: NOT list_contains(qt, x))) AS r FROM qn JOIN idx i ON len(qt) > 0 AND len(kt) > 0),
sized AS (SELECT *, array_to_string(l, ' ') AS ls, array_to_string(r, ' ') AS rs, length(array_to_string(b, ' ')) AS c, length(array_to_string(list_concat(b, l), ' ')) AS n, length(array_to_string(list_concat(b, r), ' ')) AS m, CASE WHEN len(b) > 0 THEN 1 ELSE 0 END AS s FROM duo),
cand AS (SELECT row_number() OVER () AS pid, * FROM sized WHERE 200 * (c + s + {_LESS}) >= 90 * (n + m)),
twos AS (SELECT pid, unnest(list_transform(range(1, length(ls) + 2), lambda i: (' ' || ls || ' ')[i:i + 1])) AS g, 1 AS k FROM cand UNION ALL SELECT pid, unnest(list_transform(range(1, length(rs) + 2), lambda i: (' ' || rs || ' ')[i:i + 1])), -1 FROM cand),
apart AS (SELECT pid, sum(abs(k)) AS apart FROM (SELECT pid, g, sum(k) AS k FROM twos GROUP BY 1, 2) GROUP BY 1),
close AS (SELECT query_id, question, answer, source, 200 * (c + s + {_LCS}) / (n + m) AS score FROM cand JOIN apart USING (pid) WHERE apart <= 0.3 * (n + m)),
scored AS (SELECT query_id, question, answer, source, CASE WHEN s = 1 AND (len(l) = 0 OR len(r) = 0) THEN 100 ELSE greatest(200 * s * c / (c + n), 200 * s * c / (c + m)) END AS score FROM sized UNION ALL SELECT * FROM close),
fz AS (SELECT query_id, arg_min({{'question': question, 'answer': answer, 'source': source, 'score': score}}, (-round(score, 9), question)) AS k FROM scored WHERE score >= 90 GROUP BY 1),
looked AS (SELECT a.query_id, CASE WHEN e.answer IS NOT NULL THEN 'exact' WHEN n.answer IS NOT NULL THEN 'normalized' WHEN fz.k IS NOT NULL THEN 'fuzzy' END AS match_type, coalesce(e.question, n.question, fz.k.question) AS matched_key,
  coalesce(e.answer, n.answer, fz.k.answer) AS answer, coalesce(e.source, n.source, fz.k.source) AS source,
  CASE WHEN e.answer IS NOT NULL THEN 1.0 WHEN n.answer IS NOT NULL THEN 0.95 WHEN fz.k IS NOT NULL THEN round(0.85 + 0.10 * (least(fz.k.score, 100) - 90) / 10, 3) ELSE 0 END::DOUBLE AS confidence
  FROM asked a LEFT JOIN {_TURN_KEYS} e ON {_strip('query')} = e.question LEFT JOIN {_TURN_INDEX} n ON {_norm('query')} = n.norm LEFT JOIN fz ON a.query_id = fz.query_id)"""


@query(f"WITH {_LOOKED_UP} SELECT * FROM looked")
def cache_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three steps of the lookup: users' turns, as they are, changed and reversed, against those of even conversations."""
    return cache.lookup(*_turns(spark, sf_dir))


def _length_of(prompt: str) -> str:
    """An offline backend that says how long its prompt is, and is busy for every fifth length."""
    if len(prompt) % 5 == 0:
        raise RateLimited("busy")
    return f"answer to {len(prompt)} characters"


def _second(prompt: str) -> str:
    """Another, busy for every third length."""
    if len(prompt) % 3 == 0:
        raise RateLimited("busy")
    return f"second answer to {len(prompt)}"


_BACKENDS = (Backend("primary", _length_of), Backend("secondary", _second))


def _tiers(spark: SparkSession, sf_dir: str, keys: DataFrame) -> list[cascade.Tier]:
    _, docs, index, vectors = _searches(spark, sf_dir)
    return tiers.build(Settings(), keys, tiers.searcher(index, vectors, docs, _encode), docs, _BACKENDS)


def _tiers_sql(asked: str, looked: str) -> str:
    """Results of the tiers for ``asked`` (query_id, query), of which ``looked`` (query_id, answer, confidence) is the cache's part."""
    said = lambda n: f"CASE WHEN {n} % 5 <> 0 THEN 'answer to ' || {n} || ' characters' WHEN {n} % 3 <> 0 THEN 'second answer to ' || {n} END"
    by = lambda n: f"CASE WHEN {n} % 5 <> 0 THEN 'primary' WHEN {n} % 3 <> 0 THEN 'secondary' END"
    line = "chr(10)"
    return f"""pending AS (SELECT query_id, query FROM {asked} JOIN {looked} USING (query_id) WHERE answer IS NULL OR confidence < 0.85),
{_bm25_sql('', 'text', 20).replace(f'SELECT item_id AS query_id, unnest({_tokens("text")}) AS w FROM benchmark', f'SELECT query_id, unnest({_tokens("query")}) AS w FROM pending')}, one AS (SELECT * FROM hits),
{_near_sql('two', 'pending', 'query_id', 'query')}, {_FUSED}, top AS (SELECT * FROM fused WHERE rank < 10), {_rerank_sql('reranked', 'top', 5, 'pending')},
shown AS (SELECT query_id, max(CASE WHEN rank = 0 THEN score END) AS logit, max(CASE WHEN rank = 0 THEN doc_id END) AS best_doc_id,
  string_agg('[' || CASE WHEN coalesce(source, '') = '' THEN 'unknown spec' ELSE source END || ', chunk ' || doc_id || ']:' || {line} || text, {line} || {line} ORDER BY rank) AS body,
  list(text[1:800] ORDER BY rank) FILTER (rank < 3 AND text <> '') AS parts FROM reranked JOIN documents USING (doc_id) GROUP BY 1),
synth AS (SELECT query_id, query, parts, best_doc_id, logit, coalesce({_sigmoid('logit')}, 0) AS conf, CASE WHEN logit >= 0.2 THEN length(body || {line} || {line} || 'Question: ' || query) END AS n FROM pending LEFT JOIN shown USING (query_id)),
two_said AS (SELECT *, {said('n')} AS said, {by('n')} AS by FROM synth),
kept AS (SELECT query_id, parts, query, (SELECT count(*) FROM (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE list_sum(list_transform(parts[1:i], lambda x: length(x))) <= 2000) AS m FROM two_said WHERE said IS NULL OR conf < 0.5),
ask AS (SELECT query_id, length(CASE WHEN coalesce(m, 0) = 0 THEN query ELSE 'Context:' || {line} || array_to_string(parts[1:m], {line} || {line} || '---' || {line}) || {line} || {line} || 'Question: ' || query END) AS n FROM kept),
routed AS (SELECT a.query_id, CASE WHEN l.answer IS NOT NULL AND l.confidence >= 0.85 THEN l.answer WHEN k.query_id IS NULL THEN t.said ELSE coalesce({said('k.n')}, 'No backend was able to generate an answer.') END AS answer,
  CASE WHEN l.answer IS NOT NULL AND l.confidence >= 0.85 THEN 'cache' WHEN k.query_id IS NULL THEN 'retrieval' ELSE 'generative' END AS answered_by,
  round(CASE WHEN l.answer IS NOT NULL AND l.confidence >= 0.85 THEN l.confidence WHEN k.query_id IS NULL THEN t.conf WHEN {said('k.n')} IS NULL THEN 0 ELSE 0.6 END, 6)::DOUBLE AS confidence,
  CASE WHEN l.answer IS NOT NULL AND l.confidence >= 0.85 THEN 'cache' WHEN k.query_id IS NULL THEN 'cache>retrieval' ELSE 'cache>retrieval>generative' END AS trace,
  CASE WHEN l.answer IS NOT NULL AND l.confidence >= 0.85 THEN NULL WHEN k.query_id IS NULL THEN t.by ELSE {by('k.n')} END AS backend
  FROM {asked} a JOIN {looked} l USING (query_id) LEFT JOIN two_said t USING (query_id) LEFT JOIN ask k USING (query_id))"""


@query(f"WITH {_LOOKED_UP}, {_tiers_sql('asked', 'looked')} SELECT query_id, answer, answered_by, confidence, trace FROM routed")
def cascade_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tiers over whole questions: cache, gated synthesis from hybrid search, generation from what was found."""
    asked, keys = _turns(spark, sf_dir)
    rows = cascade.route(asked, _tiers(spark, sf_dir, keys))
    return rows.select("query_id", "answer", "answered_by", F.round("confidence", 6).alias("confidence"), F.array_join("tier_trace", ">").alias("trace"))


@query(
    f"""WITH items AS (SELECT item_id AS query_id, text AS query FROM benchmark), missed AS (SELECT query_id, NULL::VARCHAR AS answer, 0.0::DOUBLE AS confidence FROM items), {_tiers_sql('items', 'missed')}
SELECT query_id::VARCHAR AS query_id, answered_by, 'retrieval' AS expected_tier, answered_by = 'retrieval' AS tier_match, confidence, backend FROM routed"""
)
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's whole texts as eval items through all tiers, with a cache that knows none of them."""
    items = _asked(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "query", F.col("query").alias("reference"), F.lit("retrieval").alias("expected_tier"))
    out = evaluate.run(items, _tiers(spark, sf_dir, _turns(spark, sf_dir)[1].limit(0)))
    return out.select("query_id", "answered_by", "expected_tier", "tier_match", F.round("confidence", 6).alias("confidence"), "backend")


@query(f"SELECT count(*) AS n, (sum(len({_words('answer')})) // greatest(count(*), 1))::BIGINT AS words_mean, count(DISTINCT source) AS n_sources FROM {_CACHE}")
def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cache_summary(_cache_roles(spark, sf_dir)[1], text.word_count(F.col("answer")))


@query(f"SELECT question, answer FROM {_CACHE} WHERE contains(lower(question), 'the') OR contains(lower(answer), 'the')")
def cache_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cache_search(_cache_roles(spark, sf_dir)[1], "The").select("question", "answer")


# Evaluation and log


@query(f"SELECT tier, count(query_id) AS n, round(100.0 * count(query_id) / (SELECT count(*) FROM events), 1) AS pct FROM (VALUES ('cache'), ('retrieval'), ('generative'), ('none')) t(tier) LEFT JOIN {_LOG} ON answered_by = tier GROUP BY tier")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tier_distribution(_log(spark, sf_dir))


_LATENCY = "round(quantile_cont(latency_sec, 0.50), 4) AS p50, round(quantile_cont(latency_sec, 0.95), 4) AS p95, round(quantile_cont(latency_sec, 0.99), 4) AS p99, round(avg(latency_sec), 4) AS latency_mean, round(min(latency_sec), 4) AS latency_min, round(max(latency_sec), 4) AS latency_max"


@query(
    f"""SELECT coalesce(answered_by, 'overall') AS tier, round(avg(rouge_l), 4) AS rouge_l_mean, round(median(rouge_l), 4) AS rouge_l_median, round(avg(match_f1), 4) AS match_mean, round(median(match_f1), 4) AS match_median,
  {_LATENCY}, count(*) AS n FROM (SELECT answered_by, confidence AS rouge_l, (query_id % 97) / 97 AS match_f1, latency_ms AS latency_sec FROM {_LOG}) GROUP BY ROLLUP (answered_by)"""
)
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluation(_log(spark, sf_dir).select("answered_by", F.col("confidence").alias("rouge_l"), (F.pmod("query_id", F.lit(97)) / 97).alias("match_f1"), F.col("latency_ms").alias("latency_sec")))


@query(f"SELECT event_type, {_LATENCY} FROM (SELECT event_type, value AS latency_sec FROM events) GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query(f"SELECT backend, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct, sum(count(*)) OVER ()::BIGINT AS n_llm_calls FROM {_LOG} WHERE backend IS NOT NULL GROUP BY backend")
def backend_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.backend_distribution(_log(spark, sf_dir))


@query(
    f"""SELECT count(*) AS n, round(avg(confidence), 6) AS confidence_mean, round(avg(latency_ms), 6) AS latency_ms_mean, count(*) FILTER (answered_by = 'cache') AS n_cache, count(*) FILTER (answered_by = 'retrieval') AS n_retrieval,
  count(*) FILTER (answered_by = 'generative') AS n_generative, count(*) FILTER (answered_by = 'none') AS n_none, round(100.0 * count(*) FILTER (answered_by = 'cache') / count(*), 1) AS cache_pct FROM {_LOG}"""
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.log_summary(_log(spark, sf_dir))
    return out.withColumn("confidence_mean", F.round("confidence_mean", 6)).withColumn("latency_ms_mean", F.round("latency_ms_mean", 6))


@query(f"SELECT query_id, answered_by, confidence FROM {_LOG} WHERE answered_by = 'generative' AND confidence < 0.65")
def log_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.log_misses(_log(spark, sf_dir)).select("query_id", "answered_by", "confidence")


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, answered_by, count(*) AS n, round(avg(latency_ms), 6) AS latency_ms_mean FROM {_LOG} GROUP BY 1, 2")
def log_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.log_by_hour(_log(spark, sf_dir))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "answered_by", "n", F.round("latency_ms_mean", 6).alias("latency_ms_mean"))


@query(f"(SELECT 'first' AS kind, query_id FROM {_LOG} ORDER BY ts, query_id LIMIT 20) UNION ALL (SELECT 'recent', query_id FROM {_LOG} ORDER BY ts DESC, query_id DESC LIMIT 20)")
def log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return metrics.first_rows(log).select(F.lit("first").alias("kind"), "query_id").unionByName(metrics.recent_rows(log).select(F.lit("recent").alias("kind"), "query_id"))


@query("SELECT source AS spec, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, source))::INTEGER AS place FROM documents GROUP BY source")
def spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy(text.spec_of(F.col("source")).alias("spec")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "spec")))


# Near-duplicates

_SHINGLES = f"""sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [lower(text)] END) AS s FROM (SELECT doc_id, text, {_words('lower(text)')} AS w FROM documents)),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
near AS (SELECT a, b, i / (na + nb - i) AS jaccard FROM (SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS na, any_value(r.n) AS nb, count(*) AS i FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2) WHERE i / (na + nb - i) >= 0.85)"""


@query(
    f"""WITH {_SHINGLES}, class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sh JOIN documents USING (doc_id) WHERE text IS NOT NULL)
SELECT 'pair' AS kind, a, b, round(jaccard, 6) AS jaccard FROM near WHERE a IN (SELECT rep FROM class) AND b IN (SELECT rep FROM class)
UNION ALL SELECT 'member', rep, doc_id, 1.0 FROM class"""
)
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal texts, named by their least ids, and who is in each class."""
    members, pairs = dedup.jaccard_classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = pairs.select(F.lit("pair").alias("kind"), "a", "b", F.round("jaccard", 6).alias("jaccard"))
    return rows.unionByName(members.select(F.lit("member").alias("kind"), F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


@query()
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.minhash_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH RECURSIVE {_SHINGLES}, nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM near UNION SELECT b FROM near)), before AS (SELECT n.i AS b, list(m.i) AS earlier FROM near JOIN nodes n ON b = n.id JOIN nodes m ON a = m.id GROUP BY 1),
g AS (SELECT 1::BIGINT AS i, []::BIGINT[] AS k UNION ALL SELECT i + 1, CASE WHEN list_has_any(k, coalesce((SELECT earlier FROM before WHERE b = i), []::BIGINT[])) THEN k ELSE list_append(k, i) END FROM g WHERE i <= (SELECT count(*) FROM nodes)),
stay AS (SELECT unnest(k) AS i FROM (SELECT k FROM g ORDER BY i DESC LIMIT 1))
SELECT doc_id, NOT EXISTS (SELECT 1 FROM nodes WHERE id = doc_id AND i NOT IN (FROM stay)) AS kept FROM documents"""
)
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kept")


# Validation, promotion, samples

# Fixed values, written down again so that a change of the operators' lists shows.
_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
_STOP = _LISTED("""a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on at by with from as or and
  but if this that it its not no so than then when which what how why where who""")
_TERMS = _LISTED("""enb ue mme rrc s1ap nas eps bearer handover pdcp rlc mac tau attach timer cause harq qci teid pdn sgw pgw measurement reconfiguration pcell scell pcc scc
  drb srb erab gtp x2 s1 uu rlf prach cqi pmi harq-ack utran""")


def _significant(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w))"


_GROUNDING = f"(CASE WHEN len({_significant('answer')}) > 0 THEN len(list_filter({_significant('answer')}, lambda w: list_contains({_significant('chunk')}, w))) / len({_significant('answer')}) ELSE 0 END)"
_TERM = lambda x: f"list_has_any(regexp_extract_all(lower({x}), '[a-z0-9]+(?:-[a-z0-9]+)*'), {_TERMS})"
_CROSS = r"list_sum(list_transform(regexp_extract_all(answer, '(?i)(?:described|specified|defined|found)\s+in\s+(?:sub)?(?:clause|section)s?\s+[0-9]+(?:\.[0-9]+)*'), lambda m: length(m)))"
_FAILED = f"""((coalesce({_CROSS}, 0) > 0.30 * length(answer))::INTEGER + (NOT {_TERM('answer')})::INTEGER + (len({_words('answer')}) < 15)::INTEGER
  + (regexp_matches(question, '(?i)\\b(section|clause|release|version|specification|document|annex)\\b') AND NOT {_TERM('question')})::INTEGER)"""
_UTILITY = f"(CASE WHEN {_FAILED} = 0 THEN 1.0 ELSE round(greatest(0, 0.5 - 0.15 * ({_FAILED} - 1)), 3) END)::DOUBLE"
_SCORED = f"(SELECT conv_id, turn, {_GROUNDING} AS grounding_score, {_UTILITY} AS utility_score FROM {_PAIRS})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return _pairs(spark, sf_dir).select("conv_id", "turn", "question", "answer", validate.grounding(a, F.col("chunk")).alias("grounding_score"), validate.utility(q, a).alias("utility_score"))


@query(f"SELECT conv_id, turn, round(grounding_score, 6) AS grounding_score, utility_score FROM {_SCORED}")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", "turn", F.round("grounding_score", 6).alias("grounding_score"), "utility_score")


@query(
    f"""SELECT count(*) AS n, round(count(*) FILTER (grounding_score >= 0.6) / count(*), 6) AS grounding_rate, round(count(*) FILTER (utility_score >= 0.6) / count(*), 6) AS utility_rate,
  round(count(*) FILTER (grounding_score >= 0.6 AND utility_score >= 0.6) / count(*), 6) AS both_rate, CASE WHEN count(*) >= 2 AND stddev_samp(grounding_score) > 0 AND stddev_samp(utility_score) > 0 THEN round(corr(grounding_score, utility_score), 6) END AS correlation FROM {_SCORED}"""
)
def validator_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.agreement(_scored(spark, sf_dir))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("grounding_rate", "utility_rate", "both_rate", "correlation")])


@query(
    f"""SELECT coalesce(gate, 'kept') AS gate, count(*) AS n, round(100.0 * count(*) / greatest(1, sum(count(*)) OVER ()), 0) AS pct FROM (SELECT CASE WHEN turn % 5 = 0 THEN 'not_in_chunk' WHEN grounding_score < 0.60 THEN 'low_grounding' WHEN utility_score < 0.60 THEN 'low_utility' END AS gate FROM {_SCORED}) GROUP BY 1"""
)
def kb_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("gate", validate.kb_gate(F.col("turn") % 5 != 0, F.col("grounding_score"), F.col("utility_score")))
    return validate.gate_report(rows)


_FIRST_GATES = f"CASE WHEN conv_id % 7 = 3 THEN 'skipped' WHEN (conv_id % 10) / 10 < 0.60 THEN 'confidence' WHEN len({_words('answer')}) < 50 THEN 'length' END"
_DISTANCE = f"(CASE WHEN greatest(length(l.question), length(r.question)) > 0 THEN levenshtein({_ONE_BYTE('l.question')}, {_ONE_BYTE('r.question')}) / greatest(length(l.question), length(r.question)) ELSE 0 END)"
_PROMOTED = f"""rows_ AS (SELECT conv_id * 1000 + turn AS ordinal, question, {_FIRST_GATES} AS g FROM {_PAIRS}), live AS (SELECT question FROM rows_ WHERE ordinal % 11 = 0), cand AS (SELECT * FROM rows_ WHERE ordinal % 11 <> 0),
passing AS (SELECT ordinal, question FROM cand WHERE g IS NULL), blocked AS (SELECT DISTINCT r.ordinal FROM passing r JOIN live l ON {_DISTANCE} <= 0.30),
free AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS i FROM passing WHERE ordinal NOT IN (FROM blocked)), near AS (SELECT l.i AS a, r.i AS b FROM free l JOIN free r ON l.i < r.i AND {_DISTANCE} <= 0.30),
kept_ AS (SELECT 1::BIGINT AS i, []::BIGINT[] AS k UNION ALL SELECT i + 1, CASE WHEN list_has_any(k, coalesce((SELECT list(a) FROM near WHERE b = i), []::BIGINT[])) THEN k ELSE list_append(k, i) END FROM kept_ WHERE i <= (SELECT count(*) FROM free)),
stay AS (SELECT unnest(k) AS i FROM (SELECT k FROM kept_ ORDER BY i DESC LIMIT 1)), promoted AS (SELECT ordinal FROM free WHERE i IN (FROM stay)),
gated AS (SELECT ordinal, coalesce(g, CASE WHEN ordinal NOT IN (FROM promoted) THEN 'duplicate' END) AS gate FROM cand)"""


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "question", "answer", (F.pmod("conv_id", F.lit(10)) / 10).alias("confidence"), F.when(F.col("conv_id") % 7 == 3, False).when(F.col("conv_id") % 7 == 4, True).alias("answer_in_chunk"))
    keys = rows.where("ordinal % 11 = 0").select("question")
    return promote.promote(rows.where("ordinal % 11 <> 0"), keys)


@query(f"WITH RECURSIVE {_PROMOTED} SELECT ordinal, gate FROM gated")
def promote_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole questions as candidates; those with an ordinal divisible by 11 are live keys. Some say that their answer is not in its chunk, some that it is, the others nothing."""
    return _promoted(spark, sf_dir).select("ordinal", "gate")


@query(
    f"""WITH RECURSIVE {_PROMOTED} SELECT count(*) FILTER (gate IS NULL OR gate <> 'skipped') AS n_evaluated, count(*) FILTER (gate IS NULL) AS n_promoted, count(*) FILTER (gate = 'confidence') AS n_confidence,
  count(*) FILTER (gate = 'length') AS n_length, count(*) FILTER (gate = 'duplicate') AS n_duplicate FROM gated"""
)
def promote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote.report(_promoted(spark, sf_dir))


@query(
    """WITH s AS (SELECT source AS stratum, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1), b AS (SELECT *, n * 137 // (SELECT sum(n) FROM s) AS base, n * 137 % (SELECT sum(n) FROM s) AS rest FROM s)
SELECT stratum, n, (base + (row_number() OVER (ORDER BY rest DESC, f) <= 137 - sum(base) OVER ())::INTEGER)::BIGINT AS k FROM b"""
)
def stratified_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return sampling.apportion(sizes, 137)


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 50")
def nested_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nested_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@query(
    """WITH s AS (SELECT source AS stratum, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1), b AS (SELECT *, n * 137 // (SELECT sum(n) FROM s) AS base, n * 137 % (SELECT sum(n) FROM s) AS rest FROM s),
k AS (SELECT stratum, base + (row_number() OVER (ORDER BY rest DESC, f) <= 137 - sum(base) OVER ())::INTEGER AS k FROM b)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS p FROM documents) JOIN k ON source = stratum WHERE p <= k"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 137)


@query("SELECT 'real_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 5, '0') AS id, doc_id FROM documents")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.running_ids(table(spark, sf_dir, "documents").select("doc_id"), "real_%05d", 0, "doc_id").select("id", "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.not_yet_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "done_id"), "doc_id", "done_id")


@query(
    """SELECT conv_id, turn FROM (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY turn) AS stopped FROM (SELECT *, CASE WHEN i > 0 AND b + b / i > 1000 THEN 1 ELSE 0 END AS stop FROM
  (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations))) WHERE stopped = 0"""
)
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("used"))
    return sampling.within_budget(rows, "used", 1000, "turn", by=["conv_id"]).select("conv_id", "turn")


@query(
    """SELECT doc_id FROM (SELECT *, max(stop) OVER (ORDER BY doc_id) AS stopped FROM (SELECT *, CASE WHEN i > 0 AND b + b / i > 1000000 THEN 1 ELSE 0 END AS stop FROM
  (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents))) WHERE stopped = 0"""
)
def global_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget for all rows in order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("used"))
    return sampling.within_budget(rows, "used", 1_000_000, "doc_id").select("doc_id")


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(rouge_l_udf("answer", "question"), 6).alias("rouge_l"), F.round(token_match_f1_udf("answer", "question"), 6).alias("match_f1"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, true AS parsed FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.json_array(F.concat(F.lit("```json\n["), F.col("props"), F.lit("]\n```")), "array<struct<k: bigint>>")
    return table(spark, sf_dir, "events").select("event_id", found[0]["k"].alias("k"), found.isNotNull().alias("parsed"))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query(
    f"""SELECT conv_id, turn, round(CASE WHEN greatest(length(question), length(answer)) > 0 THEN levenshtein({_ONE_BYTE('question')}, {_ONE_BYTE('answer')}) / greatest(length(question), length(answer)) ELSE 0 END, 6) AS distance FROM {_PAIRS}"""
)
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole questions against whole answers."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scores.edit_distance(F.col("question"), F.col("answer")), 6).alias("distance"))


@query(
    """WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(length(text) ORDER BY turn) AS n FROM conversations WHERE text <> '' GROUP BY 1),
c AS (SELECT conv_id, t, (SELECT coalesce(min(i), len(n) + 1) FROM (SELECT unnest(range(1, len(n) + 1)) AS i) WHERE list_sum(n[1:i]) > 2000) - 1 AS k FROM l)
SELECT conv_id, CASE WHEN k = 0 THEN 'q' ELSE 'Context:' || chr(10) || array_to_string(t[1:k], chr(10) || chr(10) || '---' || chr(10)) || chr(10) || chr(10) || 'Question: q' END AS prompt FROM c"""
)
def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("snippets"))
    return rows.select("conv_id", prompts.context_prompt(F.lit("q"), F.col("snippets")).alias("prompt"))


# Files: written to the shared folder and read back


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "conversations")
    sinks.write_lines(rows, path)
    sinks.write_lines(rows, path, dry_run=True)
    return readers.strict_lines(spark, path, rows.schema)


@query("SELECT (SELECT count(*) FROM events WHERE event_id % 7 <> 0) AS n_good, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS n_bad, (SELECT count(*) FROM events WHERE event_id % 7 <> 0) AS n_kept, (SELECT sum(event_id)::BIGINT FROM events WHERE event_id % 7 <> 0) AS id_sum")
def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every seventh is cut off: the tolerant reader counts them, the dropping one leaves them out."""
    path = scratch_path(spark, "damaged")
    whole = F.to_json(F.struct("event_id", "event_type", "props"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.expr("substring(to_json(struct(event_id, event_type, props)), 1, 9)")).otherwise(whole).alias("value")).write.text(path)
    schema = "event_id long, event_type string, props string"
    good, bad = readers.tolerant_lines(spark, path, schema)
    kept = readers.dropping_lines(spark, path, schema).agg(F.count("*").alias("n_kept"), F.sum("event_id").alias("id_sum"))
    return good.agg(F.count("*").alias("n_good")).crossJoin(bad.agg(F.count("*").alias("n_bad"))).crossJoin(kept)  # one row each


@query("SELECT label::VARCHAR AS query_id, string_agg(vec_id, ',' ORDER BY vec_id) AS doc_ids FROM embeddings GROUP BY 1")
def judgements_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "judgements")
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list("vec_id")), lambda x: x.cast("string")).alias("doc_ids"))
    sinks.write_judgements(rows, path)
    return readers.judgements(spark, path).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(f"SELECT query_id, answered_by, round(confidence, 4) AS confidence, round(latency_ms, 1) AS latency_ms FROM {_LOG}")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended in two parts."""
    path = scratch_path(spark, "log")
    rows = _log(spark, sf_dir).withColumn("query", F.col("query_id").cast("string")).withColumn("tiers_tried", F.array("answered_by"))
    for k in range(2):
        sinks.append_log(rows.where(F.col("query_id") % 2 == k), path)
    back = readers.strict_lines(spark, path, "ts timestamp, query string, answered_by string, confidence double, latency_ms double, tiers_tried array<string>")
    return back.select(F.col("query").cast("long").alias("query_id"), "answered_by", "confidence", "latency_ms")


@query("SELECT doc_id, source, n_chars FROM documents")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), path)
    return spark.read.option("header", True).schema("doc_id long, source string, n_chars long").csv(path)


# Reports


_SPECS = """(VALUES ('23.401', 'GPRS Enhancements for E-UTRAN Access (EPS Architecture)', '23401-k00.zip', '23'), ('24.301', 'Non-Access-Stratum (NAS) Protocol for EPS', '24301-k00.zip', '24'),
  ('36.300', 'E-UTRA and E-UTRAN Overall Description (Stage 2)', '36300-j20.zip', '36'), ('36.331', 'E-UTRA Radio Resource Control (RRC) Protocol Specification', '36331-j30.zip', '36'),
  ('36.413', 'E-UTRAN S1 Application Protocol (S1AP)', '36413-j20.zip', '36')) c(spec_id, title, version_zip, series)"""


@query(f"SELECT c.spec_id, title, version_zip, 'https://www.3gpp.org/ftp/Specs/archive/' || series || '_series/' || c.spec_id || '/' AS archive_url, coalesce(n::VARCHAR, '—') AS n_chunks FROM {_SPECS} LEFT JOIN (SELECT CASE doc_id % 5 WHEN 0 THEN '36.300' WHEN 1 THEN '36.331' WHEN 2 THEN '24.301' WHEN 3 THEN 'other' END AS spec_id, count(*) AS n FROM documents GROUP BY 1) x ON x.spec_id = c.spec_id")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    spec = F.when(k == 0, "36.300").when(k == 1, "36.331").when(k == 2, "24.301").when(k == 3, "other")
    known = readers.catalog(spark)
    counts = metrics.catalog_counts(known, table(spark, sf_dir, "documents").select(spec.alias("spec_id")))
    return F.broadcast(known).join(counts, "spec_id").select("spec_id", "title", "version_zip", "archive_url", "n_chunks")


_RUNS = "(SELECT strftime(ts, '%Y-%m-%d') AS run, count(*) AS n, round(avg(value), 6) AS match_mean, round(median(value), 6) AS rouge_l_mean, round(min(value), 6) AS p50, round(max(value), 6) AS p95 FROM events GROUP BY 1)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = lambda c, name: F.round(c, 6).alias(name)
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.count("*").alias("n"), six(F.avg("value"), "match_mean"), six(F.median("value"), "rouge_l_mean"), six(F.min("value"), "p50"), six(F.max("value"), "p95"))
    return days.select("run", "n", "match_mean", F.struct("rouge_l_mean", "match_mean", "p50", "p95").alias("overall"))


@query(f"SELECT run, n, rouge_l_mean, match_mean, p50, p95 FROM {_RUNS}")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.history(_runs(spark, sf_dir))


@query(f"SELECT run, match_mean FROM {_RUNS} ORDER BY match_mean DESC, run LIMIT 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_run(_runs(spark, sf_dir)).select("run", "match_mean")


@query(f"SELECT spec, count(*) AS n, round(100.0 * count(*) / greatest(1, sum(count(*)) OVER ()), 1) AS pct FROM (SELECT 'c' || conv_id % 4 AS spec, grounding_score FROM {_SCORED} WHERE grounding_score >= 0.3) GROUP BY 1")
def kept_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(F.concat(F.lit("c"), F.col("conv_id") % 4).alias("spec"), F.when(F.col("grounding_score") < 0.3, "low").alias("gate"))
    return validate.kept_by_spec(rows)


@query("SELECT count(DISTINCT conv_id) AS n_chunks, count(*) AS n_pairs, count(DISTINCT CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 END) + max((conv_id % 3 = 0)::INT) AS n_runs FROM conversations")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_chunk_id"), F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") % 3).cast("string")).alias("run_started_at"))
    return validate.run_counts(rows)


@query(f"SELECT query_id, CASE answered_by WHEN 'retrieval' THEN 'synthesis' WHEN 'generative' THEN backend END AS backend, CASE WHEN query_id % 2 = 0 THEN answered_by = 'cache' ELSE answered_by = 'none' END AS tier_match, '[' || answered_by || '] confidence=' || printf('%.2f', confidence) || ' latency=' || printf('%.3f', latency_ms) || 's' AS line FROM {_LOG}")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("query_id") % 2 == 0, "cache").otherwise("none")
    line = text.summary_line(F.col("answered_by"), F.col("confidence"), F.col("latency_ms"))
    return _log(spark, sf_dir).select("query_id", metrics.backend_of(F.col("answered_by"), F.lit("synthesis"), F.col("backend")).alias("backend"), metrics.tier_match(F.col("answered_by"), expected).alias("tier_match"), line.alias("line"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT (SELECT (count(*) * 0.25)::BIGINT FROM documents)")
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fraction_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25)


# Judgements: labels say which documents are judged, and how


@query(
    """SELECT d.doc_id, coalesce(l.toxic, d.n) AS relevant, l.doc_id IS NULL AS open FROM (SELECT doc_id, (doc_id % 2)::INT AS n FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id, (doc_id % 2)::INT FROM labels) d LEFT JOIN (SELECT doc_id, max(toxic)::INT AS toxic FROM labels GROUP BY 1) l USING (doc_id)"""
)
def judgement_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First judgements of documents, those of the labels in their place, and which documents the labels leave open."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.where("doc_id % 3 <> 0").select(F.lit("q").alias("query_id"), "doc_id", (F.col("doc_id") % 2).cast("int").alias("relevant"))
    later = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("relevant")).select(F.lit("q").alias("query_id"), "doc_id", "relevant")
    judged = evaluate.judge(first, later)
    still = evaluate.to_judge(judged.select("query_id", "doc_id"), later).select(F.col("doc_id").alias("o_id"))
    return judged.join(still, F.col("doc_id") == F.col("o_id"), "left").select("doc_id", "relevant", F.col("o_id").isNotNull().alias("open"))


@query("SELECT 'known' AS kind, count(*) AS n FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) USING (doc_id) UNION ALL SELECT 'stray', count(*) FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) USING (doc_id)")
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"))
    known, stray = evaluate.label_overlap(items, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "query_id"))
    return known.agg(F.lit("known").alias("kind"), F.count("*").alias("n")).unionByName(stray.agg(F.lit("stray").alias("kind"), F.count("*").alias("n")))


@query(
    f"""SELECT coalesce(f.query_id, c.query_id) AS query_id, coalesce(f.ids, c.ids) AS ids FROM (SELECT source AS query_id, max(doc_id)::VARCHAR AS ids FROM documents WHERE lang <> 'en' GROUP BY 1) c
  FULL JOIN (SELECT source AS query_id, min(doc_id)::VARCHAR AS ids FROM documents WHERE doc_id % 50 < 9 GROUP BY 1) f ON f.query_id = c.query_id"""
)
def judgement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    made = lambda rows, of: rows.groupBy(F.col("source").alias("query_id")).agg(F.array(of("doc_id").cast("string")).alias("doc_ids"))
    merged = metrics.judged_union(made(d.where("lang <> 'en'"), F.max), made(d.where("doc_id % 50 < 9"), F.min))
    return merged.select("query_id", F.array_join("doc_ids", ",").alias("ids"))


# Prompts and headings


@query(
    """SELECT conv_id, string_agg('[' || CASE WHEN turn % 3 = 0 THEN 'unknown spec' ELSE 'spec ' || role END || ', chunk ' || turn || ']:' || chr(10) || text[1:200], chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: what' AS prompt,
  string_agg(turn || '/' || CASE WHEN turn % 3 = 0 THEN '' ELSE 'spec ' || role END, ' ' ORDER BY turn) AS cited FROM conversations GROUP BY conv_id"""
)
def synthesis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("spec "), F.col("role"))).alias("source"), "text")
    chunks = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "source", "text"))), lambda x: F.struct(x["source"].alias("source"), x["turn"].alias("doc_id"), x["text"].alias("answer"))).alias("chunks"))
    asked = chunks.select("conv_id", prompts.synthesis_prompt(F.lit("what"), F.col("chunks"), 200).alias("prompt"))
    hits = c.select(F.col("conv_id").alias("query_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("rank"))
    cited = retrieval.citations(hits, c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "source"))
    shown = F.array_join(F.transform("citations", lambda x: F.concat(F.element_at(F.split(x["doc_id"], "-"), -1), F.lit("/"), x["source"])), " ")
    return asked.join(cited.select(F.col("query_id").alias("c_id"), shown.alias("cited")), F.col("conv_id") == F.col("c_id")).drop("c_id")


# Chunks made of the first words of documents with a numbered heading before them; a source is one text.
_HEADED = r"(SELECT source AS doc, doc_id AS idx, ((doc_id * 7) % 5 + 1) || '.' || (doc_id % 3) || split_part(split_part(text, '.', 1), chr(10), 1) AS paragraph FROM documents)"


@query(
    rf"""WITH h AS (SELECT doc, idx, {_strip('paragraph')} AS t FROM {_HEADED}),
c AS (SELECT doc, idx, CASE WHEN length(t) BETWEEN 4 AND 80 AND NOT contains(t[1:50], ':') AND regexp_matches(t, '^[0-9]+(\.[0-9]+)+[A-Z][^\n]*$') AND NOT regexp_matches(t, '[0-9]$') THEN regexp_extract(t, '^([0-9]+)', 1)::INT END AS clause FROM h),
a AS (SELECT doc, arg_min(clause, idx) AS anchor FROM c WHERE clause IS NOT NULL GROUP BY 1)
SELECT d.doc, coalesce((SELECT min(idx) FROM c WHERE c.doc = d.doc AND clause <> a.anchor), 0)::BIGINT AS start FROM (SELECT DISTINCT source AS doc FROM documents) d LEFT JOIN a USING (doc)"""
)
def heading_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split(F.split("text", r"\.")[0], "\n")[0]
    chunk = F.concat((F.col("doc_id") * 7 % 5 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), first)
    out = text_quality.body_start(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("idx"), chunk.alias("chunk")))
    return out.select("doc", F.col("start").cast("long").alias("start"))
