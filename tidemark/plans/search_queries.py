"""Queries: lexical, vector, sparse and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring, text, vectors
from tidemark.operators import blocks, documents, fulltext, lexical, positional, search
from tidemark.plans.registry import query, shared_folder
from tidemark.sources.tables import table

TERMS = ("license", "the", "moron")
AS_OF = "2024-01-31 00:00:00"


def _bm25_sql(terms: tuple[str, ...], cols: str = "") -> str:
    """DuckDB SQL of ``(doc_id, bm25)`` for documents that hold a term."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    share = " + ".join(
        f"""CASE WHEN tf{i} > 0 THEN (CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5))
        ELSE 1e-6 END) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25 + 0.75 * len / mean)) ELSE 0 END"""
        for i in range(len(terms))
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
  SELECT doc_id, {share} AS bm25 FROM (SELECT doc_id, len(t) AS len, {tf} FROM (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents)) c,
  (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {df} FROM (SELECT len(t) AS len, {tf} FROM (
    SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents))) s
  WHERE {some}"""


_QUERY_SQL = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _cosine_sql(vector: str = "embedding") -> str:
    return f"""CASE WHEN list_dot_product({vector}::DOUBLE[], {vector}::DOUBLE[]) > 0
  THEN list_cosine_similarity({vector}::DOUBLE[], {_QUERY_SQL}) ELSE 0 END"""


def _query_vector(spark: SparkSession, base: str, vec_id: int = 0) -> list[float]:
    """The vector of a stored row, as a query: one row."""
    return list(table(spark, base, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def _bm25(spark: SparkSession, base: str) -> DataFrame:
    return lexical.bm25(table(spark, base, "documents").select("doc_id", "text"), TERMS, "doc_id", "text")


@query(f"""
WITH b AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM ({_bm25_sql(TERMS)})), top AS (
  SELECT *, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM b QUALIFY rank <= 20)
SELECT doc_id, bm25, round(bm25 / (1 + bm25), 6) AS score, rank::INT AS rank FROM top
""")
def lexical_bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    hits = _bm25(spark, base).withColumn("bm25", F.round("bm25", 6))
    top = hits.orderBy(F.desc("bm25"), "doc_id").limit(20)
    out = search.ranked(top, "doc_id", "bm25")
    return out.select("doc_id", "bm25", F.round(scoring.lexical_score(F.col("bm25")), 6).alias("score"), "rank")


@query(f"SELECT doc_id, round(bm25, 6) AS bm25, round(1 / (1 + bm25), 6) AS score FROM ({_bm25_sql(TERMS)})")
def lexical_bm25_all(spark: SparkSession, base: str) -> DataFrame:
    """All hits, with the score mode in which the best hit scores least."""
    score = F.round(scoring.lexical_score(F.col("bm25"), "inverted"), 6)
    return _bm25(spark, base).select("doc_id", F.round("bm25", 6).alias("bm25"), score.alias("score"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t),
i AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM i)),
d AS (SELECT term, count(*) AS df FROM i WHERE term IN ('license', 'the', 'moron') GROUP BY 1)
SELECT doc_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * length / mean))), 6) AS bm25
FROM i JOIN d USING (term), s GROUP BY doc_id
""")
def lexical_postings_bm25(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    index, stats = lexical.postings_and_stats(docs, "doc_id", "text", TERMS)
    hits = lexical.bm25_from_postings(index, stats, TERMS, "doc_id")
    return hits.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t),
i AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM i)),
d AS (SELECT term, count(*) AS df FROM i WHERE term IN ('license', 'the', 'moron') GROUP BY 1)
SELECT doc_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * length / mean))), 6) AS bm25
FROM i JOIN d USING (term), s GROUP BY doc_id
""")
def lexical_stored_index(spark: SparkSession, base: str) -> DataFrame:
    """The same from an index that was written and is read by its terms' folders."""
    folder = shared_folder(spark, "index")
    lexical.write_index(table(spark, base, "documents").select("doc_id", "text"), folder, "doc_id", "text", 8)
    hits = lexical.search_index(spark, folder, TERMS, "doc_id", 8)
    return hits.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("""
WITH l AS (SELECT doc_id, text, instr(lower(text), 'licensed') AS pos FROM documents)
SELECT doc_id, CASE WHEN pos > 0 THEN substr(text, greatest(pos - 1 - 200, 0) + 1,
  least(pos - 1 + 8 + 200, length(text)) - greatest(pos - 1 - 200, 0)) ELSE substr(text, 1, 400) END AS snippet,
  CASE WHEN pos > 0 THEN greatest(pos - 1 - 200, 0) ELSE 0 END::BIGINT AS "offset" FROM l
""")
def lexical_snippets(spark: SparkSession, base: str) -> DataFrame:
    found, offset = text.snippet(F.col("text"), "licensed")
    return table(spark, base, "documents").select("doc_id", found.alias("snippet"), offset.alias("offset"))


@query("""
WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ +| +$', '', 'g') AS flat FROM documents),
l AS (SELECT *, instr(lower(flat), 'license') AS pos FROM f),
s AS (SELECT *, CASE WHEN pos > 0 THEN greatest(pos - 1 - 40, 0) ELSE 0 END AS start FROM l)
SELECT doc_id, (CASE WHEN start > 0 THEN '...' ELSE '' END) || substr(flat, start + 1, 180)
  || (CASE WHEN start + 180 < length(flat) THEN '...' ELSE '' END) AS snippet FROM s
""")
def browse_snippets(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", text.browse_snippet(F.col("text"), "license").alias("snippet"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)
SELECT doc_id FROM t WHERE (contains(' ' || array_to_string(t, ' ') || ' ', ' licensed under ') OR list_contains(t, 'idiot'))
  AND NOT list_contains(t, 'moron') AND len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0
""")
def fts_boolean_query(spark: SparkSession, base: str) -> DataFrame:
    wanted = '("licensed under" OR idiot) NOT moron th*'
    return lexical.boolean_search(table(spark, base, "documents"), wanted, "doc_id", "text")


def _share_sql(tf: str, df: str) -> str:
    """DuckDB SQL of one leaf's part in BM25, given its frequency, document frequency and ``n``, ``len``, ``mean``."""
    odds = f"ln((n - {df} + 0.5) / ({df} + 0.5))"
    return f"CASE WHEN {tf} > 0 THEN (CASE WHEN {odds} > 0 THEN {odds} ELSE 1e-6 END) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25 + 0.75 * len / mean)) ELSE 0 END"


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS len, len(list_filter(range(1, len(t)), lambda i: t[i] = 'licensed' AND t[i + 1] = 'under')) AS a,
  len(list_filter(t, lambda x: x = 'idiot')) AS b, len(list_filter(t, lambda x: x = 'moron')) AS c, len(list_filter(t, lambda x: starts_with(x, 'th'))) AS d FROM t WHERE len(t) > 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc, count(*) FILTER (d > 0) AS dd FROM c)
SELECT doc_id, round({_share_sql("a", "da")} + {_share_sql("b", "db")} + {_share_sql("c", "dc")} + {_share_sql("d", "dd")}, 6) AS bm25
FROM c, s WHERE (a > 0 OR b > 0) AND c = 0 AND d > 0
""")
def fts_indexed_query(spark: SparkSession, base: str) -> DataFrame:
    """Phrase, prefix and NOT from a stored index with positions, with scores."""
    folder = shared_folder(spark, "positional")
    positional.write(table(spark, base, "documents").select("doc_id", "text"), folder, "doc_id", {"text": 1.0})
    found = positional.search(spark, folder, '("licensed under" OR idiot) NOT moron th*', "doc_id")
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query()
def fts_cover_density(spark: SparkSession, base: str) -> DataFrame:
    """Documents ranked by covers of stems, for which SQL has no form here: a test tries every stretch of every text."""
    docs = table(spark, base, "documents")
    found = fulltext.cover_density(docs, ["licensing", "under"], "doc_id", "text")
    return found.select("doc_id", F.round("rank", 6).alias("rank"), "covers")


def _best_sql(rows: str, key: str, n: int) -> str:
    """DuckDB SQL of ``(key, bm25, rank)``: the best n of ``(key, t)`` rows, t an array of words, for TERMS."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(_share_sql(f"tf{i}", f"df{i}") for i in range(len(TERMS)))
    return f"""
WITH RECURSIVE {rows}, c AS (SELECT {key}, len(t) AS len, {tf} FROM t WHERE len(t) > 0), s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {df} FROM c),
b AS (SELECT {key}, round({score}, 6) AS bm25 FROM c, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))})
SELECT {key}, bm25, (row_number() OVER (ORDER BY bm25 DESC, {key}))::INT AS rank FROM b QUALIFY rank <= {n}"""


_CHUNK_SQL = """cut AS (
  SELECT doc_id, text, 0 AS chunk, 0 AS s, CASE WHEN length(text) <= 800 THEN length(text) WHEN contains(substr(text, 201, 600), chr(10) || chr(10))
    THEN 800 - strpos(reverse(substr(text, 201, 600)), chr(10) || chr(10)) + 1 ELSE 800 END AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, chunk + 1, e, CASE WHEN length(text) <= e + 800 THEN length(text) WHEN contains(substr(text, e + 201, 600), chr(10) || chr(10))
    THEN e + 800 - strpos(reverse(substr(text, e + 201, 600)), chr(10) || chr(10)) + 1 ELSE e + 800 END FROM cut WHERE e < length(text)),
t AS (SELECT doc_id || ':' || chunk AS chunk_id, regexp_extract_all(lower(substr(text, s + 1, e - s)), '[a-z0-9_]+') AS t FROM cut)"""


@query(_best_sql(_CHUNK_SQL, "chunk_id", 30))
def chunk_bm25(spark: SparkSession, base: str) -> DataFrame:
    """The best chunks of all documents, from an index at the chunks' grain."""
    folder = shared_folder(spark, "chunks")
    cut = documents.chunks(table(spark, base, "documents"), "doc_id", "text")
    cut = cut.select(F.concat_ws(":", "doc_id", "chunk").alias("chunk_id"), "body")
    positional.write(cut, folder, "chunk_id", {"body": 1.0}, positions=False)
    best = positional.top_k(spark, folder, positional.as_queries(spark, {"q": TERMS}), 30, "chunk_id")
    return best.select("chunk_id", "bm25", "rank")


_THREAD_SQL = """f AS (SELECT conv_id, arg_min(text, turn) AS title, string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn) AS summary,
  string_agg(array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ' '), ' ' ORDER BY turn) AS entities, string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn) AS tasks
  FROM conversations GROUP BY 1),
t AS (SELECT conv_id, list_concat(list_concat(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]+'), regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9_]+')),
  list_concat(regexp_extract_all(lower(coalesce(entities, '')), '[a-z0-9_]+'), regexp_extract_all(lower(coalesce(tasks, '')), '[a-z0-9_]+'))) AS t FROM f)"""


@query(_best_sql(_THREAD_SQL, "conv_id", 30))
def thread_bm25(spark: SparkSession, base: str) -> DataFrame:
    """The best conversations by their titles, summaries, entities and tasks, the fields of one index."""
    folder = shared_folder(spark, "threads")
    turns = table(spark, base, "conversations")
    own = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda s: s["x"]), " ")
    names = F.array_join(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), " ")
    threads = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("title"), own(F.when(F.col("role") == "assistant", F.col("text"))).alias("summary"),
        own(names).alias("entities"), own(F.when(F.col("role") == "user", F.col("text"))).alias("tasks"),
    )
    positional.write(threads, folder, "conv_id", dict.fromkeys(("title", "summary", "entities", "tasks"), 1.0))
    best = positional.top_k(spark, folder, positional.as_queries(spark, {"q": TERMS}), 30, "conv_id")
    return best.select("conv_id", "bm25", "rank")


@query(f"""
SELECT vec_id, round({_cosine_sql()}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20
""")
def vector_cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    return search.knn(table(spark, base, "embeddings"), _query_vector(spark, base), 20, "vec_id", "embedding")


@query(f"""
SELECT vec_id, round({_cosine_sql()}, 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 20
""")
def vector_filtered_topk(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings")
    return search.knn(rows, _query_vector(spark, base), 20, "vec_id", "embedding", F.col("label").isin(1, 3))


def _planes_sql(bits: int) -> str:
    planes = vectors.hyperplanes(64, bits)
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in p) + "]" for p in planes) + "]"


def _signature_sql(bits: int) -> str:
    return f"""list_sum(list_transform({_planes_sql(bits)}, lambda p, i:
      CASE WHEN list_dot_product(embedding::DOUBLE[], p) >= 0 THEN (1::BIGINT << (i - 1)::INT) ELSE 0::BIGINT END))::BIGINT"""


@query(f"""
WITH s AS (SELECT vec_id, {_signature_sql(63)} AS signature FROM embeddings)
SELECT vec_id, signature, (signature & 65535)::INT AS bucket FROM s
""")
def vector_lsh_signature(spark: SparkSession, base: str) -> DataFrame:
    index = search.lsh_index(table(spark, base, "embeddings"), "vec_id", "embedding", 64)
    return index.select("vec_id", "signature", "bucket")


@query(f"""
WITH s AS (SELECT vec_id, embedding, {_signature_sql(8)} & 31 AS bucket FROM embeddings),
near AS (SELECT vec_id, round({_cosine_sql()}, 6) AS score FROM s
  WHERE bucket = (SELECT bucket FROM s WHERE vec_id = 0) ORDER BY score DESC, vec_id LIMIT 10),
wide AS (SELECT vec_id, round({_cosine_sql()}, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10)
SELECT * FROM near WHERE (SELECT count(*) FROM near) >= 10
UNION ALL SELECT * FROM wide WHERE (SELECT count(*) FROM near) < 10
""")
def vector_lsh_bucket_topk(spark: SparkSession, base: str) -> DataFrame:
    index = search.lsh_index(table(spark, base, "embeddings"), "vec_id", "embedding", 64, 8, 5)
    return search.lsh_knn(index, _query_vector(spark, base), 10, "vec_id", "embedding", 8, 5)


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents),
w AS (SELECT doc_id, token, ln(1 + count(*)) AS weight FROM p WHERE token IN ('license', 'under', 'the') GROUP BY ALL)
SELECT doc_id, round(sum(weight * CASE token WHEN 'license' THEN 2.0::DOUBLE WHEN 'under' THEN 1.0 ELSE 0.1 END), 6) AS score
FROM w GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20
""")
def sparse_dot_topk(spark: SparkSession, base: str) -> DataFrame:
    rows = search.sparse_rows(table(spark, base, "documents"), "doc_id", text.terms(F.col("text")))
    return search.sparse_search(rows, {"license": 2.0, "under": 1.0, "the": 0.1}, 20, "doc_id")


@query("""
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark)
SELECT token, ('0x' || substr(sha256(token), 7, 2) || substr(sha256(token), 5, 2) || substr(sha256(token), 3, 2)
  || substr(sha256(token), 1, 2))::BIGINT AS token_id FROM d
""")
def sparse_token_ids(spark: SparkSession, base: str) -> DataFrame:
    rows = search.sparse_rows(table(spark, base, "benchmark"), "item_id", text.terms(F.col("text")))
    return rows.select("token", "token_id").distinct()


#: Planes of the stored vector index, and how many of its 64 buckets a query looks into.
PLANES, PROBES = 6, 48
_PLANES_SQL = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in p) + "]" for p in vectors.hyperplanes(64, PLANES)) + "]"


def _probes_sql(q: str, index: str) -> str:
    """DuckDB CTEs: ``pr(query, bucket, probe)`` of ``(query, q)`` rows and ``ix`` (the index rows with their bucket)."""
    margin = lambda v: f"list_transform({_PLANES_SQL}, lambda p: round(list_dot_product({v}::DOUBLE[], p), 6))"
    own = lambda v: f"list_sum(list_transform(range(0, {PLANES}), lambda i: CASE WHEN list_dot_product({v}::DOUBLE[], ({_PLANES_SQL})[i + 1]) >= 0 THEN 1 << i ELSE 0 END))::INT"
    cost = f"round(list_sum(list_transform(range(0, {PLANES}), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN m[i + 1] * m[i + 1] ELSE 0 END)), 6)"
    return f"""mg AS (SELECT query, {margin("q")} AS m, {own("q")} AS own FROM {q}), mk AS (SELECT *, unnest(range(0, {1 << PLANES}))::INT AS mask FROM mg),
pr AS (SELECT query, xor(own, mask) AS bucket, row_number() OVER (PARTITION BY query ORDER BY {cost}, mask) AS probe FROM mk),
ix AS (SELECT *, {own("v")} AS bucket FROM {index})"""


_COSINE = "CASE WHEN list_dot_product(a::DOUBLE[], a::DOUBLE[]) > 0 AND list_dot_product(b::DOUBLE[], b::DOUBLE[]) > 0 THEN list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]) ELSE 0 END"
_QUERIES_SQL = "qs AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), al AS (SELECT vec_id, embedding AS v FROM embeddings)"


def _vector_queries(spark: SparkSession, base: str) -> DataFrame:
    """The query set: rows whose id is divisible by 100, against all rows."""
    rows = table(spark, base, "embeddings").where("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))


def _vector_index(spark: SparkSession, base: str) -> str:
    folder = shared_folder(spark, "vectors")
    rows = table(spark, base, "embeddings").withColumn("odd", F.col("vec_id") % 2)
    search.write_lsh(rows, folder, "vec_id", "embedding", 64, PLANES, meta=["odd"])
    return folder


@query(f"""
WITH {_QUERIES_SQL}, {_probes_sql("qs", "al")}, sc AS (
  SELECT pr.query, vec_id, round({_COSINE.replace("a::", "ix.v::").replace("b::", "qs.q::")}, 6) AS score FROM pr JOIN ix USING (bucket) JOIN qs ON qs.query = pr.query
  WHERE probe <= {PROBES} AND pr.query <> vec_id AND vec_id % 2 = 1)
SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM sc QUALIFY rank <= 10
""")
def vector_multiprobe_topk(spark: SparkSession, base: str) -> DataFrame:
    """The best rows of the nearest buckets, of those that a filter on the table of meta rows leaves."""
    folder = _vector_index(spark, base)
    keys = spark.read.parquet(f"{folder}/meta").where("odd = 1")
    return search.probe_knn(spark, folder, _vector_queries(spark, base), 10, "vec_id", "embedding", 64, PLANES, PROBES, keys)


@query(f"""
WITH {_QUERIES_SQL}, {_probes_sql("qs", "al")}, ex AS (
  SELECT query, vec_id FROM qs JOIN al ON query <> vec_id
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY round({_COSINE.replace("a::", "v::").replace("b::", "q::")}, 6) DESC, vec_id) <= 10),
sz AS (SELECT bucket, count(*) AS n FROM ix GROUP BY 1), fd AS (SELECT query, bucket, count(*) AS found FROM ex JOIN ix USING (vec_id) GROUP BY 1, 2),
sm AS (SELECT probe, coalesce(sum(found), 0) AS found, coalesce(sum(n), 0) AS n FROM pr LEFT JOIN sz USING (bucket) LEFT JOIN fd USING (query, bucket) GROUP BY 1),
cv AS (SELECT probe AS probes, round(sum(found) OVER (ORDER BY probe)::DOUBLE / sum(found) OVER (), 6) AS recall, round(sum(n) OVER (ORDER BY probe)::DOUBLE / sum(n) OVER (), 6) AS scored FROM sm)
SELECT probes::INT AS probes, recall, scored FROM cv WHERE recall >= 0.9 ORDER BY probes LIMIT 1
""")
def vector_multiprobe_recall(spark: SparkSession, base: str) -> DataFrame:
    """How many buckets reach a recall@10 of 0.9 against an exact search, and what share of the rows they hold."""
    folder = _vector_index(spark, base)
    queries, rows = _vector_queries(spark, base), table(spark, base, "embeddings")
    exact = blocks.best(rows, queries, 10, "vec_id", "embedding", 64).select("query", "vec_id")  # a stated query set against all rows
    curve = search.recall_curve(exact, spark.read.parquet(f"{folder}/vectors"), queries, "vec_id", 64, PLANES)
    return curve.where("recall >= 0.9").orderBy("probes").limit(1)


_MEAN = "list_transform(range(1, 65), lambda i: list_avg(list_transform({}, lambda x: (x[i])::DOUBLE)))"


@query(f"""
WITH g AS (SELECT vec_id // 8 AS group_id, list(embedding ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1), al AS (SELECT *, {_MEAN.format("vs")} AS v FROM g),
qv AS (SELECT list(embedding ORDER BY vec_id) AS w FROM embeddings WHERE vec_id IN (0, 1)), qs AS (SELECT 0 AS query, {_MEAN.format("w")} AS q FROM qv), {_probes_sql("qs", "al")},
ca AS (SELECT group_id, vs FROM pr JOIN ix USING (bucket), qs WHERE probe <= {PROBES}
  ORDER BY round({_COSINE.replace("a::", "v::").replace("b::", "q::")}, 6) DESC, group_id LIMIT 40)
SELECT group_id, round(list_avg(list_transform(w, lambda x: greatest(list_max(list_transform(vs, lambda y: list_dot_product(y::DOUBLE[], x::DOUBLE[]))) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])), 0))), 6) AS score
FROM ca, qv ORDER BY score DESC, group_id LIMIT 20
""")
def late_probed_topk(spark: SparkSession, base: str) -> DataFrame:
    """Late interaction over the rows whose mean vectors are nearest, from the stored index of those."""
    rows = table(spark, base, "embeddings").withColumn("group_id", F.expr("vec_id div 8"))
    grouped = rows.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    folder = shared_folder(spark, "means")
    search.write_lsh(grouped.withColumn("mean", vectors.centroid(F.col("vs"), 64)), folder, "group_id", "mean", 64, PLANES, held=["vs"])
    wanted = [_query_vector(spark, base, i) for i in (0, 1)]
    return search.probe_late(spark, folder, wanted, 20, "group_id", "mean", "vs", 64, PLANES, PROBES, 40)


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (0, 1)),
s AS (SELECT e.vec_id // 8 AS group_id, q.vec_id AS q,
      max(list_dot_product(e.embedding::DOUBLE[], q.v)) / sqrt(list_dot_product(any_value(q.v), any_value(q.v))) AS best
      FROM embeddings e, q GROUP BY 1, 2)
SELECT group_id, round(sum(greatest(best, 0)) / 2, 6) AS score FROM s GROUP BY 1 ORDER BY score DESC, group_id LIMIT 20
""")
def late_maxsim_topk(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings").withColumn("group_id", F.expr("vec_id div 8"))
    grouped = rows.groupBy("group_id").agg(F.collect_list("embedding").alias("vs"))
    wanted = [_query_vector(spark, base, i) for i in (0, 1)]
    return search.late_search(grouped, wanted, 20, "group_id", "vs")


@query("""
WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, (i - 1)::INT AS i, round(avg(x), 6) AS x FROM p GROUP BY 1, 2
""")
def label_centroids(spark: SparkSession, base: str) -> DataFrame:
    each = table(spark, base, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("""
SELECT doc_id, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 1.0::DOUBLE
  ELSE (n_chars - min(n_chars) OVER w)::DOUBLE / (max(n_chars) OVER w - min(n_chars) OVER w) END, 6) AS score
FROM documents WINDOW w AS (PARTITION BY source)
""")
def minmax_normalise(spark: SparkSession, base: str) -> DataFrame:
    score = F.round(scoring.min_max(F.col("n_chars"), "source"), 6)
    return table(spark, base, "documents").select("doc_id", score.alias("score"))


_CANDIDATES = f"""
l AS (SELECT doc_id, round(bm25 / (1 + bm25), 6) AS score FROM ({_bm25_sql(TERMS)})),
d AS (SELECT vec_id AS doc_id, round({_cosine_sql()}, 6) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 200),
c AS (SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.score, 0) AS lexical, coalesce(d.score, 0) AS dense
      FROM l FULL JOIN d ON l.doc_id = d.doc_id),
m AS (SELECT *, CASE WHEN max(lexical) OVER () = min(lexical) OVER () THEN 1 ELSE
        (lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()) END AS ln,
      CASE WHEN max(dense) OVER () = min(dense) OVER () THEN 1 ELSE
        (dense - min(dense) OVER ()) / (max(dense) OVER () - min(dense) OVER ()) END AS dn,
      exp(-greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(TIMESTAMP '2024-01-01' + to_minutes(doc_id))) / 1e6, 0) / (3600.0 * 72)) AS rec
      FROM c),
h AS (SELECT doc_id, lexical, dense, round((ln * 0.4 + dn * 0.4 + rec * 0.1) / 0.9, 6) AS score FROM m)
"""


def _hybrid(spark: SparkSession, base: str) -> DataFrame:
    lex = _bm25(spark, base).select("doc_id", F.round(scoring.lexical_score(F.col("bm25")), 6).alias("score"))
    dense = search.knn(table(spark, base, "embeddings"), _query_vector(spark, base), 200, "vec_id", "embedding")
    found = search.assemble({"lexical": lex, "dense": dense.withColumnRenamed("vec_id", "doc_id")}, "doc_id")
    seen = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60_000_000)
    out = search.hybrid(found.withColumn("seen", seen), F.lit(AS_OF).cast("timestamp"), "seen")
    return out.select("doc_id", "lexical", "dense", "score")


@query(f"WITH {_CANDIDATES} SELECT doc_id, lexical, dense, score FROM h")
def hybrid_score(spark: SparkSession, base: str) -> DataFrame:
    return _hybrid(spark, base)


@query(f"WITH {_CANDIDATES} SELECT doc_id, score FROM h WHERE lexical >= 0.15 OR dense >= 0.15")
def threshold_filter(spark: SparkSession, base: str) -> DataFrame:
    return search.over_threshold(_hybrid(spark, base)).select("doc_id", "score")


_TOP = f"""{_CANDIDATES}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 50)"""


def _top(spark: SparkSession, base: str) -> DataFrame:
    best = _hybrid(spark, base).orderBy(F.desc("score"), "doc_id").limit(50)
    return search.ranked(best, "doc_id")


@query(f"""
WITH {_TOP} SELECT doc_id, rank::INT AS rank, coalesce(greatest(0, round(lag(score) OVER (ORDER BY rank) - score, 6)), 0)::DOUBLE AS gap FROM t
""")
def rank_gap(spark: SparkSession, base: str) -> DataFrame:
    return _top(spark, base).select("doc_id", "rank", "gap")


@query(f"""
WITH {_TOP}, g AS (SELECT max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS gap FROM t)
SELECT top, round(gap, 6) AS gap, top >= 0.65 AND round(gap, 6) >= 0.1 AS confident FROM g
""")
def rank_confidence(spark: SparkSession, base: str) -> DataFrame:
    return search.confidence(_top(spark, base))


@query(f"""
WITH {_TOP}, r AS (SELECT t.doc_id, rank, CASE WHEN rank <= 10 THEN ('0x' || substr(sha256(text), 1, 2))::INT / 255.0::DOUBLE END AS rr
  FROM t JOIN documents USING (doc_id))
SELECT doc_id, rank::INT AS rank, row_number() OVER (ORDER BY rank > 10, rr DESC NULLS LAST, rank, doc_id)::INT AS position FROM r
""")
def rerank_head_tail(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    byte = F.conv(F.substring(F.sha2("text", 256), 1, 2), 16, 10).cast("double") / 255
    return search.rerank_head(_top(spark, base).join(docs, "doc_id"), byte, 10, "doc_id").select("doc_id", "rank", "position")


_LISTS = f"""
a AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM ({_bm25_sql(TERMS)}) QUALIFY rank <= 50),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_cosine_sql()}, 6) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
c AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)
"""


def _lists(spark: SparkSession, base: str) -> list[DataFrame]:
    lex = _bm25(spark, base).withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "doc_id").limit(50)
    dense = search.knn(table(spark, base, "embeddings"), _query_vector(spark, base), 50, "vec_id", "embedding")
    long = table(spark, base, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return [
        search.ranked(lex, "doc_id", "bm25"),
        search.ranked(dense.withColumnRenamed("vec_id", "doc_id"), "doc_id"),
        search.ranked(long, "doc_id", "n_chars"),
    ]


@query(f"""
WITH {_LISTS}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank)::INT AS best_rank, count(*) AS n_lists FROM u GROUP BY 1
""")
def rrf_fuse(spark: SparkSession, base: str) -> DataFrame:
    return search.fuse(_lists(spark, base), "doc_id")


@query(f"""
WITH {_TOP}, late AS (SELECT doc_id, min(score) AS late FROM (
  SELECT vec_id AS doc_id, round({_cosine_sql()}, 6) AS score FROM embeddings
  UNION ALL SELECT vec_id, round({_cosine_sql()} / 2, 6) FROM embeddings) GROUP BY 1),
n AS (SELECT doc_id, CASE WHEN max(late) OVER () = min(late) OVER () THEN 1 ELSE
  (late - min(late) OVER ()) / (max(late) OVER () - min(late) OVER ()) END AS late FROM late)
SELECT doc_id, round(score * 0.8 + coalesce(late, 0) * 0.2, 6) AS score FROM t LEFT JOIN n USING (doc_id)
""")
def late_rerank(spark: SparkSession, base: str) -> DataFrame:
    score = vectors.cosine(F.col("embedding"), vectors.literal(_query_vector(spark, base)))
    rows = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), score.alias("s"))
    late = rows.select("doc_id", F.explode(F.array(F.round("s", 6), F.round(F.col("s") / 2, 6))).alias("score"))
    return search.late_rerank(_top(spark, base), late, "doc_id").select("doc_id", "score")


@query("""
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1
""")
def content_dedupe(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
    return search.best_of_each(docs, "sha", F.desc("n_chars"), F.col("doc_id")).select("doc_id")


@query("""
SELECT unnest([5, 3, 9, 1]) AS doc_id, unnest([0, 1, 2, 3])::INT AS position
""")
def ordered_lookup(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("int").alias("doc_id"))
    return search.in_order([5, 3, 9, 1], docs, "doc_id").select("doc_id", "position")
