"""The engine's queries over the whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import filters as X
from corvid.functions import ids, text
from corvid.functions import vector as V
from corvid.operators import batch, cache, chunking, conversation, embedding, index, metrics, prompting, rerank, retrieval
from corvid.sources import extract, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- similarity: every vector with the next one ---
_PAIRED = "FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_METRIC_SQL = {
    "cosine": "list_cosine_similarity(a, b)",
    "dot": "list_dot_product(a, b)",
    "euclidean": "1 / (1 + list_distance(a, b))",
    "manhattan": "1 / (1 + list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))))",
    "angular": "1 - acos(greatest(-1, least(1, list_cosine_similarity(a, b)))) / pi()",
    "rbf": "exp(-1 * list_distance(a, b) * list_distance(a, b))",
}


def _paired(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _t(spark, sf_dir, "embeddings")
        other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        return e.join(other, "vec_id").select("vec_id", F.round(V.similarity(metric, F.col("embedding"), F.col("other")), 6).alias("score"))

    return run


for _m, _s in _METRIC_SQL.items():
    _query(f"sim_{_m}", f"SELECT vec_id, round({_s}, 6) AS score {_PAIRED}")(_paired(_m))


@_query("vec_normalize", "SELECT vec_id, i - 1 AS dim, round(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@_query("vec_is_normalized", "SELECT vec_id, abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4 AS unit FROM embeddings")
def vec_is_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", V.is_normalized(F.col("embedding")).alias("unit"))


@_query("vec_centroids", "SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i")
def vec_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.centroids(_t(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


# --- search: every vector is a question to all vectors ---
def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label"), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def _topk_sql(score: str, where: str = "true", keep: str = "score > 0", k: int = 5) -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({score}, 12) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) q, (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings WHERE {where}) v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE {keep})
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_COS = "list_cosine_similarity(a, b)"


@_query("topk_exact", _topk_sql(_COS))
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(*_store(spark, sf_dir), k=5))


@_query("topk_threshold", _topk_sql(_COS, keep="score > 0 AND score >= 0.2"))
def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(*_store(spark, sf_dir), k=5, min_score=0.2))


@_query("topk_filtered", _topk_sql(_COS, where="label IN (1, 3, 5)"))
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(*_store(spark, sf_dir), k=5, where={"label": [1, 3, 5]}))


@_query("topk_no_cutoff", _topk_sql(_COS, where="label = 2", keep="true", k=20))
def topk_no_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(*_store(spark, sf_dir), k=20, above=None, where={"label": 2}))


@_query("topk_euclidean", _topk_sql("1 / (1 + list_distance(a, b))"))
def topk_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(*_store(spark, sf_dir), k=5, metric="euclidean"))


@_query("topk_approximate")
def topk_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, queries = _store(spark, sf_dir)
    return _rounded(index.build(store.select("id", "embedding")).search(queries, k=10))


# --- changes of a store ---
@_query("upsert_last_wins", "SELECT doc_id AS id, coalesce(l.quality, -1)::BIGINT AS value FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("value"))
    changes = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("value"), F.col("quality").alias("seq"))
    return retrieval.upsert(store, changes.join(store.select("id"), "id", "left_semi"))


@_query("delete_ids", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.delete(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), _t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@_query("store_count", "SELECT count(*) AS n FROM embeddings")
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.size(_t(spark, sf_dir, "embeddings"))


# --- filters, with real nulls: not every document has a label ---
_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


_FILTERS: dict[str, tuple[object, str]] = {
    "eq": (X.eq("quality", 1), "quality IS NOT DISTINCT FROM 1"),
    "ne": (X.ne("quality", 1), "quality IS DISTINCT FROM 1"),
    "gt": (X.gt("quality", 0), "coalesce(quality > 0, false)"),
    "lt": (X.lt("quality", 1), "coalesce(quality < 1, false)"),
    "gte": (X.gte("quality", 1), "coalesce(quality >= 1, false)"),
    "lte": (X.lte("quality", 0), "coalesce(quality <= 0, false)"),
    "contains": (X.contains("source", "1"), "contains(source, '1')"),
    "in": (X.in_("lang", ["de", "fr"]), "lang IN ('de', 'fr')"),
    "not_in": (X.not_in("toxic", [1]), "coalesce(toxic NOT IN (1), true)"),
    "between": (X.between("n_chars", 500, 1500), "n_chars BETWEEN 500 AND 1500"),
    "matches": (X.matches("source", "src1[0-5]"), "regexp_full_match(source, 'src1[0-5]')"),
    "exists": (X.exists("quality"), "quality IS NOT NULL"),
    "and": (X.all_of(X.eq("lang", "en"), X.eq("toxic", 0)), "lang = 'en' AND toxic IS NOT DISTINCT FROM 0"),
    "or": (X.any_of(X.eq("lang", "es"), X.eq("toxic", 1)), "lang = 'es' OR toxic IS NOT DISTINCT FROM 1"),
    "nested": (X.all_of(X.any_of(X.eq("lang", "en"), X.eq("lang", "de")), X.any_of(X.gt("n_chars", 2000), X.exists("toxic"))), "lang IN ('en', 'de') AND (n_chars > 2000 OR toxic IS NOT NULL)"),
    "simple_map": ({"lang": ["en", "es"], "n_chars": X.Range(1000, 4000)}, "lang IN ('en', 'es') AND n_chars BETWEEN 1000 AND 4000"),
}


def _filtered(spec: object, compat: bool = False) -> Query:
    return lambda spark, sf_dir: X.apply_filter(_labelled(spark, sf_dir), spec, compat).select("doc_id", "lang")


for _n, (_spec, _where) in _FILTERS.items():
    _query(f"filter_{_n}", f"SELECT doc_id, lang FROM {_LABELLED} WHERE {_where}")(_filtered(_spec))
_query("filter_missing_gte", f"SELECT doc_id, lang FROM {_LABELLED} WHERE coalesce(quality >= 1, true)")(_filtered(X.gte("quality", 1), True))


@_query("filter_lenient", "SELECT p_partkey FROM part WHERE p_size::DOUBLE = 7 OR p_brand = 'Brand#12'")
def filter_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.where(X.lenient_equals(p, "p_size", 7) | X.lenient_equals(p, "p_brand", "Brand#12")).select("p_partkey")


# --- contains on lists and maps ---
@_query("filter_contains_list", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the')")
def filter_contains_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return X.apply_filter(d, X.contains("words", "the")).select("doc_id")


@_query("filter_contains_map", "SELECT doc_id FROM documents WHERE lang = 'en' OR source = 'src1'")
def filter_contains_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key or a value: documents of one source have it as a key."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.create_map(F.when(F.col("source") == "src1", F.lit("en")).otherwise(F.lit("lang")), F.col("lang")).alias("m"))
    return X.apply_filter(d, X.contains("m", "en")).select("doc_id")


@_query("conv_get_or_create", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT -1 - conv_id, 0, 'system', 'Hello.' FROM conversations WHERE conv_id % 3 = 1")
def conv_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    wanted = c.where("conv_id % 3 = 0").select("conv_id").unionByName(c.where("conv_id % 3 = 1").select((-1 - F.col("conv_id")).alias("conv_id")))
    return conversation.get_or_create(c, wanted, "Hello.")


# --- text cleaning ---
_WS = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
_TAGS = "regexp_replace({0}, '<[^>]*>', '', 'g')"
_PUNCT = "regexp_replace({0}, '[\\p{{P}}\\p{{S}}]', '', 'g')"
_MARKS = "regexp_replace(translate({0}, 'ÇÀÁÂÃÈÉÊÌÍÎÒÓÔÕÙÚÛçàáâãèéêìíîòóôõùúû', 'CAAAAEEEIIIOOOOUUUcaaaaeeeiiioooouuu'), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"
_NUMBERS = "regexp_replace({0}, '[0-9]+', '[NUMBER]', 'g')"
_STOPS = "array_to_string(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: NOT list_contains(string_split('o a os as um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para com ao à às e que se não', ' '), lower(w))), ' ')"


def _cleaned(table: str, key: str, column: str, f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: _t(spark, sf_dir, table).select(key, F.md5(f(F.col(column)).cast("binary")).alias("digest"))


def _cleaned_sql(table: str, key: str, column: str, sql: str) -> str:
    return f"SELECT {key}, md5({sql.format(column)}) AS digest FROM {table}"


_STEPS: dict[str, tuple[str, str, str, Callable[[Column], Column], str]] = {
    "whitespace": ("pages", "page_id", "html", text.normalize_whitespace, _WS),
    "html": ("pages", "page_id", "html", text.remove_html, _TAGS),
    "lower": ("documents", "doc_id", "text", F.lower, "lower({0})"),
    "punctuation": ("documents", "doc_id", "text", text.remove_punctuation, _PUNCT),
    "diacritics": ("documents", "doc_id", "text", text.remove_diacritics, _MARKS),
    "numbers": ("documents", "doc_id", "text", text.replace_numbers, _NUMBERS),
    "stopwords": ("documents", "doc_id", "text", text.remove_stopwords, _STOPS),
    "truncate": ("documents", "doc_id", "text", lambda c: text.truncate(c, 200), "substr({0}, 1, 200)"),
}
for _n, (_tab, _key, _col, _f, _s) in _STEPS.items():
    _query(f"prep_{_n}", _cleaned_sql(_tab, _key, _col, _s))(_cleaned(_tab, _key, _col, _f))
_ALL = text.Cleaning(lower=True, punctuation=True, diacritics=True, numbers=True, stopwords=True, max_length=1000)
_all_sql = "{0}"
for _s in (_WS, _TAGS, "lower({0})", _PUNCT, _MARKS, _NUMBERS, _STOPS, "substr({0}, 1, 1000)"):
    _all_sql = _s.replace("{0}", _all_sql)
_query("prep_all", _cleaned_sql("documents", "doc_id", "text", _all_sql))(_cleaned("documents", "doc_id", "text", lambda c: text.clean(c, _ALL)))


# --- chunking: a document's lines are its paragraphs, every fifth one is a header ---
def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(lines, "\n\n").alias("content"))


_MD = "(SELECT doc_id AS id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END), chr(10) || chr(10)) AS content FROM documents)"
_DOCS = "(SELECT doc_id AS id, text AS content FROM documents)"


def _chunk_rows(df: DataFrame) -> DataFrame:
    return df.select("parent_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


def _chunked(strategy: str, source: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, sf_dir: _chunk_rows(chunking.chunk(source(spark, sf_dir), strategy))


def _chunk_sql(source: str, chunks: str) -> str:
    return f"SELECT id AS parent_id, i - 1 AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS digest FROM (SELECT id, {chunks} AS c FROM {source}), unnest(range(1, len(c) + 1)) AS t(i)"


def _merge_sql(units: str) -> str:
    """The fold over units as a reduction whose state is a list: the chunks so far, the last one being filled."""
    joined = "CASE WHEN s[len(s)] <> '' AND length(s[len(s)]) + length(u[1]) > 500 THEN list_concat(s, [right(s[len(s)], 50) || chr(10) || chr(10) || chr(10) || chr(10) || u[1]]) ELSE list_concat(s[:len(s) - 1], [s[len(s)] || CASE WHEN s[len(s)] <> '' THEN chr(10) || chr(10) ELSE '' END || u[1]]) END"
    return f"list_filter(list_reduce(list_prepend([''], list_transform({units}, lambda x: [x])), lambda s, u: {joined}), lambda x: x <> '')"


def _units_sql(marked: str) -> str:
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _windows_sql(t: str, size: int, step: int) -> str:
    return f"list_transform(range(0, length({t}), {step}), lambda i: substr({t}, (i + 1)::INT, {size}))"


# a line of letters and blanks over a line of dashes or of equal signs, or one to six number signs, a blank and a title
_SECTIONS_SQL = _units_sql("regexp_replace(content, '(?m)^(?:#{1,6}\\s.+$|[A-Z][A-Za-z\\s]+\\n[-=]+$)', chr(1) || '\\0', 'g')")
_query("chunk_fixed", _chunk_sql(_DOCS, _windows_sql("content", 500, 450)))(_chunked("fixed", _plain))
_query("chunk_sliding", _chunk_sql(_DOCS, _windows_sql("content", 500, 250)))(_chunked("sliding", _plain))
_query("chunk_fallback", _chunk_sql(_DOCS, _windows_sql("content", 500, 500)))(_chunked("fallback", _plain))
_query("chunk_sentence", _chunk_sql(_DOCS, _merge_sql(_units_sql("regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g')"))))(_chunked("sentence", _plain))
_query("chunk_paragraph", _chunk_sql(_MD, _merge_sql(_units_sql("regexp_replace(content, '\\n\\s*\\n', chr(1), 'g')"))))(_chunked("paragraph", _markdown))
_query("chunk_semantic_basic", ORACLE_SQL["chunk_paragraph"])(_chunked("semantic_basic", _markdown))
_query("chunk_section", _chunk_sql(_MD, _merge_sql(_units_sql(f"regexp_replace(content, '(?m)^(?:#{{1,6}}\\s|<h[1-6]>).*$', chr(1), 'g')"))))(_chunked("section", _markdown))
_nested_step = "CASE WHEN s[len(s)] <> '' AND length(s[len(s)]) + length(u[1]) > 500 THEN list_concat(s, [substr(u[1], 1, 50) || CASE WHEN u[1] <> '' THEN chr(10) || chr(10) ELSE '' END || u[1]]) ELSE list_concat(s[:len(s) - 1], [s[len(s)] || CASE WHEN s[len(s)] <> '' THEN chr(10) || chr(10) ELSE '' END || u[1]]) END"
_query("chunk_hierarchical_basic", _chunk_sql(_MD, f"flatten(list_transform(list_filter(string_split(regexp_replace(content, '(?m)^#+\\s+', chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: list_filter(list_reduce(list_prepend([''], list_transform(string_split(x, chr(10) || chr(10)), lambda p: [p])), lambda s, u: {_nested_step}), lambda y: y <> '')))"))(_chunked("hierarchical_basic", _markdown))
_query("chunk_hybrid", _chunk_sql(_MD, f"flatten(list_transform({_SECTIONS_SQL}, lambda x: CASE WHEN length(x) <= 500 THEN [x] ELSE {_windows_sql('x', 500, 250)} END))"))(_chunked("hybrid", _markdown))
_query("chunk_content_aware")(_chunked("content_aware", _markdown))


@_query("chunk_hierarchical", f"""
WITH s AS (SELECT id, i - 1 AS section_index, x[i] AS content FROM (SELECT id, {_SECTIONS_SQL} AS x FROM {_MD}), unnest(range(1, len(x) + 1)) AS t(i)),
p AS (SELECT id, section_index, j - 1 AS paragraph_index, y[j] AS content FROM (SELECT id, section_index, string_split(content, chr(10) || chr(10)) AS y FROM s), unnest(range(1, len(y) + 1)) AS t(j) WHERE length(y[j]) >= 50),
a AS (SELECT id, 0 AS hierarchy_level, section_index, -1 AS paragraph_index, content FROM s UNION ALL SELECT id, 1, section_index, paragraph_index, content FROM p)
SELECT id AS parent_id, row_number() OVER (PARTITION BY id ORDER BY section_index, paragraph_index) - 1 AS chunk_index, count(*) OVER (PARTITION BY id) AS chunk_count, hierarchy_level::BIGINT AS hierarchy_level,
    section_index, nullif(paragraph_index, -1) AS paragraph_index, md5(content) AS digest FROM a""")
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return chunking.hierarchical(_markdown(spark, sf_dir)).select("parent_id", "chunk_index", "chunk_count", long("hierarchy_level"), long("section_index"), long("paragraph_index"), F.md5(F.col("content").cast("binary")).alias("digest"))


@_query("chunk_semantic_vectors", """
WITH e AS (SELECT label, vec_id, CASE WHEN list_cosine_similarity(lag(embedding::DOUBLE[]) OVER w, embedding::DOUBLE[]) < 0.1 THEN 1 ELSE 0 END AS bound FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
i AS (SELECT label, vec_id, sum(bound) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk_index FROM e)
SELECT label, chunk_index, count(*) AS n_units, string_agg(vec_id::VARCHAR, chr(10) || chr(10) ORDER BY vec_id) AS content FROM i GROUP BY label, chunk_index""")
def chunk_semantic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _t(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.col("vec_id").cast("string").alias("content"))
    return chunking.semantic(units, "label", "vec_id", "content", "embedding", chunking.Chunking(threshold=0.1))


# paragraphs as token counts in 64 buckets; two neighbours without a common bucket have no row in near
_SEMANTIC_SQL = f"""
WITH d AS (SELECT id, content, {_units_sql("replace(content, chr(10) || chr(10), chr(1))")} AS u FROM {_MD}),
p AS (SELECT id, i - 1 AS place, u[i] AS content FROM d, unnest(range(1, len(u) + 1)) AS t(i)),
t AS (SELECT id, place, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM p),
v AS (SELECT id, place, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT id, place, sqrt(sum(n * n)) AS size FROM v GROUP BY ALL),
near AS (SELECT b.id, b.place, sum(a.n * b.n) / (any_value(sa.size) * any_value(sb.size)) AS cosine FROM v a JOIN v b ON b.id = a.id AND b.place = a.place + 1 AND b.bucket = a.bucket JOIN s sa ON sa.id = a.id AND sa.place = a.place JOIN s sb ON sb.id = b.id AND sb.place = b.place GROUP BY b.id, b.place),
m AS (SELECT p.*, sum(CASE WHEN p.place > 0 AND coalesce(cosine, 0) < 0.301 THEN 1 ELSE 0 END) OVER (PARTITION BY p.id ORDER BY p.place) AS island FROM p LEFT JOIN near n ON n.id = p.id AND n.place = p.place),
g AS (SELECT id, island, string_agg(content, chr(10) || chr(10) ORDER BY place) AS content FROM m GROUP BY id, island),
c AS (SELECT id, CASE WHEN count(*) > 1 THEN flatten(list(CASE WHEN length(content) > 500 THEN {_windows_sql("content", 500, 500)} ELSE [content] END ORDER BY island)) END AS cut FROM g GROUP BY id),
x AS (SELECT d.id, coalesce(c.cut, {_windows_sql("content", 500, 500)}) AS c FROM d LEFT JOIN c ON c.id = d.id)
SELECT id AS parent_id, i - 1 AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS digest FROM x, unnest(range(1, len(c) + 1)) AS t(i)"""


@_query("chunk_semantic", _SEMANTIC_SQL)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk(_markdown(spark, sf_dir), "semantic", chunking.Chunking(threshold=0.301)))


# --- extraction ---
_HTML = "html"
for _p in ("(?is)<script\\b[^>]*>.*?</script\\s*>", "(?is)<style\\b[^>]*>.*?</style\\s*>", "(?s)<!--.*?-->", "<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '', 'g')"
_HTML = f"replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@_query("html_extract", f"SELECT page_id, md5(regexp_replace(regexp_replace({_HTML}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) AS title FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(extract.html_text(F.col("html")).cast("binary")).alias("digest"), extract.html_title(F.col("html")).alias("title"))


@_query("html_meta", "SELECT page_id, 'page ' || page_id AS author, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) AS title, 2 AS n FROM pages")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.lit('<meta name="title" content="other"><META property="author" content="page '), F.col("page_id"), F.lit('">'), F.col("html"))
    m = _t(spark, sf_dir, "pages").select("page_id", extract.html_metadata(tagged).alias("m"))
    return m.select("page_id", F.try_element_at("m", F.lit("author")).alias("author"), F.try_element_at("m", F.lit("title")).alias("title"), F.size("m").alias("n"))


@_query("md_frontmatter", "SELECT doc_id, source AS title, lang AS tag, 2 AS n, md5(text) AS digest FROM documents")
def md_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("---\ntitle: first\ntitle: "), F.col("source"), F.lit("\nempty:\ntag : "), F.col("lang"), F.lit("\n---\n"), F.col("text"))
    d = _t(spark, sf_dir, "documents").select("doc_id", extract.front_matter(t).alias("m"), extract.without_front_matter(t).alias("c"))
    return d.select("doc_id", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("tag")).alias("tag"), F.size("m").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@_query("route_extractor", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.html?$') THEN 'html' ELSE 'text' END AS format, 'html' AS of_mime FROM pages")
def route_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", extract.format_of_name(F.col("url")).alias("format"), extract.format_of_mime(F.lit("text/html; charset=utf-8")).alias("of_mime"))


@_query("csv_products", "SELECT p_partkey::VARCHAR AS id, p_name || chr(10) || p_type || chr(10) || 'Category: ' || p_brand || chr(10) || 'Price: ' || printf('%.2f', p_retailprice) AS content, p_brand AS category FROM part")
def csv_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"))
    return files.products(p).select("id", "content", F.element_at("metadata", "category").alias("category"))


@_query("row_documents", "SELECT c_custkey::VARCHAR AS id, 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS content, c_mktsegment AS segment FROM customer")
def row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.row_documents(_t(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"]).select("id", "content", F.element_at("metadata", "c_mktsegment").alias("segment"))


@_query("metadata_merge", "SELECT doc_id, source AS source, 'x' AS kind, lang AS lang, 3 AS n FROM documents")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _t(spark, sf_dir, "documents").withColumn("metadata", F.create_map(F.lit("source"), F.col("source"), F.lit("kind"), F.lit("w")))
    m = base.withColumn("metadata", extract.merge_metadata(F.col("metadata"), F.create_map(F.lit("kind"), F.lit("x"), F.lit("lang"), F.col("lang"))))
    return m.select("doc_id", *(F.element_at("metadata", k).alias(k) for k in ("source", "kind", "lang")), F.size("metadata").alias("n"))


# --- reranking: 20 candidates for every vector ---
_CANDIDATES = _topk_sql(_COS, k=20).replace("round(score, 6) AS score", "score")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, queries = _store(spark, sf_dir)
    return retrieval.search(store, queries, k=20).join(store, "id").select("query_id", "id", "score", "embedding", "label")


_MMR = """
WITH RECURSIVE c AS MATERIALIZED ({candidates}),
v AS MATERIALIZED (SELECT c.query_id, c.id, c.rank::INT AS rank, c.score, e.embedding::DOUBLE[] AS x FROM c JOIN embeddings e ON e.vec_id = c.id),
near AS MATERIALIZED (SELECT a.query_id, a.rank AS i, b.rank AS j, {similar} AS sim FROM v a JOIN v b ON a.query_id = b.query_id),
step AS (
    SELECT query_id, 1 AS n, [rank] AS picked, [score] AS values FROM v WHERE rank = 1
    UNION ALL
    SELECT query_id, n + 1, list_append(picked, best.i), list_append(values, best.value) FROM (
        SELECT s.query_id, s.n, s.picked, s.values, arg_max({{'i': v.rank, 'value': {value}}}, {{'a': round({value}, 9), 'b': -v.rank}}) AS best
        FROM step s JOIN v ON v.query_id = s.query_id
        JOIN LATERAL (SELECT max({product}) AS worst FROM near m WHERE m.query_id = s.query_id AND m.i = v.rank AND list_contains(s.picked, m.j)) w ON true
        WHERE s.n < 5 AND NOT list_contains(s.picked, v.rank) GROUP BY s.query_id, s.n, s.picked, s.values)
)
SELECT d.query_id, k AS rank, v.id, round(d.values[k], 6) AS mmr_score FROM (SELECT query_id, arg_max(picked, n) AS picked, arg_max(values, n) AS values FROM step GROUP BY query_id) d, unnest(range(1, len(picked) + 1)) AS t(k), v WHERE v.query_id = d.query_id AND v.rank = d.picked[k]"""


@_query("rerank_mmr", _MMR.format(candidates=_CANDIDATES, similar="greatest(0, list_cosine_similarity(a.x, b.x))", product="m.sim", value="0.3 * v.score - 0.7 * w.worst"))
def rerank_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.mmr(_candidates(spark, sf_dir), 5, 0.3).select("query_id", "rank", "id", F.round("mmr_score", 6).alias("mmr_score"))


@_query("rerank_mmr_proxy", _MMR.format(candidates=_CANDIDATES, similar="a.score", product="m.sim * s.values[list_position(s.picked, m.j)]", value="0.3 * v.score + 0.7 * (1 - w.worst)"))
def rerank_mmr_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.mmr_by_score(_candidates(spark, sf_dir), 5, 0.3).select("query_id", "rank", "id", F.round("mmr_score", 6).alias("mmr_score"))


def _ranked_sql(score: str, where: str = "true", limit: int = 5) -> str:
    return f"SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, id, {score} AS s FROM ({_CANDIDATES}) c JOIN embeddings e ON e.vec_id = c.id)) WHERE rank <= {limit} AND s >= 0 AND {where}"


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@_query("rerank_cross", _ranked_sql("score"))
def rerank_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(rerank.cross_encode(_candidates(spark, sf_dir)))


@_query("rerank_boost", _ranked_sql("score * CASE WHEN label % 2 = 0 THEN 1.5 ELSE 1.0 END"))
def rerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).withColumn("important", F.when(F.col("label") % 2 == 0, F.lit(False)))
    return _out(rerank.boost(c, {"important": 1.5}))


@_query("rerank_ensemble", _ranked_sql("(score * 2 + CASE WHEN label < 5 THEN score * score ELSE 0 END) / 3"))
def rerank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    squared = c.where("label < 5").select("query_id", "id", (F.col("score") * F.col("score")).alias("score"))
    return _out(rerank.ensemble(c, [(c, 2.0), (squared, 1.0)]))


@_query("rerank_composite", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM (SELECT c.query_id, c.id, c.score FROM ({_CANDIDATES}) c WHERE c.rank <= 10) QUALIFY rank <= 3")
def rerank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(rerank.composite(_candidates(spark, sf_dir), lambda d: rerank.take(d, 10), lambda d: rerank.take(d, 3)))


# --- context, prompt, answer: vector n stands for document n ---
def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang")
    return retrieval.search(*_store(spark, sf_dir), k=3).join(docs, "id")


_HITS = f"(SELECT r.query_id, r.rank, r.id, r.score, d.text AS content, d.source, d.lang FROM ({_topk_sql(_COS, k=3).replace("round(score, 6) AS score", "score")}) r JOIN documents d ON d.doc_id = r.id)"
_CONTEXT = f"SELECT query_id, string_agg('Source: ' || source || chr(10) || 'Date:' || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_docs FROM {_HITS} GROUP BY query_id"
_QUESTION = "'Which label has ' || query_id || '?'"
_PROMPT_SQL = f"SELECT query_id, context, n_docs, 'Use this context.' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Asked: ' || {_QUESTION} || chr(10) || 'Answer:' AS prompt FROM ({_CONTEXT})"


def _prompts(spark: SparkSession, sf_dir: str, scores: bool = False) -> DataFrame:
    question = F.concat(F.lit("Which label has "), F.col("query_id"), F.lit("?"))
    return prompting.contexts(_hits(spark, sf_dir), scores=scores).withColumn("prompt", prompting.prompt(F.col("context"), question))


@_query("build_context", f"SELECT query_id, n_docs, md5(context) AS digest FROM ({_CONTEXT})")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompting.contexts(_hits(spark, sf_dir)).select("query_id", "n_docs", F.md5(F.col("context").cast("binary")).alias("digest"))


@_query("build_prompt", f"SELECT query_id, md5(prompt) AS digest FROM ({_PROMPT_SQL})")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@_query("prompt_formatter", f"SELECT query_id, md5(string_agg('Document ' || rank || ' [Similarity: ' || printf('%.2f', score) || ']' || chr(10) || 'lang: ' || lang || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS digest FROM {_HITS} GROUP BY query_id")
def prompt_formatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    return prompting.formatted_contexts(h, prompting.PromptOptions(scores=True, keys=("lang",))).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@_query("mock_llm", f"""SELECT query_id, '[detailed and creative] From the context: ' || CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS answer FROM (
    SELECT query_id, array_to_string(list_transform(list_filter(string_split(prompt, chr(10)), lambda x: length(x) > 30)[:2], lambda x: trim(x)), ' ') AS t FROM ({_PROMPT_SQL}))""")
def mock_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompting.generate(_prompts(spark, sf_dir)).select("query_id", "answer")


@_query("response_summary", f"""SELECT query_id, count(*) AS n_docs, arg_min(id, rank) AS top_id, round(avg(score), 4) AS avg_score,
    array_to_string(list_transform(list_sort(list(DISTINCT {{'r': r, 's': source}})), lambda x: x.s), ', ') AS sources FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS r FROM {_HITS}) GROUP BY query_id""")
def response_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompting.summaries(_hits(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 4))


@_query("doc_id_sha", "SELECT doc_id, 'doc-' || substr(sha256(text), 1, 32) AS id FROM documents")
def doc_id_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", ids.content_id(F.col("text")).alias("id"))


@_query("doc_id_hash", "SELECT doc_id, 'doc-' || printf('%x', abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)) AS id FROM (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM documents)")
def doc_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", ids.legacy_id(F.col("text")).alias("id"))


# --- conversations ---
@_query("conv_last_n", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def conv_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_messages(_t(spark, sf_dir, "conversations"), 3)


def _history_sql(where: str) -> str:
    return f"""WITH m AS (SELECT conv_id, turn, lower(role) AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE {where}),
x AS (SELECT *, bool_or(back = 1 AND role = 'user') OVER (PARTITION BY conv_id) AS asks FROM m WHERE back <= 3)
SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE NOT (asks AND back = 1)), '') AS history, max(text) FILTER (WHERE asks AND back = 1) AS question FROM x GROUP BY conv_id"""


@_query("conv_history", _history_sql("true"))
def conv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.histories(_t(spark, sf_dir, "conversations"), 3)


@_query("conv_no_system", _history_sql("lower(role) <> 'system'"))
def conv_no_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.histories(_t(spark, sf_dir, "conversations"), 3, system=False)


@_query("conv_add", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'And then?' FROM conversations GROUP BY conv_id")
def conv_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = c.select("conv_id").distinct().select("conv_id", F.lit("user").alias("role"), F.lit("And then?").alias("text"), F.lit(0).alias("seq"))
    return conversation.add_messages(c, more)


@_query("conv_documents", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT turn)), ',') AS documents FROM conversations GROUP BY conv_id")
def conv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("doc_id"))
    return conversation.documents_of(links.unionByName(links)).select("conv_id", F.array_join("document_ids", ",").alias("documents"))


# --- metrics, caches, batches ---
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "ts", "event_id")


@_query("metrics_timer", """WITH s AS (SELECT event_type AS name, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT name, len(v) AS n, v[1] AS min, v[len(v)] AS max, round(list_avg(v), 6) AS mean, v[50 * (len(v) - 1) // 100 + 1] AS p50, v[90 * (len(v) - 1) // 100 + 1] AS p90, v[95 * (len(v) - 1) // 100 + 1] AS p95, v[99 * (len(v) - 1) // 100 + 1] AS p99 FROM s""")
def metrics_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timers(_samples(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@_query("metrics_counter", "SELECT event_type AS name, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def metrics_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(_samples(spark, sf_dir)).withColumn("total", F.round("total", 4))


@_query("metrics_gauge", "SELECT event_type AS name, arg_max(value, {'ts': ts, 'id': event_id}) AS last FROM events GROUP BY event_type")
def metrics_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauges(_samples(spark, sf_dir))


@_query("metrics_windowed", "SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def metrics_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.windowed(_samples(spark, sf_dir)).withColumn("total", F.round("total", 4))


@_query("cache_hits", "SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) / count(*)::DOUBLE AS hit_rate FROM (SELECT text IN (SELECT text FROM documents WHERE lang = 'en') AS hit FROM documents)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("text").alias("content"), "lang")
    return cache.hits(d, d.where("lang = 'en'").select(cache.key_of(F.col("content")).alias("key")))


@_query("cache_lru", "SELECT user_id AS key FROM events GROUP BY user_id ORDER BY max({'ts': ts, 'id': event_id}) DESC, user_id LIMIT 100")
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.retained(_t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id"), 100)


@_query("embed_hashing", """WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")
def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hashing_vectors(_t(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@_query("batch_ids", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 20 AS place FROM documents")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_ids(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@_query("priority_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.by_priority(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), "o_orderkey")


@_query("error_answers", """SELECT o_orderkey, CASE o_custkey % 8 WHEN 0 THEN 'The question could not be embedded.' WHEN 1 THEN 'The documents could not be searched.' WHEN 2 THEN 'No answer could be generated.' WHEN 3 THEN 'The request took too long.'
    WHEN 4 THEN 'There are too many requests now.' WHEN 5 THEN 'The service is not available now.' WHEN 6 THEN 'The request failed.' END AS answer FROM orders""")
def error_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("embedding", "store", "generation", "timeout", "rate_limit", "breaker", "of another kind")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", batch.error_answer(F.get(kinds, (F.col("o_custkey") % 8).cast("int"))).alias("answer"))


@_query("fallback_results", f"SELECT doc_id, coalesce(quality, 0)::BIGINT AS quality FROM {_LABELLED}")
def fallback_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", batch.first_result(F.col("quality"), F.lit(0)).cast("long").alias("quality"))


@_query("breaker_trace")
def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return batch.breaker_states(e, "user_id", ["ts", "event_id"], "failed", failures=2)


# --- levels of a cache: English documents in the first, those of even number in the second ---
@_query("cache_levels", "SELECT md5(text) AS digest, min(CASE WHEN lang = 'en' THEN 0 WHEN doc_id % 2 = 0 THEN 1 END) AS level FROM documents GROUP BY text")
def cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "lang", "doc_id", F.lit(None).cast("array<float>").alias("embedding"))
    return cache.read_through([d.where("lang = 'en'"), d.where("doc_id % 2 = 0")], d).select(F.col("key").alias("digest"), "level")


@_query("cache_promoted", "SELECT count(DISTINCT text) FILTER (WHERE lang = 'en' OR doc_id % 2 = 0) AS in_first, count(DISTINCT text) FILTER (WHERE doc_id % 2 = 0) AS in_second FROM documents")
def cache_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(cache.key_of(F.col("text")).alias("key"), "lang", "doc_id", F.lit(None).cast("array<float>").alias("embedding"))
    first, second = cache.promote([d.where("lang = 'en'"), d.where("doc_id % 2 = 0")], d)
    return first.agg(F.count_distinct("key").alias("in_first")).crossJoin(second.agg(F.count_distinct("key").alias("in_second")))


@_query("process_items", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'order ' || o_orderkey END AS result, o_orderkey % 7 <> 0 AS ok, CASE WHEN o_orderkey % 7 = 0 THEN 'generation' END AS error_type, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM orders")
def process_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(key: int) -> str:
        if key % 7 == 0:
            raise batch.GenerationError("a seventh order")
        return f"order {key}"

    done = batch.process_items(_t(spark, sf_dir, "orders").select("o_orderkey"), call, "o_orderkey", size=200, retry=batch.Retry(2, 0.0), concurrency=8)
    return done.select("o_orderkey", "result", "ok", "error_type", F.col("attempts").cast("int").alias("attempts"))


@_query("url_documents", f"""SELECT url AS id, CASE page_id % 3 WHEN 0 THEN md5(regexp_replace(regexp_replace({_HTML}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) WHEN 1 THEN md5(html) END AS digest FROM pages""")
def url_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages routed by MIME type: a third each as HTML, as plain text and as PDF, which has no reader."""
    p = _t(spark, sf_dir, "pages").withColumn("mime", F.get(F.array(F.lit("text/html; charset=utf-8"), F.lit("text/plain"), F.lit("application/pdf")), (F.col("page_id") % 3).cast("int")))
    return files.page_documents(p.select("url", "mime", F.col("html").alias("body"), F.lit(None).cast("string").alias("error"))).select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


# --- all together ---
@_query("ask_end_to_end", f"""SELECT query_id, '[detailed and creative] From the context: ' || CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS answer, n_docs, avg_score FROM (
    SELECT p.query_id, n_docs, a.avg_score, array_to_string(list_transform(list_filter(string_split(prompt, chr(10)), lambda x: length(x) > 30)[:2], lambda x: trim(x)), ' ') AS t FROM ({_PROMPT_SQL}) p JOIN (SELECT query_id, round(avg(score), 4) AS avg_score FROM {_HITS} GROUP BY query_id) a ON a.query_id = p.query_id)""")
def ask_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search and one gathering of texts; the mock answers beside a prompt's numbers."""
    answer = prompting.mock_answer(F.col("prompt"), options=prompting.GenerationOptions())
    return _prompts(spark, sf_dir, scores=True).select("query_id", answer.alias("answer"), "n_docs", F.round("avg_score", 4).alias("avg_score"))
