"""Queries over search, chunking, ingest, registry and evaluation, with the SQL that must give the same.

The index tables of the test data serve as the index: ``bm25_terms`` as postings, ``chunks``
as chunks, ``embeddings`` as vectors by ``vec_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumdex.functions import text as tx
from vellumdex.functions.providers import HashEmbedder, embedding_of
from vellumdex.operators import context, evaluation, fusion, lexical, vector
from vellumdex.plans.engine import document_changes, without_documents
from vellumdex.plans.sql_text import HAN, WORDS, sql_norm
from vellumdex.session import table
from vellumdex.sources import markdown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---- SQL that several queries share

_PAIRS = f"flatten(list_transform(regexp_extract_all(n, '{HAN}+'), lambda r: case when length(r) < 2 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))"


def _tokens(norm: str) -> str:
    return f"(select list_concat(regexp_extract_all(n, '{WORDS}'), {_PAIRS}) from (select {norm} as n))"


_CHUNKS = "chunks1 as (select id, min(doc_id) as doc_id, max(token_count) as token_count, min(collection_id) as collection_id, min(embedding_hash) as embedding_hash, min(search_text) as search_text from chunks group by id)"
_POSTINGS = "postings as (select chunk_rowid as id, term, max(tf) as tf from bm25_terms where tf >= 1 and term is not null group by all)"
_STATS = "stats as (select term, count(*) as df from postings group by term), corpus as (select count(*) as doc_count, coalesce(avg(token_count), 0) as avgdl from chunks1)"


def _bm25(asked: str, where: str = "true") -> str:
    return f"""{_CHUNKS}, {_POSTINGS}, {_STATS}, asked as ({asked}),
      scores as (
        select a.query_id, p.id, round(sum(ln(1 + (doc_count - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * c.token_count / avgdl))), 9) as score
        from asked a join postings p using (term) join stats using (term) join chunks1 c on c.id = p.id, corpus
        where c.token_count is not null and avgdl > 0 and {where} and tf + 1.5 * (0.25 + 0.75 * c.token_count / avgdl) > 0 group by all),
      ranked as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from scores)"""


# ---- the index of the test data


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk id; repeated rows agree in what is taken of them."""
    least = [F.min(c).alias(c) for c in ("doc_id", "collection_id", "embedding_hash", "search_text")]
    return table(spark, sf_dir, "chunks").groupBy("id").agg(F.max("token_count").alias("token_count"), *least)


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bm25_terms").where("tf >= 1 and term is not null")
    return rows.groupBy(F.col("chunk_rowid").alias("id"), "term").agg(F.max("tf").alias("tf"))


def _light_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("id").agg(F.max("token_count").alias("token_count"), F.min("collection_id").alias("collection_id"))


# ---- full text


@query(f"with t as (select id, {_tokens(sql_norm('search_text'))} as toks from chunks) select id, array_to_string(toks, ' ') as tokens, cast(len(toks) as bigint) as n_tokens from t where toks is not null")
def tokenize_terms(spark, sf_dir):
    """Search tokens of every chunk row."""
    rows = table(spark, sf_dir, "chunks").where("search_text is not null").select("id", tx.search_tokens(tx.nfkc_lower("search_text")).alias("t"))
    return rows.select("id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@query(f"with {_CHUNKS}, t as (select id, unnest({_tokens(sql_norm('search_text'))}) as term from chunks1) select id, term, cast(count(*) as int) as tf from t group by all")
def term_frequency(spark, sf_dir):
    """Postings of all chunks, made from their texts."""
    return lexical.postings_of(index_chunks(spark, sf_dir))


@query(f"with {_POSTINGS} select term, count(*) as df from postings group by term")
def document_frequency(spark, sf_dir):
    return lexical.document_frequencies(index_postings(spark, sf_dir))


@query(f"with {_CHUNKS} select count(*) as doc_count, round(coalesce(avg(token_count), 0), 9) as avgdl from chunks1")
def corpus_scalars(spark, sf_dir):
    return lexical.corpus_scalars(_light_chunks(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 9))


@query(f"select id, cast(len(regexp_extract_all({sql_norm('search_text')}, '{HAN}|{WORDS}')) as int) as n_atoms from chunks where search_text is not null")
def rough_token_count(spark, sf_dir):
    """Atoms of every chunk row's search text."""
    return table(spark, sf_dir, "chunks").where("search_text is not null").select("id", tx.atom_count(tx.nfkc_lower("search_text")).alias("n_atoms"))


_ONE = "select 0 as query_id, unnest(['cache', 'sensor', 'scheduler', '词项']) as term"


@query(f"with {_bm25(_ONE)} select id, score, rank from ranked where rank <= 20")
def bm25_topk(spark, sf_dir):
    """One query against all chunks."""
    return lexical.bm25_topk(spark, "Cache sensor  SCHEDULER 词项", index_postings(spark, sf_dir), _light_chunks(spark, sf_dir))


@query(f"with {_bm25(_ONE)} select id, score, rank from ranked where rank <= 20")
def bm25_duplicate_terms(spark, sf_dir):
    """Repeated query terms count once."""
    return lexical.bm25_topk(spark, "cache sensor scheduler cache 词项 sensor", index_postings(spark, sf_dir), _light_chunks(spark, sf_dir))


_DEFAULTS = "(select collection_id from collections where include_by_default or not exists (select 1 from collections where include_by_default))"


def _default_collections(spark, sf_dir) -> DataFrame:
    """Collections searched by default: the marked ones, else all."""
    rows = table(spark, sf_dir, "collections").select("collection_id", F.coalesce("include_by_default", F.lit(False)).alias("marked"))
    chosen = rows.withColumn("any", F.max("marked").over(Window.partitionBy()))  # the registry's few rows
    return chosen.where("marked or not any").select("collection_id")


def default_ids(spark, sf_dir) -> list[str]:
    return [r["collection_id"] for r in _default_collections(spark, sf_dir).collect()]


@query(f"with {_bm25(_ONE, 'c.collection_id in ' + _DEFAULTS)} select id, score, rank from ranked where rank <= 20")
def bm25_topk_filtered(spark, sf_dir):
    """The filter by collection comes before the cut; the statistics stay those of the whole index."""
    return lexical.bm25_topk(spark, "cache sensor scheduler 词项", index_postings(spark, sf_dir), _light_chunks(spark, sf_dir), collections=default_ids(spark, sf_dir))


_ASKED = f"""select distinct query_id, unnest({_tokens("trim(regexp_replace(regexp_replace(" + sql_norm("query") + r", '[\x{2010}-\x{2015}]', '-', 'g'), '\s+', ' ', 'g'))")}) as term
  from (select query_id, min(query) as query from search_results where query is not null group by query_id)"""


def stored_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "search_results").where("query is not null").groupBy("query_id").agg(F.min("query").alias("query"))


def _batch(spark, sf_dir, k: int) -> DataFrame:
    terms = lexical.query_terms(stored_queries(spark, sf_dir))
    return lexical.top_k(lexical.bm25_scores(terms, index_postings(spark, sf_dir), _light_chunks(spark, sf_dir)), k)


@query(f"with {_bm25(_ASKED)} select query_id, id, score, rank from ranked where rank <= 10")
def bm25_batch(spark, sf_dir):
    """All stored queries against all chunks in one plan."""
    return _batch(spark, sf_dir, 10)


@query(f"select query_id, trim(regexp_replace(regexp_replace({sql_norm('query')}" + r", '[\x{2010}-\x{2015}]', '-', 'g'), '\s+', ' ', 'g')) as query from (select query_id, min(query) as query from search_results where query is not null group by query_id)")
def query_normalize(spark, sf_dir):
    return stored_queries(spark, sf_dir).select("query_id", tx.query_text_col(F.col("query")).alias("query"))


@query(f"select doc_id, array_to_string((select {_PAIRS} from (select {sql_norm('title')} as n)), ' ') as pairs from documents where title is not null")
def cjk_bigrams(spark, sf_dir):
    """Character pairs of titles."""
    return table(spark, sf_dir, "documents").where("title is not null").select("doc_id", F.array_join(tx.cjk_bigrams_of(tx.nfkc_lower("title")), " ").alias("pairs"))


@query(f"select doc_id, array_to_string((select {_PAIRS} from (select {sql_norm('text')} as n)), ' ') as pairs from documents where text is not null")
def cjk_bigrams_text(spark, sf_dir):
    """Character pairs of whole texts."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(tx.cjk_bigrams_of(tx.nfkc_lower("text")), " ").alias("pairs"))


# ---- vectors

_DOT = "list_inner_product(cast(v.embedding as double[]), cast(q.embedding as double[]))"


def _first_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"with s as (select v.vec_id, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id = 0) select vec_id, score, cast(row_number() over (order by score desc, vec_id) as int) as rank from s qualify rank <= 20")
def vector_topk(spark, sf_dir):
    """One query vector against all vectors."""
    return vector.vector_topk(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir))


@query(f"with s as (select v.vec_id, v.label, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id = 0), t as (select *, cast(row_number() over (order by score desc, vec_id) as int) as rank from s qualify rank <= 20) select vec_id, score, rank from t where label % 2 = 0")
def vector_topk_postfilter(spark, sf_dir):
    """The filter comes after the cut, so that fewer rows may be left."""
    vectors = table(spark, sf_dir, "embeddings")
    best = vector.vector_topk(vectors, _first_vector(spark, sf_dir))
    return best.join(vectors.where("label % 2 = 0").select("vec_id"), "vec_id", "left_semi")


@query(f"with s as (select q.vec_id as query_id, v.vec_id, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id % 20 = 0) select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s qualify rank <= 10")
def vector_batch_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.vector_batch_topk(vectors, queries, 10)


@query("with s as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * vec_id) as v from embeddings), n as (select vec_id, v, sqrt(list_inner_product(v, v)) as norm from s) select vec_id, round(norm, 6) as norm, round(case when norm > 0 then v[1] / norm else v[1] end, 6) + 0.0 as first from n")
def l2_normalize(spark, sf_dir):
    """Scaled vectors back to unit length; the zero vector stays."""
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("vec_id")).alias("v"))
    return scaled.select("vec_id", F.round(vector.l2_norm(F.col("v")), 6).alias("norm"), (F.round(F.get(vector.l2_normalized(F.col("v")), 0), 6) + F.lit(0.0)).alias("first"))


@query("select cast(len(embedding) as int) as dim, count(*) as n from embeddings group by all")
def vector_dim_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    vector.dimension_of(vectors)
    return vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


_CACHE = "cache as (select c.embedding_hash, min(v.vec_id) as vec_id from chunks c join embeddings v on v.vec_id = c.id where c.embedding_hash is not null group by c.embedding_hash)"


def _cache(spark, sf_dir) -> DataFrame:
    """A vector cache: the vector whose id is the chunk's, by the chunk's content hash."""
    hashes = table(spark, sf_dir, "chunks").where("embedding_hash is not null").select("id", "embedding_hash")
    vectors = table(spark, sf_dir, "embeddings")
    first = hashes.join(vectors, hashes["id"] == vectors["vec_id"]).groupBy("embedding_hash").agg(F.min("vec_id").alias("vec_id"))
    return first.join(vectors.select("vec_id", "embedding"), "vec_id")


@query(f"with {_CACHE} select c.id, round(cast(v.embedding[1] as double), 6) as first from chunks c join cache using (embedding_hash) join embeddings v using (vec_id)")
def vectors_for_chunks(spark, sf_dir):
    """Vectors of chunks by content hash, shared by equal contents."""
    found = vector.checked_vectors(table(spark, sf_dir, "chunks"), _cache(spark, sf_dir))
    return found.select("id", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


@query(f"with {_CACHE} select embedding_hash, sha256(min(search_text)) as text_hash from chunks where embedding_hash is not null and embedding_hash not in (select embedding_hash from cache) group by embedding_hash")
def embedding_cache_misses(spark, sf_dir):
    """Contents that have no vector yet, each once."""
    lacking = vector.missing_vectors(table(spark, sf_dir, "chunks"), _cache(spark, sf_dir))
    return lacking.select("embedding_hash", tx.sha256_hex(F.col("text")).alias("text_hash"))


@query("select embedding_hash, count(*) as n_rows from chunks where embedding_hash is not null group by all")
def embedding_dedup(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("embedding_hash is not null").groupBy("embedding_hash").agg(F.count("*").alias("n_rows"))


@query()
def hash_embeddings(spark, sf_dir):
    """Vectors of all chunks by the offline embedder, through its Arrow UDF."""
    return index_chunks(spark, sf_dir).select("id", embedding_of(HashEmbedder(), F.col("search_text")).alias("embedding"))


# ---- fusion

_LISTS = """lists as (select query_id, chunk_rowid, min(vector_rank) as v, min(bm25_rank) as b, max(fusion_score) as fusion_score, max(case when isnan(rerank_score) then null else rerank_score end) as rerank_score,
    min(doc_id) as doc_id, max(coalesce(case when isnan(rerank_score) then null else rerank_score end, case when isnan(fusion_score) then null else fusion_score end)) as final_score from search_results group by all)"""


def stored_results(spark, sf_dir) -> DataFrame:
    """One row per query and result; NaN scores count as missing."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return table(spark, sf_dir, "search_results").groupBy("query_id", "chunk_rowid").agg(
        F.min("vector_rank").alias("vector_rank"), F.min("bm25_rank").alias("bm25_rank"), F.max(real("fusion_score")).alias("fusion_score"),
        F.max(real("rerank_score")).alias("rerank_score"), F.min("doc_id").alias("doc_id"), F.max(F.coalesce(real("rerank_score"), real("fusion_score"))).alias("final_score"),
    )


_RRF = f"""{_LISTS}, r as (select query_id, chunk_rowid, v as vector_rank, b as bm25_rank, coalesce(1.0::double / (60 + v), 0) + coalesce(1.0::double / (60 + b), 0) as s from lists where v is not null or b is not null),
  fused as (select query_id, chunk_rowid, vector_rank, bm25_rank, round(s, 12) as fusion_score, cast(row_number() over (partition by query_id order by round(s, 12) desc, vector_rank nulls last, bm25_rank nulls last, chunk_rowid) as int) as position from r)"""


def _fused(spark, sf_dir) -> DataFrame:
    rows = stored_results(spark, sf_dir)
    ranked = lambda c: rows.where(F.col(c).isNotNull()).select("query_id", "chunk_rowid", F.col(c).alias("rank"))
    return fusion.reciprocal_rank_fusion(ranked("vector_rank"), ranked("bm25_rank"), "chunk_rowid").withColumn("fusion_score", F.round("fusion_score", 12))


@query(f"with {_RRF} select query_id, chunk_rowid, fusion_score, vector_rank, bm25_rank from fused")
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of the stored vector and full-text ranks of every query."""
    return _fused(spark, sf_dir).drop("position")


_TIES = """v as (select * from (values (1, 'a', 1), (1, 'b', 2), (2, 'a', 1), (2, 'b', 2)) t(query_id, id, rank)), b as (select * from (values (1, 'b', 1), (1, 'a', 2), (2, 'b', 1), (2, 'c', 2)) t(query_id, id, rank)),
  r as (select query_id, id, v.rank as v, b.rank as b, coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as s from v full join b using (query_id, id))"""


@query(f"with {_TIES} select query_id, id, cast(row_number() over (partition by query_id order by round(s, 12) desc, v nulls last, b nulls last) as int) as position from r")
def rrf_tie_order(spark, sf_dir):
    """Equal scores: vector hits first, in their order, then full-text hits in theirs."""
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "b", 1), (2, "c", 2)], "query_id int, id string, rank int")
    return fusion.reciprocal_rank_fusion(v, b).select("query_id", "id", "position")


_PLACED = f"{_LISTS}, placed as (select *, cast(row_number() over (partition by query_id order by final_score desc nulls last, chunk_rowid) as int) as p from lists)"
_DIVERSE = f"""{_PLACED}, nth as (select *, row_number() over (partition by query_id, doc_id order by p) as n from placed),
  diverse as (select query_id, chunk_rowid, doc_id, final_score, cast(row_number() over (partition by query_id order by case when n > 1 then 1 else 0 end, p) as int) as position from nth qualify position <= 10)"""


def _placed(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("final_score"), "chunk_rowid")
    return stored_results(spark, sf_dir).withColumn("position", F.row_number().over(order))


@query(f"with {_DIVERSE} select query_id, chunk_rowid, doc_id, position from diverse")
def doc_diversity(spark, sf_dir):
    """The first result of each document before further ones, cut to ten."""
    return fusion.diversify(_placed(spark, sf_dir), 10).select("query_id", "chunk_rowid", "doc_id", "position")


@query(f"with {_DIVERSE} select query_id, chunk_rowid, cast(row_number() over (partition by query_id order by final_score desc nulls last, position) as int) as position from diverse")
def fulltext_resort(spark, sf_dir):
    """The cut list ordered by score again."""
    return fusion.resort_by_score(fusion.diversify(_placed(spark, sf_dir), 10)).select("query_id", "chunk_rowid", "position")


@query(f"""with {_LISTS}, f as (select *, row_number() over (partition by query_id order by fusion_score desc nulls last, chunk_rowid) as p from lists)
  select query_id, chunk_rowid, round(case when p <= 5 then rerank_score else fusion_score end, 9) as fusion_score,
    cast(row_number() over (partition by query_id order by case when p <= 5 then 0 else 1 end, case when p <= 5 then rerank_score end desc nulls last, p) as int) as position from f""")
def rerank_prefix(spark, sf_dir):
    """The first five by fused score in the order of the stored rerank scores, the rest as before."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("fusion_score"), "chunk_rowid")
    rows = stored_results(spark, sf_dir).withColumn("position", F.row_number().over(order)).withColumnRenamed("rerank_score", "given")
    return fusion.rerank_prefix(rows, "given", 5).select("query_id", "chunk_rowid", F.round("fusion_score", 9).alias("fusion_score"), "position")


@query(f"""with {_bm25(_ONE)}, b as (select id, rank from ranked where rank <= 20),
  d as (select v.vec_id as id, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id = 0),
  v as (select id, cast(row_number() over (order by score desc, id) as int) as rank from d qualify rank <= 20),
  r as (select id, v.rank as vector_rank, b.rank as bm25_rank, round(coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0), 12) as fusion_score from v full join b using (id)),
  p as (select r.*, c.doc_id, row_number() over (order by fusion_score desc, vector_rank nulls last, bm25_rank nulls last) as p from r join chunks1 c using (id)),
  n as (select *, row_number() over (partition by doc_id order by p) as n from p)
  select id, doc_id, fusion_score, vector_rank, bm25_rank, cast(row_number() over (order by case when n > 1 then 1 else 0 end, p) as int) as position from n qualify position <= 10""")
def hybrid_search(spark, sf_dir):
    """Full text and vectors, fused, hydrated, diversified and cut to ten."""
    chunks = index_chunks(spark, sf_dir)
    by_term = lexical.bm25_topk(spark, "cache sensor scheduler 词项", index_postings(spark, sf_dir), chunks).withColumn("query_id", F.lit(0))
    by_vector = vector.vector_topk(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)).select(F.col("vec_id").alias("id"), "rank", F.lit(0).alias("query_id"))
    hits = fusion.hydrate(fusion.reciprocal_rank_fusion(by_vector, by_term), chunks.select("id", "doc_id"))
    return fusion.diversify(hits, 10).select("id", "doc_id", F.round("fusion_score", 12).alias("fusion_score"), "vector_rank", "bm25_rank", "position")


@query("""select distinct query_id, chunk_rowid, round(case when isnan(final_score) then null else final_score end, 4) as score,
  'qmd://' || coalesce(nullif(trim(collection_name), ''), collection_id) || '/' || relative_path as file, title, trim(text, ' ') as snippet from search_results""")
def result_payload(spark, sf_dir):
    """The columns of the JSON output, for every stored result."""
    rows = table(spark, sf_dir, "search_results").withColumn("final_score", F.when(~F.isnan("final_score"), F.col("final_score"))).withColumn("position", F.lit(1))
    shown = fusion.result_payload(rows.withColumn("doc_id", F.struct("query_id", "chunk_rowid")))
    return shown.select("doc_id.query_id", "doc_id.chunk_rowid", "score", "file", "title", "snippet").distinct()


# ---- chunking and texts


@query("select case when n_chars < 1200 then 'small' when n_chars <= 3500 then 'middle' else 'large' end as tier, count(*) as n from documents where n_chars is not null group by all")
def chunk_tiers(spark, sf_dir):
    n = F.length("text")
    tier = F.when(n < markdown.SMALL_DOCUMENT, "small").when(n <= markdown.LARGE_DOCUMENT, "middle").otherwise("large")
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""with a as (select doc_id, regexp_extract_all({sql_norm('text')}, '{HAN}|{WORDS}') as atoms from documents where text is not null),
  w as (select doc_id, atoms, unnest(range(0, cast(case when len(atoms) = 0 then 0 when len(atoms) <= 800 then 1 else ceil((len(atoms) - 120) / 680.0) end as bigint))) as i from a)
  select doc_id, cast(i + 1 as int) as part, cast(len(atoms[i * 680 + 1 : i * 680 + 800]) as int) as n_atoms, sha256(array_to_string(atoms[i * 680 + 1 : i * 680 + 800], ' ')) as window_hash from w""")
def chunk_windows(spark, sf_dir):
    """Windows of 800 atoms that overlap by 120, of every document."""
    step = markdown.WINDOW - markdown.OVERLAP
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.atoms_of(tx.nfkc_lower("text")).alias("atoms")).where("size(atoms) > 0")
    count = F.greatest(F.lit(1), F.ceil((F.size("atoms") - markdown.OVERLAP) / step)).cast("int")
    parts = rows.select("doc_id", "atoms", F.explode(F.sequence(F.lit(1), count)).alias("part"))
    window = F.slice("atoms", (F.col("part") - 1) * step + 1, markdown.WINDOW)
    return parts.select("doc_id", "part", F.size(window).alias("n_atoms"), tx.sha256_hex(F.array_join(window, " ")).alias("window_hash"))


@query("select id, sha256(chunk_type || '::' || search_text) as own_hash, sha256(chunk_type || '::' || search_text) is not distinct from lower(trim(embedding_hash)) as agrees from chunks where search_text is not null")
def chunk_ids_hashes(spark, sf_dir):
    """Content hashes made anew, and whether the stored one agrees."""
    own = tx.sha256_hex(F.concat_ws("::", "chunk_type", "search_text"))
    return table(spark, sf_dir, "chunks").where("search_text is not null and chunk_type is not null").select("id", own.alias("own_hash"), own.eqNullSafe(tx.clean_hash("embedding_hash")).alias("agrees"))


@query("""select id, sha256(array_to_string(list_filter([trim(context_text), case when chunk_type = 'code' then case when trim(context_prefix) != '' then 'context:' || chr(10) || trim(context_prefix) end else trim(text) end,
  case when chunk_type = 'code' then 'code:' || chr(10) || trim(text) end], lambda x: x is not null and x != ''), chr(10) || chr(10))) as composed_hash from chunks where text is not null""")
def search_text_compose(spark, sf_dir):
    """Context, and for code the paragraph before it, put before a chunk's text."""
    code = F.col("chunk_type") == "code"
    lead = F.when(F.trim("context_prefix") != "", F.concat(F.lit("context:\n"), F.trim("context_prefix")))
    composed = tx.joined_nonblank("\n\n", F.col("context_text"), F.when(code, lead).otherwise(F.col("text")), F.when(code, F.concat(F.lit("code:\n"), F.trim("text"))))
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", tx.sha256_hex(composed).alias("composed_hash"))


@query()
def parse_markdown(spark, sf_dir):
    """Documents parsed and cut into chunks as ingest does it."""
    files = table(spark, sf_dir, "documents").select("collection_id", "collection_name", "source_path", "relative_path", "updated_at", F.lit("").alias("context_text"), "text")
    return markdown.chunk_rows(markdown.parse_markdown(files)).select("chunk_id", "section_path", "chunk_type", "token_count", "embedding_hash")


@query(r"""select doc_id, coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1), ''), relative_path) as found_title from documents where text is not null""")
def extract_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", markdown.title_of(F.col("text"), F.col("relative_path")).alias("found_title"))


@query(r"""select doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, 'https?://\S+|zotero://\S+|file:///\S+'), list_transform(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1), lambda x: 'wiki://' || trim(x))))), ' ') as links
  from documents where text is not null""")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(markdown.links_of(F.col("text")), " ").alias("links"))


_TAG_LETTER = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


@query(f"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^{_TAG_LETTER}])(#[{_TAG_LETTER}\\-]+)', 1))), ' ') as tags from documents where text is not null")
def extract_tags(spark, sf_dir):
    """Hash tags of every document, each once, sorted."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(markdown.tags_of(F.col("text")), " ").alias("tags"))


@query("select id, case when length(s) <= 180 then s else s[1:177] || '...' end as snippet from (select id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as s from chunks where text is not null)")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", tx.snippet(F.col("text")).alias("snippet"))


# ---- ingest

_LAST = """good as (select distinct run_id from ingest_runs where lower(trim(status)) = 'success'),
  logged as (select doc_id, lower(trim(document_hash)) as h, row_number() over (partition by doc_id order by run_id desc, logged_at desc nulls last, document_hash desc nulls last) as n from ingest_log where run_id in (select run_id from good))"""


def _logged(spark, sf_dir) -> DataFrame:
    from vellumdex.operators.incremental import successful_runs

    rows = table(spark, sf_dir, "ingest_log").join(successful_runs(table(spark, sf_dir, "ingest_runs")), "run_id", "left_semi")
    last = rows.groupBy("doc_id").agg(F.max(F.struct("run_id", "logged_at", "document_hash")).alias("l"))
    return last.select("doc_id", tx.clean_hash("l.document_hash").alias("document_hash"))


@query(f"with {_LAST}, s as (select doc_id, h from logged where n = 1), d as (select doc_id, lower(trim(document_hash)) as h from documents) select coalesce(d.doc_id, s.doc_id) as doc_id, case when s.doc_id is null then 'new' when d.doc_id is null then 'deleted' when d.h is not distinct from s.h then 'same' else 'changed' end as change from d full join s on d.doc_id = s.doc_id")
def ingest_delta(spark, sf_dir):
    """Documents against what was stored, by document hash: new, changed, same and deleted ones."""
    current = table(spark, sf_dir, "documents").select("doc_id", tx.clean_hash("document_hash").alias("document_hash"))
    return document_changes(current, _logged(spark, sf_dir))


@query(f"with {_LAST}, s as (select doc_id, h from logged where n = 1), d as (select doc_id, lower(trim(document_hash)) as h from documents) select count(*) filter (s.doc_id is null) as new_documents, count(*) filter (d.doc_id is null) as deleted_documents, count(*) filter (d.doc_id is not null and s.doc_id is not null and d.h is distinct from s.h) as changed_documents, count(*) filter (d.doc_id is not null and s.doc_id is not null and d.h is not distinct from s.h) as same_documents from d full join s on d.doc_id = s.doc_id")
def ingest_stats(spark, sf_dir):
    kinds = {"new": "new_documents", "deleted": "deleted_documents", "changed": "changed_documents", "same": "same_documents"}
    return ingest_delta(spark, sf_dir).agg(*[F.count_if(F.col("change") == k).alias(n) for k, n in kinds.items()])


@query("""with gone as (select doc_id from documents where lang is null), left_chunks as (select * from chunks where doc_id not in (select doc_id from gone))
  select 'documents' as name, count(*) as n from documents where lang is not null union all select 'chunks', count(*) from left_chunks
  union all select 'postings', count(*) from bm25_terms where chunk_rowid not in (select id from chunks where doc_id in (select doc_id from gone))""")
def delete_cascade(spark, sf_dir):
    """Rows left in documents, chunks and postings after the documents without a label are deleted."""
    documents, chunks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks")
    gone = documents.where("lang is null").select("doc_id")
    gone_chunks = chunks.join(gone, "doc_id", "left_semi").select(F.col("id").alias("chunk_rowid"))
    left = {
        "documents": without_documents(documents, gone), "chunks": without_documents(chunks, gone),
        "postings": table(spark, sf_dir, "bm25_terms").join(gone_chunks, "chunk_rowid", "left_anti"),
    }
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- registry and contexts


@query("select collection_id from collections where include_by_default or not exists (select 1 from collections where include_by_default)")
def default_collections(spark, sf_dir):
    return _default_collections(spark, sf_dir)


@query("""with n as (select c.collection_id, c.name, (select count(*) from documents d where d.collection_id = c.collection_id) as documents, (select count(*) from chunks k where k.collection_id = c.collection_id) as chunks,
    (select strftime(max(finished_at), '%Y-%m-%dT%H:%M:%S') from ingest_runs r where r.collection_id = c.collection_id and lower(trim(status)) = 'success') as last_ingested_at from collections c)
  select * from n union all select null, 'total', sum(documents)::bigint, sum(chunks)::bigint, max(last_ingested_at) from n""")
def collection_status(spark, sf_dir):
    """Documents, chunks and last successful run of each collection, and a total."""
    from vellumdex.operators.incremental import is_success

    rows = table(spark, sf_dir, "collections").select("collection_id", "name")
    for name in ("documents", "chunks"):
        rows = rows.join(table(spark, sf_dir, name).groupBy("collection_id").agg(F.count("*").alias(name)), "collection_id", "left")
    last = table(spark, sf_dir, "ingest_runs").where(is_success("status")).groupBy("collection_id").agg(F.date_format(F.max("finished_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_ingested_at"))
    rows = rows.join(last, "collection_id", "left").na.fill(0, ["documents", "chunks"])
    total = rows.agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"), F.max("last_ingested_at").alias("last_ingested_at"))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("collection_id"), F.lit("total").alias("name"), "documents", "chunks", "last_ingested_at"))


def _contexts(spark, sf_dir) -> DataFrame:
    """One global context, one of each collection, and one of each first folder."""
    collections = table(spark, sf_dir, "collections").select("collection_id", F.lit("").alias("path_prefix"), F.concat(F.lit("about "), "name").alias("text"), F.lit("1").alias("created_at"))
    top = F.regexp_extract("relative_path", "^([^/]+)/", 1)
    folders = table(spark, sf_dir, "documents").select("collection_id", top.alias("path_prefix")).where("path_prefix != ''").distinct().select("collection_id", "path_prefix", F.concat(F.lit("folder "), "path_prefix").alias("text"), F.lit("2").alias("created_at"))
    everywhere = spark.createDataFrame([(None, "", "all notes", "0"), (None, "", "  ", "0")], collections.schema)
    return everywhere.unionByName(collections).unionByName(folders)


_CONTEXTS = """ctx as (select null as scope, '' as prefix, 'all notes' as text, '0' as made union all select collection_id, '', 'about ' || name, '1' from collections
    union all select distinct collection_id, regexp_extract(relative_path, '^([^/]+)/', 1), 'folder ' || regexp_extract(relative_path, '^([^/]+)/', 1), '2' from documents where regexp_extract(relative_path, '^([^/]+)/', 1) != ''),
  hit as (select d.doc_id, x.* from documents d join ctx x on (x.scope is null or x.scope = d.collection_id) and (x.prefix = '' or d.relative_path = x.prefix or starts_with(d.relative_path, x.prefix || '/')))"""


@query(f"with {_CONTEXTS} select doc_id, count(*) as n, max(length(prefix)) as longest from hit group by doc_id")
def context_prefix_join(spark, sf_dir):
    """How many contexts apply to each document, and the longest prefix."""
    found = context.applying_contexts(table(spark, sf_dir, "documents"), _contexts(spark, sf_dir)).select("doc_id", F.explode("found").alias("c"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("c.length").cast("bigint").alias("longest"))


@query(f"with {_CONTEXTS} select d.doc_id, coalesce(string_agg(h.text, chr(10) || chr(10) order by length(h.prefix), case when h.scope is null then 0 else 1 end, h.made), '') as context_text from documents d left join hit h using (doc_id) group by d.doc_id")
def context_render(spark, sf_dir):
    """The context text of every document."""
    return context.context_texts(table(spark, sf_dir, "documents"), _contexts(spark, sf_dir))


# ---- evaluation

_GOLDEN = f"""{_bm25(_ASKED)}, names as (select distinct on (id) id, regexp_extract(relative_path, '[^/]*$') as name from chunks order by id, relative_path),
  golden as (select distinct s.query_id, n.name as goal from search_results s join names n on n.id = s.chunk_rowid where s.vector_rank <= 3 and s.query is not null),
  hits as (select r.query_id, r.rank, n.name from ranked r join names n using (id) where rank <= 10),
  firsts as (select g.query_id, g.goal, min(h.rank) as first from golden g left join hits h on h.query_id = g.query_id and h.name = g.goal group by all)"""


def _golden(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A golden set: the file names of the results with vector ranks 1 to 3; and the BM25 ranking by file name."""
    names = table(spark, sf_dir, "chunks").groupBy("id").agg(F.min("relative_path").alias("p")).select("id", evaluation.file_name(F.col("p")).alias("name"))
    wanted = table(spark, sf_dir, "search_results").where("vector_rank <= 3 and query is not null").select("query_id", F.col("chunk_rowid").alias("id"))
    golden = wanted.join(names, "id").groupBy("query_id").agg(F.collect_set("name").alias("relevant_docs"))
    return golden, _batch(spark, sf_dir, 10).join(names, "id").select("query_id", "name", "rank")


_PER_QUERY = f"""with {_GOLDEN}, per as (select query_id, cast(count(*) as int) as n_relevant, least(count(*) filter (first <= 5) / count(*), 1.0) as recall_at_5, coalesce(1.0 / min(first), 0.0) as rr_at_10,
    coalesce(sum(1.0 / log2(first + 1)), 0) / list_sum(list_transform(range(1, 1 + least(count(*), 10)::bigint), lambda i: 1.0 / log2(i + 1))) as ndcg_at_10 from firsts group by query_id)"""


@query(_PER_QUERY + " select query_id, n_relevant, round(recall_at_5, 6)::double as recall_at_5, round(rr_at_10::double, 6) as rr_at_10, round(ndcg_at_10::double, 6) as ndcg_at_10 from per")
def eval_per_query(spark, sf_dir):
    """Quality of the BM25 ranking of every stored query."""
    per = evaluation.evaluate_rankings(*_golden(spark, sf_dir))
    return per.select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "rr_at_10", "ndcg_at_10")])


@query(_PER_QUERY + " select round(avg(recall_at_5), 6)::double as recall_at_5, round(avg(rr_at_10)::double, 6) as mrr_at_10, round(avg(ndcg_at_10)::double, 6) as ndcg_at_10, count(*) as queries from per")
def eval_summary(spark, sf_dir):
    total = evaluation.summary(evaluation.evaluate_rankings(*_golden(spark, sf_dir)))
    return total.select(*[F.round(c, 6).alias(c) for c in ("recall_at_5", "mrr_at_10", "ndcg_at_10")], "queries")
