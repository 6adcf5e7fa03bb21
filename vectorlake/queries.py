"""One query for each operator over the driver's tables, and the SQL that gives the same rows.

Points are the embeddings with the document and labels of the same number as metadata.  Queries are all rows whose id is
divisible by 100: of the embeddings for vectors, of the benchmark for texts, of the points for both at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import cells, evaluate, exact, filters, fusion, graph, grid, ivf, sparse
from .plans import planner
from .sources import store as S
from .sources.scratch import Scratch, shared_dir
from .types import CollectionConfig, GridConfig, HnswConfig, IvfConfig

K, DIM = 10, 64
GRID = GridConfig(touch_budget_frac=0.8)
RANGES = 1 << 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return (F.round(c, 6) + F.lit(0.0)).cast("double")


def emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def points(spark: SparkSession, d: str, near: bool = False) -> DataFrame:
    """``near``: documents far from all vectors' ids, which join with none, are not dealt out for the join."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    if near:
        low, high = emb(spark, d).agg(F.min("vec_id"), F.max("vec_id")).first()
        width = ((high or 0) - (low or 0)) // RANGES + 1
        held = emb(spark, d).select(F.expr(f"vec_id div {width}").alias("id_range")).distinct()  # RANGES + 2 rows at most
        docs = docs.join(F.broadcast(held), F.expr(f"doc_id div {width}") == F.col("id_range"), "left_semi")
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "label_id")
    e = emb(spark, d)
    return e.join(docs, e.vec_id == docs.doc_id, "left").join(labels, F.col("vec_id") == F.col("label_id"), "left").drop("doc_id", "label_id")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))


def texts_asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def vector_of(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return emb(spark, d).where(F.col("vec_id") == i).first()["embedding"]


# SQL pieces

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_Q = "q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0)"
_P = "p AS (SELECT e.vec_id, e.v, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id)"


def _dist(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    if metric == "dot":
        return f"-list_dot_product({a}, {b})"
    n = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {n} <= 1.1920929e-7::DOUBLE THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_dot_product({a}, {b}) / {n} END"


def _r(x: str) -> str:
    return f"(round({x}, 6) + 0.0::DOUBLE)"


def _score(x: str) -> str:
    return f"CASE WHEN {x} = -1 THEN 'Infinity'::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + {x}) END"


def _top(inner: str, k: int = K, by: str = "distance, vec_id", part: str = "query_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {by}) AS rank FROM ({inner}) QUALIFY rank <= {k}"


def _pairs(metric: str, where: str = "true", source: str = "e") -> str:
    return f"SELECT q.query_id, x.vec_id, {_dist(metric, 'x.v', 'q.q')} AS distance FROM {source} x CROSS JOIN q WHERE {where}"


def _ranked_out(inner: str) -> str:
    return f"SELECT query_id, vec_id, {_r('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM ({inner})"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", r6("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


# exact search


def _single(metric: str):
    sql = f"WITH {_E} SELECT vec_id, {_r('d')} AS distance, {_r(_score('d'))} AS score FROM (SELECT x.vec_id, {_dist(metric, 'x.v', 'z.v')} AS d FROM e x CROSS JOIN (SELECT v FROM e WHERE vec_id = 0) z ORDER BY d, vec_id LIMIT {K})"

    def run(spark, d):
        return exact.knn(emb(spark, d), vector_of(spark, d), K, metric).select("vec_id", r6("distance").alias("distance"), r6("score").alias("score"))

    run.__name__ = f"knn_{'ip' if metric == 'dot' else metric}_top10"
    query(None if metric == "dot" else sql)(run)
    if metric == "dot":  # the score is singular near -1, where rounding decides, so distances only
        run2 = lambda spark, d: exact.knn(emb(spark, d), vector_of(spark, d), K, metric).select("vec_id", r6("distance").alias("distance"))
        QUERIES["knn_ip_top10"] = run2
        ORACLE_SQL["knn_ip_top10"] = sql.replace(f", {_r(_score('d'))} AS score", "")


for _m in ("cosine", "l2", "dot"):
    _single(_m)


@query(f"WITH {_E}, {_Q} {_ranked_out(_top(_pairs('cosine')))}")
def knn_batch_join(spark, d):
    return _hits(exact.knn_join(emb(spark, d), asked(spark, d), K, "cosine"))


@query(f"WITH {_E}, {_Q} SELECT query_id, {_r('min(distance)')} AS best, {_r('max(distance)')} AS farthest FROM ({_top(_pairs('l2'))}) GROUP BY query_id")
def topk_distance_range(spark, d):
    found = exact.distance_range(exact.knn_join(emb(spark, d), asked(spark, d), K, "l2"))
    return found.select("query_id", r6("best").alias("best"), r6("farthest").alias("farthest"))


def _filtered(name: str, spec: dict, where: str):
    def run(spark, d):
        p = points(spark, d)
        return _hits(exact.knn_join(p, asked(spark, d), K, "cosine", filters.predicate(p, spec)))

    run.__name__ = name
    query(f"WITH {_E}, {_Q}, {_P} {_ranked_out(_top(_pairs('cosine', where, 'p')))}")(run)


_filtered("knn_filtered_eq", {"lang": "en"}, "coalesce(lang = 'en', false)")
_filtered("knn_filtered_ne_missing", {"quality": {"$ne": 1}}, "NOT coalesce(quality = 1, false)")
_filtered("knn_filtered_range", {"n_chars": {"$gt": 500, "$lte": 3000}}, "coalesce(n_chars > 500 AND n_chars <= 3000, false)")
_filtered("knn_filtered_in", {"source": {"$in": ["src1", "src2", "src3"]}}, "coalesce(source IN ('src1', 'src2', 'src3'), false)")
_filtered("knn_filtered_and_or", {"$and": [{"$or": [{"lang": "de"}, {"lang": "fr"}]}, {"toxic": {"$ne": 1}}]}, "coalesce(lang IN ('de', 'fr'), false) AND NOT coalesce(toxic = 1, false)")
_filtered("knn_filtered_multikey", {"lang": "en", "source": {"$gte": "src1", "$lt": "src3"}}, "coalesce(lang = 'en' AND source >= 'src1' AND source < 'src3', false)")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 90) OR CAST(json_extract(props, '$.k') AS BIGINT) IN (3, 5)")
def filter_json_events(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("doc", F.try_parse_json("props"))
    spec = {"$and": [{"$or": [{"k": {"$gte": 90}}, {"k": {"$in": [3, 5, "7"]}}]}, {"nothing": {"$ne": 1}}]}
    return events.where(filters.variant_predicate(F.col("doc"), spec)).select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


# vector math


@query(f"WITH {_E} SELECT vec_id, {_r('sqrt(list_dot_product(v, v))')} AS norm FROM e")
def vec_norms(spark, d):
    return emb(spark, d).select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"))


@query(f"WITH {_E} SELECT vec_id, {_r('v[1] / n')} AS first, {_r('v[64] / n')} AS last FROM (SELECT vec_id, list_transform(v, lambda x: 3 * x) AS v, 3 * sqrt(list_dot_product(v, v)) AS n FROM e)")
def l2_normalize(spark, d):
    tripled = F.transform(V.doubles(F.col("embedding")), lambda x: 3 * x)
    return emb(spark, d).select("vec_id", V.normalize(tripled).alias("u")).select("vec_id", r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


def _codes(v: str, scale: str) -> str:
    return f"list_transform({v}, lambda x: floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) + 1) * {scale}::DOUBLE + 0.5::DOUBLE))"


def _decoded(v: str, scale: str) -> str:
    return f"list_transform({_codes(v, scale)}, lambda c: c / {scale}::DOUBLE - 1)"


def _quantize(tier: str, scale: str):
    def run(spark, d):
        v = F.transform(V.doubles(F.col("embedding")), lambda x: 4 * x)  # beyond [-1, 1] in places
        return emb(spark, d).select("vec_id", v.alias("v")).select("vec_id", r6(V.quantized_distance("l2", F.col("v"), V.encode(F.col("v"), tier), tier)).alias("error"))

    run.__name__ = f"quantize_{tier}_error"
    v = "list_transform(v, lambda x: 4 * x)"
    query(f"WITH {_E} SELECT vec_id, {_r('sqrt(' + _dist('l2', v, _decoded(v, scale)) + ')')} AS error FROM e")(run)


_quantize("u8", "127.5")
_quantize("u16", "32767.5")


@query(f"WITH {_E}, {_Q} {_ranked_out(_top(f'''SELECT q.query_id, x.vec_id, {_dist('l2', _decoded('x.v', '127.5'), 'q.q')} AS distance FROM e x CROSS JOIN q'''))}")
def quantized_knn_u8(spark, d):
    coded = emb(spark, d).select("vec_id", V.decode(V.encode(F.col("embedding"), "u8"), "u8").alias("embedding"))
    return _hits(exact.knn_join(coded, asked(spark, d), K, "l2"))


# text

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL)"
_DL = f"dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents)"
_ST = "st AS (SELECT count(*) AS n, greatest(avg(dl), 1e-6::DOUBLE) AS avgdl FROM dl)"
_DF = "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
_TQ = f"tq AS (SELECT DISTINCT query_id, unnest({_TOK}) AS term FROM (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0))"
_BM = f"""bm AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, sum({_IDF} * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
FROM tq JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id)"""
_LEX = f"{_TF}, {_DL}, {_ST}, {_DF}, {_TQ}, {_BM}"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query(f"WITH {_TF} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf")
def tokenize_tf(spark, d):
    return sparse.postings(docs(spark, d))


@query(f"WITH {_DL} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dl")
def doc_stats(spark, d):
    return sparse.doc_stats(docs(spark, d))


@query(f"WITH {_TF}, {_DL}, {_ST}, {_DF} SELECT term, CAST(df AS BIGINT) AS df, {_r(_IDF)} AS idf FROM df CROSS JOIN st")
def bm25_idf(spark, d):
    return sparse.document_frequencies(docs(spark, d)).select("term", "df", r6("idf").alias("idf"))


def _lex_out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


# Scores are rounded before ranking, so that sums in another order cannot swap equal documents.
_LEX_OUT = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({})"


def _rounded_search(spark, d, where=None):
    s = sparse.bm25(docs(spark, d), texts_asked(spark, d), where=where).withColumn("score", r6("score"))
    return _lex_out(exact.top_k_per_query(s, 20, "score", "doc_id", descending=True))


@query(f"WITH {_LEX} " + _LEX_OUT.format(_top(f"SELECT query_id, doc_id, {_r('score')} AS score FROM bm", 20, "score DESC, doc_id")))
def bm25_top20(spark, d):
    return _rounded_search(spark, d)


@query(f"WITH {_LEX} " + _LEX_OUT.format(_top(f"SELECT query_id, doc_id, {_r('score')} AS score FROM bm JOIN documents USING (doc_id) WHERE lang = 'en'", 20, "score DESC, doc_id")))
def sparse_filtered(spark, d):
    return _rounded_search(spark, d, F.col("lang") == "en")


# fusion

_HTQ = f"tq AS (SELECT DISTINCT query_id, unnest({_TOK}) AS term FROM (SELECT vec_id AS query_id, text FROM p WHERE vec_id % 100 = 0))"


def _hybrid_sql(how: str, where: str = "true") -> str:
    lex = _LEX.replace(_TQ, _HTQ).replace("FROM documents", "FROM pd").replace("JOIN documents", "JOIN pd")
    dense = _top(_pairs("cosine", where, "p"), 50)
    lexical = _top(f"SELECT query_id, doc_id AS vec_id, score FROM bm JOIN p ON p.vec_id = bm.doc_id WHERE {where}", 50, "score DESC, vec_id")
    scaled = lambda src, s: f"SELECT query_id, vec_id, CASE WHEN max(s) OVER w - min(s) OVER w <= 1e-9::DOUBLE THEN 1.0::DOUBLE ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS s FROM (SELECT *, {s} AS s FROM {src}) WINDOW w AS (PARTITION BY query_id)"
    if how == "rrf":
        fused = "SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM (SELECT query_id, vec_id, rank FROM dn UNION ALL SELECT query_id, vec_id, rank FROM lx) GROUP BY ALL"
    else:
        fused = f"SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(a.s, 0) * 0.5::DOUBLE + coalesce(b.s, 0) * 0.5::DOUBLE AS fused FROM ({scaled('dn', '-distance')}) a FULL JOIN ({scaled('lx', 'score')}) b ON a.query_id = b.query_id AND a.vec_id = b.vec_id"
    best = _top("SELECT query_id, vec_id, fused FROM fu", K, "fused DESC, vec_id")
    return f"""WITH {_E}, {_Q}, {_P}, pd AS (SELECT vec_id AS doc_id, text, lang FROM p), {lex}, dn AS ({dense}), lx AS ({lexical}), fu AS ({fused}), be AS ({best})
SELECT be.query_id, be.vec_id, {_r(_dist('cosine', 'p.v', 'q.q'))} AS distance, {_r('fused')} AS score, CAST(be.rank AS INTEGER) AS rank FROM be JOIN p USING (vec_id) JOIN q ON q.query_id = be.query_id"""


def _hybrid(spark, d, how, spec=None):
    p = points(spark, d, near=True)
    q = asked(spark, d).join(p.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "text"), "query_id")
    got = fusion.hybrid(p, q, K, "cosine", how, where=filters.predicate(p, spec) if spec else None)
    return got.select("query_id", "vec_id", r6("distance").alias("distance"), r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


@query(_hybrid_sql("rrf"))
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, "rrf")


@query(_hybrid_sql("linear"))
def hybrid_linear(spark, d):
    return _hybrid(spark, d, "linear")


@query(_hybrid_sql("rrf", "coalesce(lang = 'en', false)"))
def hybrid_filtered(spark, d):
    return _hybrid(spark, d, "rrf", {"lang": "en"})


# grid

_SX, _SY = ("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in grid.sign_rows(DIM, GRID.projection_seed))


def _axis(v: str) -> str:
    return f"greatest(0.0::DOUBLE, least(0.9999::DOUBLE, (tanh({v}) + 1) / 2))"


def _cell_sql() -> str:
    def inside(layer):
        return " AND ".join(f"{a} >= {layer.origin}::DOUBLE AND {a} < {layer.origin + layer.extent}::DOUBLE" for a in ("px", "py"))

    def at(a, layer, n):
        return f"least({n - 1}, CAST(floor(({a} - {layer.origin}::DOUBLE) / {layer.extent}::DOUBLE * {n}) AS INTEGER))"

    deep = list(reversed(grid.layers(GRID)))
    case = lambda f: "CASE " + " ".join(f"WHEN {inside(x)} THEN {f(x)}" for x in deep) + " END"
    return f"""pr AS (SELECT vec_id, v, {_axis(f'list_dot_product(v, {_SX})')} AS px, {_axis(f'list_dot_product(v, {_SY})')} AS py FROM e),
ce AS (SELECT *, layer || ':' || cx || ':' || cy AS cell_key FROM (SELECT vec_id, v, px, py, {case(lambda x: str(x.number))} AS layer, {case(lambda x: at('px', x, x.width))} AS cx, {case(lambda x: at('py', x, x.height))} AS cy FROM pr))"""


_CE = _cell_sql()
_CO = "co AS (SELECT cell_key, layer, height, list(m ORDER BY i) AS centroid FROM (SELECT cell_key, layer, i, avg(x) AS m, count(*) AS height FROM (SELECT cell_key, layer, unnest(v) AS x, unnest(range(1, 65)) AS i FROM ce) GROUP BY ALL) GROUP BY ALL)"
_RK = f"rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cell_key) AS rank FROM (SELECT q.query_id, co.cell_key, {_r(_dist('cosine', 'co.centroid', 'q.q'))} AS distance FROM co CROSS JOIN q))"


def placed(spark, d):
    return grid.with_cells(emb(spark, d), DIM, GRID)


def ranked_columns(spark, d):
    from pyspark.sql import Window

    r = cells.ranked_columns(cells.columns(placed(spark, d)), asked(spark, d)).withColumn("distance", r6("distance"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "cell_key")))


@query(f"WITH {_E}, {_CE} SELECT vec_id, {_r('px')} AS px, {_r('py')} AS py, layer, cx, cy, cell_key FROM ce")
def grid_cells(spark, d):
    return placed(spark, d).select("vec_id", r6("px").alias("px"), r6("py").alias("py"), "layer", "cx", "cy", "cell_key")


@query(f"WITH {_E}, {_CE}, {_CO} SELECT cell_key, CAST(height AS BIGINT) AS height, {_r('centroid[1]')} AS first, {_r('centroid[64]')} AS last FROM co")
def grid_heights(spark, d):
    return cells.columns(placed(spark, d)).select("cell_key", "height", r6(F.col("centroid")[0]).alias("first"), r6(F.col("centroid")[63]).alias("last"))


@query(f"WITH {_E}, {_CE} SELECT CAST(count(*) AS BIGINT) AS cells, {_r('avg(h)')} AS mean_height, CAST(max(h) AS BIGINT) AS max_height, {_r('max(h) / avg(h)')} AS ratio FROM (SELECT count(*) AS h FROM ce GROUP BY cell_key)")
def grid_height_balance(spark, d):
    return cells.height_balance(placed(spark, d)).select("cells", r6("mean_height").alias("mean_height"), "max_height", r6("ratio").alias("ratio"))


@query(f"WITH {_E}, {_Q}, {_CE}, {_CO}, {_RK} SELECT query_id, cell_key, distance, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5")
def grid_centroid_top(spark, d):
    return ranked_columns(spark, d).where("rank <= 5").select("query_id", "cell_key", "distance", F.col("rank").cast("int").alias("rank"))


_CG = f"cg AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM (SELECT a.cell_key AS src, b.cell_key AS dst, {_dist('cosine', 'b.centroid', 'a.centroid')} AS dist FROM co a JOIN co b ON a.cell_key <> b.cell_key) QUALIFY r <= 8)"


@query(f"WITH {_E}, {_CE}, {_CO}, {_CG} SELECT src, dst, {_r('dist')} AS dist FROM cg")
def centroid_graph(spark, d):
    return cells.centroid_graph(cells.columns(placed(spark, d))).select("src", "dst", r6("dist").alias("dist"))


@query(f"WITH {_E}, {_Q}, {_CE}, {_CO}, {_RK} " + _ranked_out(_top(f"SELECT q.query_id, ce.vec_id, {_dist('cosine', 'ce.v', 'q.q')} AS distance FROM rk JOIN ce USING (cell_key) JOIN q ON q.query_id = rk.query_id WHERE rk.rank <= 4")))
def grid_seed_search(spark, d):
    seeds = ranked_columns(spark, d).where("rank <= 4")
    return _hits(exact.knn_in_parts(placed(spark, d), asked(spark, d), seeds, K, "cosine", "cell_key"))


_LAST = GRID.max_layers - 1
_CD = f"""cd AS (SELECT q.query_id, ce.vec_id, ce.v, q.q, rk.cell_key, rk.rank AS visit,
CASE WHEN layer = 0 THEN {_dist('cosine', 'q.q', _decoded('ce.v', '127.5'))} WHEN layer >= {_LAST} THEN {_dist('cosine', 'q.q', 'ce.v')} ELSE {_dist('cosine', 'q.q', _decoded('ce.v', '32767.5'))} END AS coarse
FROM rk JOIN ce USING (cell_key) JOIN q ON q.query_id = rk.query_id WHERE rk.rank <= 6),
ck AS (SELECT *, row_number() OVER (PARTITION BY query_id, cell_key ORDER BY coarse, vec_id) AS r FROM cd QUALIFY r <= 4)"""


def _pruned(spark, d):
    visits = ranked_columns(spark, d).where("rank <= 6").withColumn("visit", F.col("rank"))
    return cells.coarse(placed(spark, d), visits, asked(spark, d), 4, GRID, "cosine")


@query(f"WITH {_E}, {_Q}, {_CE}, {_CO}, {_RK}, {_CD} " + _ranked_out(_top(f"SELECT query_id, vec_id, {_dist('cosine', 'v', 'q')} AS distance FROM ck")))
def grid_pruned_rerank(spark, d):
    return _hits(ivf.rerank(_pruned(spark, d), emb(spark, d), asked(spark, d), K, "cosine"))


@query(f"WITH {_E}, {_Q}, {_CE}, {_CO}, {_RK}, {_CD} SELECT query_id, vec_id, cell_key, CAST(visit AS INTEGER) AS visit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY visit, coarse, vec_id) AS INTEGER) AS touched FROM ck QUALIFY touched <= 15")
def grid_budgeted(spark, d):
    got = cells.within_budget(_pruned(spark, d), 15)
    return got.select("query_id", "vec_id", "cell_key", F.col("visit").cast("int").alias("visit"), F.col("touched").cast("int").alias("touched"))


@query()
def grid_search(spark, d):
    return _hits(cells.search(placed(spark, d), asked(spark, d), K, DIM, GRID)[0])


@query()
def grid_explain(spark, d):
    return cells.search(placed(spark, d), asked(spark, d), K, DIM, GRID)[1].select("query_id", "candidate_pool", "columns", "deepest_layer", "fallback", "touch_budget", r6("touch_fraction").alias("touch_fraction"), "strategy")


@query(f"WITH {_E}, {_CE}, h AS (SELECT cell_key, count(*) AS h FROM ce GROUP BY cell_key) SELECT CAST(count(*) AS BIGINT) AS tall, CAST(coalesce(sum(h - h // 2), 0) AS BIGINT) AS candidates FROM h WHERE h > greatest(8, ceil((SELECT avg(h) FROM h) * 1.5::DOUBLE))")
def grid_tall_columns(spark, d):
    """The columns that the split rule finds too tall, and the rows of their second halves."""
    rows = placed(spark, d)
    heights = rows.groupBy("cell_key").agg(F.count(F.lit(1)).alias("h"))
    mean = heights.agg(F.avg("h").alias("mean"))
    tall = heights.join(F.broadcast(mean), F.lit(True)).where(F.col("h") > F.greatest(F.lit(8), F.ceil(F.col("mean") * 1.5)))
    return tall.agg(F.count(F.lit(1)).alias("tall"), F.coalesce(F.sum(F.col("h") - F.floor(F.col("h") / 2)), F.lit(0)).cast("long").alias("candidates"))


@query()
def grid_split_tall(spark, d):
    got = cells.split_tall(placed(spark, d), GridConfig(max_column_height_ratio=1.5))
    return got.groupBy("cell_key").agg(F.count(F.lit(1)).alias("height"))


# shards

_HASH = "CAST(('0x' || substr(md5(cell_key), 1, 8))::UBIGINT % 16 AS INTEGER)"


@query(f"WITH {_E}, {_CE} SELECT vec_id, cell_key, {_HASH} AS shard_id FROM ce")
def shard_route(spark, d):
    return grid.sharded(emb(spark, d), DIM, 16, GRID).select("vec_id", "cell_key", "shard_id")


@query(f"WITH {_E}, {_Q} {_ranked_out(_top(_pairs('l2')))}")
def shard_partial_topk_merge(spark, d):
    parts = [exact.knn_join(emb(spark, d).where(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == s), asked(spark, d), K, "l2") for s in range(4)]
    return _hits(grid.merge_top_k(parts, K))


def _beam_targets() -> str:
    parts = []
    for layer in grid.layers(GRID):
        inside = " AND ".join(f"{a} >= {layer.origin}::DOUBLE AND {a} < {layer.origin + layer.extent}::DOUBLE" for a in ("px", "py"))
        ax = lambda a, n, layer=layer: f"least({n - 1}, CAST(floor(({a} - {layer.origin}::DOUBLE) / {layer.extent}::DOUBLE * {n}) AS INTEGER))"
        parts.append(
            f"SELECT vec_id AS query_id, '{layer.number}:' || x || ':' || y AS cell_key FROM (SELECT vec_id, {ax('px', layer.width)} AS ox, {ax('py', layer.height)} AS oy FROM pr WHERE vec_id % 100 = 0 AND {inside}), range({layer.width}) a(x), range({layer.height}) b(y) WHERE abs(x - ox) <= 1 AND abs(y - oy) <= 1"
        )
    return "tg AS (SELECT DISTINCT query_id, " + _HASH + " AS shard_id FROM (" + " UNION ALL ".join(parts) + f" UNION ALL SELECT vec_id, cell_key FROM ce WHERE vec_id % 100 = 0))"


@query(f"WITH {_E}, {_Q}, {_CE}, {_beam_targets()}, sh AS (SELECT vec_id, v, {_HASH} AS shard_id FROM ce) " + _ranked_out(_top(f"SELECT tg.query_id, sh.vec_id, {_dist('cosine', 'sh.v', 'q.q')} AS distance FROM tg JOIN sh USING (shard_id) JOIN q ON q.query_id = tg.query_id")))
def shard_beam_query(spark, d):
    q = asked(spark, d)
    return _hits(grid.search_shards(grid.sharded(emb(spark, d), DIM, 16, GRID), q, grid.target_shards(q, DIM, 16, 1, GRID), K))


# inverted file

_LC = "lc AS (SELECT label AS list_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"


@query(f"WITH {_E}, {_Q}, {_LC}, en AS (SELECT e.vec_id, e.v, arg_min(lc.list_id, {{'d': {_dist('l2', 'e.v', 'lc.c')}, 'i': lc.list_id}}) AS list_id FROM e CROSS JOIN lc GROUP BY ALL), pb AS ({_top('SELECT q.query_id, lc.list_id, ' + _dist('l2', 'lc.c', 'q.q') + ' AS distance FROM lc CROSS JOIN q', 3, 'distance, list_id')}) " + _ranked_out(_top(f"SELECT pb.query_id, en.vec_id, {_dist('l2', 'en.v', 'q.q')} AS distance FROM pb JOIN en USING (list_id) JOIN q ON q.query_id = pb.query_id")))
def ivf_label_probe(spark, d):
    import numpy as np

    parts = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg("v").alias("v")).toPandas()  # labels x dimensions
    centroids = means.pivot(index="label", columns="i", values="v").sort_index().to_numpy(np.float64)
    entries, lists = ivf.assign(emb(spark, d), centroids), ivf.centroid_table(spark, centroids)
    return _hits(ivf.search(entries, asked(spark, d), lists, K, 3))


@query()
def ivf_trained_probe(spark, d):
    config = IvfConfig(nlist=16, nprobe=14)  # the vectors have hardly any clusters
    c = ivf.train(emb(spark, d), config)
    return _hits(ivf.search(ivf.assign(emb(spark, d), c), asked(spark, d), ivf.centroid_table(spark, c), K, config.nprobe))


@query()
def pq_adc_topk(spark, d):
    config = IvfConfig(nlist=16, nprobe=14).with_pq(16)
    e = emb(spark, d)
    c = ivf.train(e, config)
    book = ivf.train_codebook(e, config)
    pool = ivf.search_codes(ivf.encode(ivf.assign(e, c), book), asked(spark, d), ivf.centroid_table(spark, c), book, 5 * K, config.nprobe, each=True)
    return _hits(ivf.rerank(pool, e, asked(spark, d), K, "l2"))


# graph

_KG = f"kg AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_dist('cosine', 'b.v', 'a.v')} AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id) QUALIFY r <= 8)"
_PG = "pg AS (SELECT src, dst FROM (SELECT DISTINCT src, dst, dist FROM (SELECT src, dst, dist FROM kg UNION ALL SELECT dst, src, dist FROM kg)) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 16)"


@query(f"WITH {_E}, {_KG} SELECT src, dst, {_r('dist')} AS dist FROM kg")
def knn_graph_edges(spark, d):
    return graph.knn_graph(emb(spark, d), 8).select("src", "dst", r6("dist").alias("dist"))


def _hop(frm: str, to: str, ef: int) -> str:
    return f"""{to} AS (SELECT query_id, vec_id, distance, fresh FROM (SELECT query_id, vec_id, distance, false AS fresh FROM {frm} UNION ALL
SELECT z.query_id, z.vec_id, {_dist('cosine', 'e.v', 'q.q')}, true FROM (SELECT DISTINCT f.query_id, pg.dst AS vec_id FROM {frm} f JOIN pg ON pg.src = f.vec_id WHERE f.fresh) z
JOIN e ON e.vec_id = z.vec_id JOIN q ON q.query_id = z.query_id ANTI JOIN {frm} s ON s.query_id = z.query_id AND s.vec_id = z.vec_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {ef})"""


@query(f"WITH {_E}, {_Q}, {_KG}, {_PG}, h0 AS (SELECT q.query_id, e.vec_id, {_dist('cosine', 'e.v', 'q.q')} AS distance, true AS fresh FROM q CROSS JOIN e WHERE e.vec_id IN (100, 200, 300)), {_hop('h0', 'h1', 32)}, {_hop('h1', 'h2', 32)} " + _ranked_out(_top("SELECT query_id, vec_id, distance FROM h2")))
def graph_beam_2hop(spark, d):
    edges = graph.pruned(graph.knn_graph(emb(spark, d), 8), 16)
    start = asked(spark, d).select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 200, 300)])).alias("vec_id"))
    return _hits(exact.top_k_per_query(graph.beam(edges, emb(spark, d), asked(spark, d), start, 32, 2), K))


@query()
def graph_search(spark, d):
    e = emb(spark, d)
    built = Scratch(spark, "graph").save(graph.build(e, HnswConfig()), "edges")
    return _hits(graph.search(built, e, asked(spark, d), K))


# store: events as a change log (user_id is the key, an error event deletes)

_LOG = "lg AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id AS id, value FROM events)"


def change_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").alias("id"), "value")


@query(f"WITH {_LOG} SELECT id, seq, op, {_r('value')} AS value FROM lg QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def latest_upsert_wins(spark, d):
    return S.latest(change_log(spark, d)).select("id", "seq", "op", r6("value").alias("value"))


@query(f"WITH {_LOG} SELECT id, seq, {_r('value')} AS value FROM (SELECT * FROM lg WHERE seq > 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) WHERE op = 'upsert'")
def wal_replay(spark, d):
    log = change_log(spark, d).select("seq", "op", F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("vec_id"), F.array(F.col("value").cast("double")).alias("embedding"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("text"))
    live = S.replay(log, 100).where("not deleted")
    return live.select(F.col("id").cast("bigint").alias("id"), "seq", r6(F.col("embedding")[0]).alias("value"))


@query(f"WITH {_LOG}, sg AS (SELECT *, seq // 100 AS segment FROM lg) SELECT id, segment, seq FROM sg QUALIFY row_number() OVER (PARTITION BY id ORDER BY segment DESC, seq DESC) = 1")
def segment_dedupe(spark, d):
    rows = change_log(spark, d).select("id", F.floor(F.col("seq") / 100).alias("segment"), "seq").withColumn("version", F.struct("segment", "seq"))
    return S.latest(rows, "id", "version").select("id", "segment", "seq")


@query("WITH lg AS (SELECT event_id // 10 AS id, event_type FROM events) SELECT DISTINCT id FROM lg WHERE event_type <> 'error' AND id NOT IN (SELECT id FROM lg WHERE event_type = 'error')")
def tombstone_antijoin(spark, d):
    """Ten events each write one row; an error among them is a tombstone."""
    log = spark.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 10).alias("id"), "event_type")
    return log.where("event_type <> 'error'").select("id").distinct().join(log.where("event_type = 'error'").select("id").distinct(), "id", "left_anti")


def _new_collection(spark, **options):
    import uuid

    return S.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}").create(CollectionConfig("points", DIM, **options))


@query("SELECT CAST(count(*) FILTER (vec_id % 3 = 0) AS BIGINT) AS lag, CAST(count(*) FILTER (vec_id % 3 = 0 AND vec_id % 5 = 0) AS BIGINT) AS deletes, CAST(0 AS BIGINT) AS after_checkpoint FROM embeddings WHERE vec_id % 3 = 0")
def wal_lag(spark, d):
    """Records of a collection's change log since its last checkpoint."""
    coll = _new_collection(spark)
    rows = emb(spark, d).select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding")
    coll.upsert(rows.select("id", "embedding"))
    coll.checkpoint()
    coll.upsert(rows.where("vec_id % 3 = 0 AND vec_id % 5 <> 0").select("id", "embedding"))
    coll.delete(rows.where("vec_id % 15 = 0").select("id"))
    lag, deletes = coll.wal_lag(), coll.log().where("op = 'delete'").count()
    coll.checkpoint()
    return spark.createDataFrame([(lag, deletes, coll.wal_lag())], "lag long, deletes long, after_checkpoint long")


@query(f"WITH {_E} SELECT CAST(vec_id AS VARCHAR) AS id, {_r('CASE WHEN vec_id % 3 = 0 THEN 2 * v[1] ELSE v[1] END')} AS first, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM e WHERE vec_id % 5 <> 4")
def store_roundtrip(spark, d):
    """Upsert, checkpoint, re-upsert of a third, delete of a fifth, checkpoint, compaction."""
    e = emb(spark, d)
    coll = _new_collection(spark)
    coll.upsert(e.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("old").alias("text")))
    coll.checkpoint()
    third = e.where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: 2 * x).alias("embedding"), F.lit("new").alias("text"))
    coll.upsert(third)
    coll.delete(e.where("vec_id % 5 = 4").select(F.col("vec_id").cast("string").alias("id")))
    coll.checkpoint()
    coll.compact()
    return coll.points().select("id", r6(F.col("embedding")[0]).alias("first"), "text")


_HALF = 864_000_000


@query(
    f"""WITH a AS (SELECT event_type AS cell_key, event_id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) - 1 AS later FROM events WHERE event_type IS NOT NULL)
SELECT cell_key, CAST(count(*) AS BIGINT) AS hit_count, max(ts_ms) AS last_access, {_r(f'1e6::DOUBLE * sum(0.1::DOUBLE * power(0.9::DOUBLE, later) * power(0.5::DOUBLE, ((SELECT max(epoch_us(ts) // 1000) FROM events) - ts_ms) / {_HALF}::DOUBLE))')} AS ema_weight FROM a GROUP BY cell_key"""
)
def ledger_decay_ema(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").where("event_type is not null").select(F.col("event_type").alias("cell_key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    now = log.agg(F.max("ts_ms")).first()[0]
    return cells.ledger(log, now, _HALF).select("cell_key", "hit_count", "last_access", r6(F.col("ema_weight") * 1e6).alias("ema_weight"))


# evaluation

_TRUTH = f"tr AS ({_top(_pairs('cosine'))})"
_CENT = f"{_CE}, {_CO}, {_RK}, rs AS ({_top('SELECT q.query_id, ce.vec_id, ' + _dist('cosine', 'ce.v', 'q.q') + ' AS distance FROM rk JOIN ce USING (cell_key) JOIN q ON q.query_id = rk.query_id WHERE rk.rank <= 8')})"


def _truth(spark, d):
    return exact.knn_join(emb(spark, d), asked(spark, d), K)


def _of_8(spark, d):
    near = ranked_columns(spark, d).where("rank <= 8")
    return exact.knn_in_parts(placed(spark, d), asked(spark, d), near, K, "cosine", "cell_key")


@query(f"WITH {_E}, {_Q}, {_TRUTH}, {_CENT} SELECT {_r(f'count(rs.vec_id) / {K}::DOUBLE / (SELECT count(DISTINCT query_id) FROM tr)')} AS recall FROM tr LEFT JOIN rs ON rs.query_id = tr.query_id AND rs.vec_id = tr.vec_id")
def recall_at_k(spark, d):
    return evaluate.recall_at_k(_of_8(spark, d), _truth(spark, d), K).select(r6("recall").alias("recall"))


@query(f"WITH {_E}, {_Q}, {_TRUTH}, {_CENT} SELECT {_r('avg(h)')} AS hit_rate FROM (SELECT tr.query_id, CAST(count(rs.vec_id) > 0 AS INTEGER)::DOUBLE AS h FROM tr LEFT JOIN rs ON rs.query_id = tr.query_id AND rs.vec_id = tr.vec_id GROUP BY tr.query_id)")
def hit_rate(spark, d):
    return evaluate.hit_rate(_of_8(spark, d), _truth(spark, d)).select(r6("hit_rate").alias("hit_rate"))


@query(f"WITH {_E}, {_Q}, {_CENT} SELECT {_r('avg(n) / (SELECT count(*) FROM e)')} AS touch_fraction FROM (SELECT rk.query_id, count(*) AS n FROM rk JOIN ce USING (cell_key) WHERE rk.rank <= 8 GROUP BY rk.query_id)")
def touch_fraction(spark, d):
    heights = placed(spark, d).groupBy("cell_key").agg(F.count(F.lit(1)).alias("height"))
    touched = ranked_columns(spark, d).where("rank <= 8").join(heights, "cell_key")
    return evaluate.touch_fraction(touched, emb(spark, d).count(), "height").select(r6("touch_fraction").alias("touch_fraction"))


@query(f"WITH {_E}, {_Q}, {_TRUTH}, {_CE}, {_CO}, {_RK}, f AS (SELECT rk.rank FROM tr JOIN ce USING (vec_id) JOIN rk ON rk.query_id = tr.query_id AND rk.cell_key = ce.cell_key) SELECT CAST(r AS INTEGER) AS columns, {_r('(SELECT count(*) FROM f WHERE f.rank <= r) / (SELECT count(*) FROM f)::DOUBLE')} AS share FROM (SELECT DISTINCT rank AS r FROM f)")
def localization_cdf(spark, d):
    got = evaluate.localization(_truth(spark, d), placed(spark, d), ranked_columns(spark, d))
    return got.select(F.col("columns").cast("int").alias("columns"), r6("share").alias("share"))


@query("WITH p AS (SELECT d.source, len(e.embedding) AS dim FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id) SELECT source, n, dim, f AS filtered, CASE WHEN n < 500 OR f AND n < 5000 THEN 'flat' WHEN dim >= 64 AND n >= 1000 THEN 'grid' ELSE 'hnsw' END AS index FROM (SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(max(dim) AS INTEGER) AS dim FROM p GROUP BY GROUPING SETS ((source), ())) a, (VALUES (true), (false)) c(f)")
def planner_choice(spark, d):
    """The index for each source's points and for all, with a filter and without."""
    sizes = points(spark, d).rollup("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))
    both = sizes.withColumn("filtered", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("source", "n", "dim", "filtered", planner.index_for(F.col("n"), F.col("dim"), F.col("filtered")).alias("index"))


# stored indexes and their recall


#: Each index with the parameters of its query above.
_INDEXES = ("grid_search", "ivf_trained_probe", "pq_adc_topk", "graph_search")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}', true)" for x in _INDEXES) + ") AS z(name, recalled)")
def index_recall(spark, d):
    """Whether each approximate index finds 0.9 or more of the exact neighbours of all queries."""
    rows = emb(spark, d)
    metric = {"grid_search": "cosine", "graph_search": "cosine"}
    exact_of = {m: Scratch(spark, f"exact-{m}").save(exact.knn_join(rows, asked(spark, d), K, m), "hits") for m in ("cosine", "l2")}
    out = None
    for name in _INDEXES:
        recall = evaluate.recall_at_k(QUERIES[name](spark, d), exact_of[metric.get(name, "l2")], K)
        one = recall.select(F.lit(name).alias("name"), (F.col("recall") >= 0.9).alias("recalled"))
        out = one if out is None else out.union(one)
    return out


def _stored_search(kind: str):
    """A collection with a stored index, changed after the checkpoint: a third re-written, a fifth deleted."""
    where = "NOT (vec_id % 5 = 4)"
    sql = f"WITH {_E}, {_Q}, n AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(v) ELSE v END AS v FROM e WHERE {where}) " + _ranked_out(_top(_pairs("cosine", "true", "n")))

    def run(spark, d):
        from .collection import Collection

        coll = _new_collection(spark, metric="cosine", index=kind, ivf=IvfConfig(nlist=16, nprobe=16))
        e = emb(spark, d).select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding")
        coll.upsert(e.select("id", "embedding"))
        coll.checkpoint()
        c = Collection(coll)
        c.build_index()
        coll.upsert(e.where("vec_id % 3 = 0").select("id", F.reverse("embedding").alias("embedding")))
        coll.delete(e.where("vec_id % 5 = 4").select("id"))
        got = c.search_frame(asked(spark, d), K)
        return got.select("query_id", F.col("id").cast("long").alias("vec_id"), r6("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))

    run.__name__ = f"stored_{kind}_search"
    query(sql if kind == "ivf" else None)(run)


for _k in ("ivf", "grid", "hnsw"):
    _stored_search(_k)
