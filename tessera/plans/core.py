"""Search, fusion, vector and graph queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores, vectors
from tessera.operators import graph, knn, search
from tessera.operators.scope import Scope
from tessera.plans.registry import register
from tessera.sources import scratch
from tessera.sources.views import NOW_H, duckdb_sql, view

WORDS = ["that", "thation", "erenes", "thble", "thou", "with", "from"]
SCOPE = Scope(agent_id="agent1", workspace="en")
_SCOPED = "(agent_id = 'agent1' or agent_id = 'default') and valid_to_h is null and (workspace = 'en' or workspace is null)"
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_KW = f"list_has_any(keywords, {_LIST})"
_KWS = f"len(list_filter(keywords, lambda k: list_contains({_LIST}, k))) / {len(WORDS)}.0e0"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: _DOT.format(a=x, b=y)
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


_COS = _cos("v.embedding", "q.embedding")


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in view(spark, sf_dir, "embeddings").where("vec_id = 5").first().embedding]


@register("f01_keyword_overlap", duckdb_sql(f"select id from @fragments where {_KW}"))
def f01(spark, sf_dir):
    return view(spark, sf_dir, "fragments").where(F.arrays_overlap("keywords", F.array(*map(F.lit, WORDS)))).select("id")


@register("f02_keyword_contains", duckdb_sql("select id from @fragments where list_contains(keywords, 'that')"))
def f02(spark, sf_dir):
    return view(spark, sf_dir, "fragments").where(F.array_contains("keywords", "that")).select("id")


@register("f21_scope", duckdb_sql(f"select id from @fragments where {_SCOPED} and created_h >= 100 and created_h < 4000 and importance >= 0.2 and affect in ('neutral', 'doubt') and type = 'fact'"))
def f21(spark, sf_dir):
    scope = Scope(agent_id="agent1", workspace="en", from_h=100, to_h=4000, min_importance=0.2, affects=("neutral", "doubt"), equal={"type": "fact"})
    return scope.apply(view(spark, sf_dir, "fragments")).select("id")


@register("a01_keyword_score", duckdb_sql(f"select id, round({_KWS}, 6) as keyword_score from @fragments"))
def a01(spark, sf_dir):
    return view(spark, sf_dir, "fragments").select("id", F.round(scores.keyword_score(F.col("keywords"), WORDS), 6).alias("keyword_score"))


_K01 = f"select id, {_KWS} as keyword_score, importance, created_h, row_number() over (order by {_KWS} desc, importance desc, created_h desc, id) as rank from @fragments where {_SCOPED} and {_KW}"


@register("k01_keyword_search", duckdb_sql(f"select id, round(keyword_score, 6) as keyword_score, rank from ({_K01}) x where rank <= 20"))
def k01(spark, sf_dir):
    found = search.by_keywords(view(spark, sf_dir, "fragments"), WORDS, SCOPE, 20)
    return found.select("id", F.round("keyword_score", 6).alias("keyword_score"), "rank")


@register("x17_cosine", duckdb_sql(f"select v.id, round({_COS}, 6) as similarity from @vectors v, (select embedding from @embeddings where vec_id = 5) q"))
def x17(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return view(spark, sf_dir, "vectors").select("id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity"))


@register("x18_l2_norm", duckdb_sql(f"select id, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) as norm from @vectors"))
def x18(spark, sf_dir):
    v = view(spark, sf_dir, "vectors")
    return v.select("id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@register("x19_topic_centroid", duckdb_sql("select topic, i, round(avg(x), 6) as mean from (select topic, unnest(embedding) as x, unnest(range(len(embedding))) as i from @vectors) t group by topic, i"))
def x19(spark, sf_dir):
    parts = view(spark, sf_dir, "vectors").select("topic", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("topic", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"))


@register("f14_similarity_floor", duckdb_sql(f"select v.id from @vectors v, (select embedding from @embeddings where vec_id = 5) q where {_COS} >= 0.4"))
def f14(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return view(spark, sf_dir, "vectors").where(vectors.cosine(F.col("embedding"), q) >= 0.4).select("id")


_J15 = f"select id, similarity, row_number() over (order by similarity desc, id) as rank from (select v.id, {_COS} as similarity from @vectors v, (select embedding from @embeddings where vec_id = 5) q where v.id in (select id from @fragments where {_SCOPED})) t where similarity >= 0.4"


@register("j15_vector_knn", duckdb_sql(f"select id, round(similarity, 6) as similarity from ({_J15}) x where rank <= 20"))
def j15(spark, sf_dir):
    found = search.by_vector(view(spark, sf_dir, "vectors"), view(spark, sf_dir, "fragments"), _query_vector(spark, sf_dir), SCOPE, limit=20)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


_PAIRS = f"select a.topic, a.id as a, b.id as b, {_cos('a.embedding', 'b.embedding')} as similarity from @vectors a join @vectors b on b.topic = a.topic and a.id < b.id"
_BOTH = f"select a as id, b as neighbour, round(similarity, 9) as s from ({_PAIRS}) p union all select b, a, round(similarity, 9) from ({_PAIRS}) p"


def _knn_sql(k: int, floor: float) -> str:
    return duckdb_sql(f"select id, neighbour, rank from (select id, neighbour, row_number() over (partition by id order by s desc, neighbour) as rank from ({_BOTH}) b where s >= {floor}) x where rank <= {k}")


def _knn(k: int, floor: float):
    return lambda spark, sf_dir: knn.nearest(view(spark, sf_dir, "vectors"), k, floor).select("id", "neighbour", "rank")


register("j16_topic_knn_dedup", _knn_sql(3, 0.92))(_knn(3, 0.92))
register("j17_topic_knn_compress", _knn_sql(10, 0.8))(_knn(10, 0.8))
register("j18_link_candidates", _knn_sql(3, 0.7))(_knn(3, 0.7))


@register(
    "j07_similarity_band_pairs",
    duckdb_sql(
        f"select p.a, p.b, round(p.similarity, 6) as similarity from ({_PAIRS}) p join @fragments f on f.id = p.a join @fragments g on g.id = p.b and g.type = f.type and g.key_id is not distinct from f.key_id "
        "where similarity between 0.7 and 0.85 and not exists (select 1 from @links l where (l.from_id = p.a and l.to_id = p.b) or (l.from_id = p.b and l.to_id = p.a)) order by p.similarity desc, p.a, p.b limit 10"
    ),
)
def j07(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").select("id", "type", "key_id")
    # the join's equal keys are one group: fewer, smaller groups for the block products
    v = view(spark, sf_dir, "vectors").join(f, "id").withColumn("topic", F.concat_ws("\x1f", "topic", "type", F.coalesce("key_id", F.lit("\x00")))).select("topic", "id", "embedding")
    pairs = knn.similar_pairs(v, 0.7).where(F.col("similarity") <= 0.85)
    links = view(spark, sf_dir, "links").select("from_id", "to_id")
    pairs = pairs.join(links, (F.col("a") == F.col("from_id")) & (F.col("b") == F.col("to_id")), "left_anti").join(links, (F.col("b") == F.col("from_id")) & (F.col("a") == F.col("to_id")), "left_anti")
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(10).select("a", "b", F.round("similarity", 6).alias("similarity"))


@register(
    "j19_contradiction_candidates",
    duckdb_sql(
        f"select id, neighbour from (select x.id, x.neighbour, row_number() over (partition by x.id order by x.s desc, x.neighbour) as rn from ({_BOTH}) x join @fragments f on f.id = x.id join @fragments g on g.id = x.neighbour and g.key_id is not distinct from f.key_id "
        "where x.s > 0.85 and not exists (select 1 from @links l where (l.from_id = x.id and l.to_id = x.neighbour) or (l.from_id = x.neighbour and l.to_id = x.id))) y where rn <= 3"
    ),
)
def j19(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").select("id", "key_id")
    v = view(spark, sf_dir, "vectors").join(f, "id").withColumn("topic", F.concat_ws("\x1f", "topic", F.coalesce("key_id", F.lit("\x00")))).select("topic", "id", "embedding")
    # of the links only those inside a group matter
    links, group = view(spark, sf_dir, "links").select("from_id", "to_id"), v.select("id", "topic")
    inside = links.join(group.toDF("from_id", "topic"), "from_id").join(group.toDF("to_id", "other"), "to_id").where("topic = other")
    ends = inside.select(F.col("from_id").alias("id"), F.col("to_id").alias("with")).unionByName(inside.select(F.col("to_id").alias("id"), F.col("from_id").alias("with")))
    v = v.join(ends.groupBy("id").agg(F.collect_set("with").alias("linked")), "id", "left")
    return knn.nearest(v, 3, 0.85).where("round(similarity, 9) > 0.85").select("id", "neighbour")


_BOOST = "case relation_type " + " ".join(f"when '{k}' then {v}e0" for k, v in scores.RELATION_BOOST.items()) + " else 1.0e0 end"


def _neighbour_sql(seeds: str, limit: int) -> str:
    both = f"select to_id as id, weight, relation_type from @links where from_id in ({seeds}) union all select from_id, weight, relation_type from @links where to_id in ({seeds})"
    best = f"select id, weight, relation_type from (select *, row_number() over (partition by id order by weight desc, relation_type) as rn from ({both}) x) y where rn = 1 and id not in ({seeds}) and id in (select id from @fragments where {_SCOPED}) order by id limit {limit}"
    return f"select id, tanh(weight * 0.5e0) * {_BOOST} as score, row_number() over (order by tanh(weight * 0.5e0) * {_BOOST} desc, id) as rank from ({best}) z"


@register("j02_neighbours", duckdb_sql(f"select id, round(score, 6) as score from ({_neighbour_sql('3, 14, 15, 92, 65', 40)}) n"))
def j02(spark, sf_dir):
    seeds = spark.createDataFrame([(i,) for i in (3, 14, 15, 92, 65)], "id long")
    return search.neighbours(view(spark, sf_dir, "links"), view(spark, sf_dir, "fragments"), seeds, SCOPE, 40).select("id", F.round("score", 6).alias("score"))


def _fused_sql(limit: int = 30) -> str:
    time = f"select id, row_number() over (order by created_h desc, id) as rank from @fragments where {_SCOPED}"
    return (
        f"with l1 as (select * from ({_K01}) x where rank <= {limit}), l3 as (select * from ({_J15}) x where rank <= {limit}), "
        f"gr as ({_neighbour_sql('select id from l1 where rank <= 10', 20)}), tm as (select * from ({time}) x where rank <= {limit}), "
        "fused as (select id, sum(part) as rrf, count(*) as layers from (select id, 2.0e0 / (60 + rank) as part from l1 union all select id, 1.0e0 / (60 + rank) from l3 "
        "union all select id, 1.5e0 / (60 + rank) from gr union all select id, 2.0e0 / (60 + rank) from tm) u group by id) "
    )


#: Search tables made so far, by application and folder: where they lie and their schema.
_STORED: dict = {}


def _search_tables(spark, sf_dir):
    """The tables that searches read: fragments without their texts (sorted so that scopes prune row groups), vectors and links. Made once for a folder, as a write path would; a search writes none."""
    made = {}
    for name in ("fragments", "vectors", "links"):
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _STORED:
            rows = view(spark, sf_dir, name)
            rows = rows.drop("content", "content_hash").sortWithinPartitions("agent_id", "workspace", "id") if name == "fragments" else rows
            _STORED[key] = scratch.stored(rows)
        path, schema = _STORED[key]
        made[name] = spark.read.schema(schema).parquet(path)
    return made


def _layers(spark, sf_dir):
    """The search tables and the query's vector."""
    t = _search_tables(spark, sf_dir)
    return t["fragments"], t["vectors"], t["links"], _query_vector(spark, sf_dir)


@register("k06_rrf_merge", duckdb_sql(_fused_sql() + "select id, round(rrf, 6) as rrf, layers from fused"))
def k06(spark, sf_dir):
    f, v, links, q = _layers(spark, sf_dir)
    l1 = search.by_keywords(f, WORDS, SCOPE)
    graph_layer = search.neighbours(links, f, l1.where("rank <= 10").select("id"), SCOPE)
    fused = search.rrf([(l1, 2.0), (search.by_vector(v, f, q, SCOPE), 1.0), (graph_layer, 1.5), (search.by_time(f, SCOPE), 2.0)])
    return fused.select("id", F.round("rrf", 6).alias("rrf"), "layers")


_QUERY = ["that", "thble"]
_COMPOSITE = f"least(1.0e0, importance + 0.5e0 * 0.2e0 * (1 - exp(-ema))) * 0.4e0 + power(2.0e0, -({NOW_H} - created_h) / 720.0e0) * 0.3e0"


def _lexical_sql(query: list[str]) -> str:
    parts = [
        f"(case when lower(topic) = '{q}' then 4.0e0 else 0.0e0 end + case when contains(lower(topic), '{q}') then 2.0e0 else 0.0e0 end + case when list_contains(keywords, '{q}') then 1.5e0 when contains(lower(content), '{q}') then 1.0e0 else 0.0e0 end)"
        for q in query
    ]
    joined = f" + case when contains(lower(topic), '{'-'.join(query)}') then 2.0e0 else 0.0e0 end" if len(query) > 1 else ""
    return " + ".join(parts) + joined


@register("k07_composite_rank", duckdb_sql(f"select id, round({_COMPOSITE} + case when list_contains(keywords, 'that') then 0.35e0 else 0.0e0 end, 6) as score from @fragments"))
def k07(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    s = scores.composite(F.col("importance"), F.col("ema"), F.lit(NOW_H) - F.col("created_h"), F.lit(None).cast("double"), F.array_contains("keywords", "that"))
    return f.select("id", F.round(s, 6).alias("score"))


@register("k09_lexical_score", duckdb_sql(f"select id, {_lexical_sql(_QUERY)} as score from @fragments"))
def k09(spark, sf_dir):
    return view(spark, sf_dir, "fragments").select("id", scores.lexical(F.col("topic"), F.col("keywords"), F.col("content"), _QUERY).alias("score"))


@register(
    "recall_hybrid",
    duckdb_sql(
        _fused_sql()
        + ", ranked as (select f.id, round(x.rrf, 6) as rrf, round((0.85e0 * (f.importance * 0.4e0 + power(2.0e0, -abs("
        + f"{NOW_H} - f.created_h) / 720.0e0) * 0.3e0 + coalesce(l3.similarity, 0) * 0.3e0) + 0.18e0 * least(1.0e0, ln(1 + {_lexical_sql(WORDS)}) / ln(9.0e0))) * case when f.workspace = 'en' then 1 else 0.7e0 end, 6) as score, tokens "
        "from fused x join @fragments f on f.id = x.id left join l3 on l3.id = x.id where is_anchor or f.importance >= 0.1) "
        "select * from (select id, rrf, score, tokens, cast(sum(tokens) over (order by score desc, id rows between unbounded preceding and current row) as bigint) as spent from ranked) y where spent <= 4000"
    ),
)
def recall_hybrid(spark, sf_dir):
    f, v, links, q = _layers(spark, sf_dir)
    return search.recall(f, v, links, WORDS, q, SCOPE, NOW_H, contents=view(spark, sf_dir, "fragments").select("id", "content"))


_CAUSAL = "e as (select distinct from_id, to_id from @links where relation_type in ('caused_by', 'resolved_by'))"
_ROOTS = "select distinct from_id as root from e where from_id not in (select to_id from e)"
#: Chains from the roots with each node's least depth.
_CHAINS = (
    f"{_CAUSAL}, r(root, id, depth) using key (root, id) as (select root, root, 0 from ({_ROOTS}) x union select r.root, e.to_id, r.depth + 1 from r join e on e.from_id = r.id "
    "where not exists (select 1 from recurring.r o where o.root = r.root and o.id = e.to_id)), "
    "solved as (select distinct root from r where id in (select from_id from @links where relation_type = 'resolved_by'))"
)


def recursive(text: str) -> str:
    """A recursive text (``with recursive``) for DuckDB, with its views."""
    return duckdb_sql(text.replace("with recursive", "with", 1)).replace("with ", "with recursive ", 1)


@register(
    "g04_reachability",
    recursive(
        f"with recursive {_CAUSAL}, q as (select distinct to_id as from_id, from_id as to_id from @links where relation_type not in ('caused_by', 'resolved_by')), "
        "r(root, id, depth) using key (root, id) as (select from_id, to_id, 1 from e where from_id in (select from_id from q) union select r.root, e.to_id, r.depth + 1 from r join e on e.from_id = r.id "
        "where r.depth < 20 and not exists (select 1 from recurring.r o where o.root = r.root and o.id = e.to_id)) select q.from_id, q.to_id, r.depth from q join r on r.root = q.from_id and r.id = q.to_id"
    ),
)
def g04(spark, sf_dir):
    """For every link of another kind: does its target reach its source over causal edges in 20 steps, and in how many?"""
    links = view(spark, sf_dir, "links")
    causal = F.col("relation_type").isin("caused_by", "resolved_by")
    return graph.paths(links.where(causal), links.where(~causal).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))


@register("g06_causal_chains", recursive(f"with recursive {_CHAINS} select root, id, depth, root in (select root from solved) as is_resolved from r"))
def g06(spark, sf_dir):
    return graph.causal_chains(view(spark, sf_dir, "links"))


@register(
    "g05_would_cycle",
    recursive(f"with recursive {_CAUSAL}, r(root, id) as (select from_id, to_id from e union select r.root, e.to_id from r join e on e.from_id = r.id) select e.from_id, e.to_id from e join r on r.root = e.to_id and r.id = e.from_id"),
)
def g05(spark, sf_dir):
    """Causal edges that lie on a cycle of any length."""
    return graph.on_cycle(view(spark, sf_dir, "links").where("relation_type in ('caused_by', 'resolved_by')"))


@register(
    "g07_unresolved",
    recursive(
        f"with recursive {_CHAINS} select id from @fragments where resolution_status = 'open' and id not in (select id from r where root in (select root from solved)) "
        "union select id from @fragments where type = 'error' and id not in (select from_id from @links where relation_type = 'resolved_by')"
    ),
)
def g07(spark, sf_dir):
    return graph.unresolved(view(spark, sf_dir, "fragments"), view(spark, sf_dir, "links"))


_SEEDS = "select id from @fragments where id in (3, 14, 15, 92, 65)"


@register(
    "g09_spreading_activation",
    duckdb_sql(
        f"select id, round(greatest(ema, least(1.0e0, ema + 0.1e0)), 6) as ema from @fragments where id not in ({_SEEDS}) and id in (select to_id from @links where from_id in ({_SEEDS}) union select from_id from @links where to_id in ({_SEEDS}))"
    ),
)
def g09(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return graph.spread(view(spark, sf_dir, "links"), f, f.where("id in (3, 14, 15, 92, 65)").select("id"))
