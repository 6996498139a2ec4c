"""Queries of retrieval, groups and graphs, with their SQL.

The stated query set is every row whose id is divisible by 100, scored against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import evidence, graph, retrieval
from windloom.plans.documents import SENTENCES
from windloom.session import checkpointed, table


def _docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs, docs.filter("doc_id % 100 = 0")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    return vectors, vectors.filter("vec_id % 100 = 0")


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs, _ = _docs(spark, sf)
    return retrieval.term_stats(retrieval.postings(docs), docs).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(*_docs(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.overlap(*_docs(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = _docs(spark, sf)
    both = checkpointed(retrieval.search(docs, queries, 30, ("overlap", "bm25")))
    fused = retrieval.fuse(both.filter("kind = 'overlap'"), both.filter("kind = 'bm25'"))
    return fused.withColumn("rank", F.col("rank").cast("long"))


def hybrid_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_relevance(*_docs(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense(*_vectors(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    return retrieval.mmr(retrieval.dense(vectors, queries, 15), vectors).withColumn("position", F.col("position").cast("long"))


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    return evidence.greedy_dedup(retrieval.dense(vectors, queries, 15), vectors, 0.6)


def group_centroid(spark: SparkSession, sf: str) -> DataFrame:
    got = graph.centroids(table(spark, sf, "embeddings"))
    return got.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def centroid_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the even and of the odd rows of each group, blended by their sizes."""
    vectors = table(spark, sf, "embeddings")
    halves = []
    for half in (0, 1):
        own = vectors.filter(F.col("vec_id") % 2 == half)
        halves.append(graph.centroids(own).join(own.groupBy("label").agg(F.count("*").alias("n")), "label"))
    got = graph.blend_centroids(*halves)
    return got.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"), "n")


def route_to_group(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return graph.route(vectors, graph.centroids(vectors), least=0.3)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(graph.similarity_edges(*_vectors(spark, sf), above=0.25))


def similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    return graph.hops(edges, edges.select(F.col("src").alias("node")).distinct()).withColumn("hop", F.col("hop").cast("long"))


def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf))


def related_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    """For each query text, texts that name the same entities, by the number of shared names."""
    found = checkpointed(graph.mentions(table(spark, sf, "documents")).select("doc_id", "entity"))
    return graph.sharing(found, found.filter("doc_id % 100 = 0"))


def fused_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The fused hits with what is known of their documents."""
    known = table(spark, sf, "documents").groupBy("doc_id").agg(F.min(F.lower(F.trim("source"))).alias("source"), F.min("n_chars").alias("n_chars"))
    return rrf_fusion(spark, sf).join(known, "doc_id", "left").select("query_id", "rank", "doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")


def gated_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each query's three best texts that bear on it and aren't among its own, the first six."""
    docs, queries = _docs(spark, sf)
    hits = checkpointed(retrieval.hybrid_relevance(docs, queries, 3))
    facts = evidence.facts(table(spark, sf, "documents"))
    offered = hits.join(facts, "doc_id").select("query_id", F.struct("rank", "pos").alias("place"), "fact")
    held = facts.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "fact")
    got = evidence.gated(queries.select(F.col("doc_id").alias("query_id"), "text"), held, checkpointed(offered))
    return got.select("query_id", F.col("place.rank").cast("long").alias("rank"), F.col("place.pos").cast("long").alias("pos"), "fact", "relevance")


def evidence_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's own facts and those that passed the gates, one after the other, with how many there are of each."""
    own = evidence.facts(table(spark, sf, "documents")).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "fact", F.lit("own").alias("origin"))
    every = own.unionAll(gated_facts(spark, sf).select("query_id", "fact", F.lit("gated").alias("origin"))).filter("fact <> '' and not contains(fact, 'No relevant information')")
    return every.groupBy("query_id", "origin").agg(F.count("*").alias("n_facts"))


def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all rankers in their order, each text with the first ranker that found it."""
    both = checkpointed(retrieval.search(*_docs(spark, sf), 5, ("overlap", "bm25", "hybrid")))
    order = F.when(F.col("kind") == "overlap", 0).when(F.col("kind") == "bm25", 1).otherwise(2)
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct(order.alias("o"), "rank", "kind")).alias("f"))
    return first.select("query_id", "doc_id", F.col("f.kind").alias("kind"), F.col("f.rank").cast("long").alias("rank"))


def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return graph.upserted(*_vectors(spark, sf), above=0.3)


def vector_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of vectors linked by similarity to the stated ones, by size."""
    groups = graph.components(_edges(spark, sf))
    return groups.groupBy("component").agg(F.count("*").alias("n_vectors"))


def mention_components(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are linked through the names they share, directly or over others."""
    found = graph.mentions(table(spark, sf, "documents"))
    edges = found.select((F.col("doc_id")).alias("src"), (-F.pmod(F.xxhash64("entity"), F.lit(1 << 62)) - 1).alias("dst"))
    got = graph.components(edges).filter("node >= 0")
    first = got.groupBy("component").agg(F.min("node").alias("first_doc"), F.count("*").alias("n_docs"))
    return got.join(first, "component").select(F.col("node").alias("doc_id"), "first_doc", "n_docs")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_term_stats, bm25_topk, overlap_topk, rrf_fusion, hybrid_relevance, dense_topk, mmr_rerank, greedy_dedup, group_centroid, centroid_blend, route_to_group,
        similarity_edges, graph_khop, graph_degrees, related_by_entity, mention_components, fused_documents, gated_facts, evidence_pool, candidate_union, node_upsert, vector_groups,
    )
}

_POSTS = """
    w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
    posts AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
    raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY term),
    stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT doc_id AS query_id, term, tf AS qtf FROM posts WHERE doc_id % 100 = 0)
"""
_BM25 = """
    bm AS (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (
            SELECT query_id, p.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / (SELECT avg(len(w)) FROM w)))), 6) AS score
            FROM posts p JOIN asked a ON a.term = p.term JOIN stats s ON s.term = p.term WHERE query_id <> p.doc_id GROUP BY query_id, p.doc_id))
"""
_OVERLAP = """
    ov AS (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (
            SELECT a.query_id, p.doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS score
            FROM posts p JOIN asked a ON a.term = p.term JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id) z ON z.query_id = a.query_id
            WHERE a.query_id <> p.doc_id GROUP BY a.query_id, p.doc_id))
"""
_UNIT = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v)
"""
_EDGES = f"""
    {_UNIT},
    sims AS (SELECT q.vec_id AS src, d.vec_id AS dst, round(list_dot_product(q.e, d.e) / (q.norm * d.norm), 6) AS similarity
        FROM u q JOIN u d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) - 1 AS rank FROM sims),
    edges AS (SELECT src, dst, similarity FROM sims WHERE similarity > 0.25)
"""
_CENTROIDS = """
    long AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM u),
    mean AS (SELECT label, dim, avg(x) AS m FROM long GROUP BY label, dim),
    size AS (SELECT label, sqrt(sum(m * m)) AS s FROM mean GROUP BY label),
    centers AS (SELECT mean.label, dim, CASE WHEN s > 0 THEN m / s ELSE 0 END AS value FROM mean JOIN size ON mean.label IS NOT DISTINCT FROM size.label)
"""

_HYBRID = """
    norms AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM posts GROUP BY doc_id),
    hn AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
    hs AS (SELECT a.query_id, p.doc_id, sum(tf * qtf) AS dot, count(*) AS shared FROM posts p JOIN asked a ON a.term = p.term WHERE a.query_id <> p.doc_id GROUP BY ALL),
    hf AS (SELECT hs.query_id, hs.doc_id, round(0.65 * (dot / (d.norm * q.norm) + 1) / 2 + 0.35 * shared / n, 6) AS score
        FROM hs JOIN hn ON hn.query_id = hs.query_id JOIN norms d ON d.doc_id = hs.doc_id JOIN norms q ON q.doc_id = hs.query_id),
    hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM hf)
"""
_FUSED = f"""
    {_POSTS}, {_BM25}, {_OVERLAP},
    parts AS (SELECT query_id, doc_id, 0.65 / (60 + rank) AS part FROM ov WHERE rank < 30 UNION ALL SELECT query_id, doc_id, 0.35 / (60 + rank) FROM bm WHERE rank < 30),
    f AS (SELECT query_id, doc_id, round(sum(part), 8) AS score FROM parts GROUP BY query_id, doc_id),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 10)
"""
_GATED = """
    o AS (SELECT query_id, rank, pos, fact FROM hy JOIN facts USING (doc_id) WHERE rank < 3),
    ow AS (SELECT query_id, rank, pos, word, count(*) AS tf FROM (SELECT query_id, rank, pos, unnest(regexp_extract_all(lower(fact), '[\\p{L}\\p{N}]+')) AS word FROM o) GROUP BY ALL),
    onorm AS (SELECT query_id, rank, pos, sqrt(sum(tf * tf)) AS norm FROM ow GROUP BY ALL),
    rel AS (SELECT ow.query_id, ow.rank, ow.pos, round(sum(ow.tf * a.qtf) / any_value(onorm.norm * norms.norm), 6) AS relevance FROM ow JOIN onorm USING (query_id, rank, pos)
        JOIN asked a ON a.query_id = ow.query_id AND a.term = ow.word JOIN norms ON norms.doc_id = ow.query_id GROUP BY ALL),
    hw AS (SELECT DISTINCT query_id, fact, word, tf FROM (SELECT doc_id AS query_id, pos, fact, word, count(*) AS tf FROM (SELECT doc_id, pos, fact, unnest(regexp_extract_all(lower(fact), '[\\p{L}\\p{N}]+')) AS word FROM facts WHERE doc_id % 100 = 0) GROUP BY ALL)),
    hnorm AS (SELECT query_id, fact, sqrt(sum(tf * tf)) AS norm FROM hw GROUP BY ALL),
    near AS (SELECT DISTINCT query_id, rank, pos FROM (SELECT ow.query_id, ow.rank, ow.pos, hw.fact, round(sum(ow.tf * hw.tf) / any_value(onorm.norm * hnorm.norm), 6) AS s FROM ow JOIN onorm USING (query_id, rank, pos)
        JOIN hw ON hw.query_id = ow.query_id AND hw.word = ow.word JOIN hnorm ON hnorm.query_id = hw.query_id AND hnorm.fact = hw.fact GROUP BY ALL) WHERE s >= 0.82),
    passed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS k FROM rel WHERE relevance >= 0.45 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.query_id = rel.query_id AND n.rank = rel.rank AND n.pos = rel.pos))
"""

_NEAR = f"""
    {_UNIT},
    sims AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e) / (q.norm * d.norm), 6) AS similarity FROM u q JOIN u d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 15),
    like_each AS (SELECT a.query_id, a.vec_id, a.similarity, a.rank, map(list(b.vec_id), list(list_dot_product(x.e, y.e) / (x.norm * y.norm))) AS m
        FROM near a JOIN near b USING (query_id) JOIN u x ON x.vec_id = a.vec_id JOIN u y ON y.vec_id = b.vec_id GROUP BY ALL)
"""

ORACLE = {
    "mmr_rerank": f"""
        WITH RECURSIVE {_NEAR},
        pick AS (
            SELECT query_id, [vec_id] AS chosen FROM near WHERE rank = 1
            UNION ALL
            SELECT query_id, list_append(chosen, vec_id) FROM (
                SELECT p.query_id, chosen, c.vec_id, row_number() OVER (PARTITION BY p.query_id ORDER BY 0.6 * similarity - 0.4 * list_max(list_transform(chosen, lambda x: m[x])) DESC, rank) AS k
                FROM pick p JOIN like_each c ON c.query_id = p.query_id AND NOT list_contains(chosen, c.vec_id) WHERE len(chosen) < 5) WHERE k = 1
        ),
        last AS (SELECT query_id, max_by(chosen, len(chosen)) AS chosen FROM pick GROUP BY query_id)
        SELECT query_id, chosen[i] AS vec_id, i - 1 AS position FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS i FROM last)
    """,
    "greedy_dedup": f"""
        WITH RECURSIVE {_NEAR},
        keep AS (
            SELECT query_id, 1 AS i, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM near)
            UNION ALL
            SELECT k.query_id, i + 1, CASE WHEN len(kept) = 0 OR list_max(list_transform(kept, lambda x: m[x])) <= 0.6 THEN list_append(kept, c.vec_id) ELSE kept END
            FROM keep k JOIN like_each c ON c.query_id = k.query_id AND c.rank = i
        ),
        last AS (SELECT query_id, max_by(kept, i) AS kept FROM keep GROUP BY query_id)
        SELECT near.query_id, near.vec_id, similarity FROM near JOIN last ON last.query_id = near.query_id AND list_contains(kept, near.vec_id)
    """,
    "mention_components": """
        WITH RECURSIVE m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [0-9]{1,3}\\b')) AS entity FROM documents),
        f AS (SELECT * FROM m WHERE length(entity) BETWEEN 4 AND 100 AND len(list_filter(string_split(entity, ' '), lambda w: length(w) >= 3)) > 0),
        e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b USING (entity)),
        reach AS (SELECT a AS node, a AS least FROM e UNION SELECT b, least FROM reach JOIN e ON node = a WHERE least < b),
        c AS (SELECT node AS doc_id, min(least) AS first_doc FROM reach GROUP BY node)
        SELECT doc_id, first_doc, count(*) OVER (PARTITION BY first_doc) AS n_docs FROM c
    """,
    "fused_documents": f"""
        WITH {_FUSED}, k AS (SELECT doc_id, min(lower(trim(source))) AS source, min(n_chars) AS n_chars FROM documents GROUP BY doc_id)
        SELECT query_id, rank, doc_id, coalesce(source, '') AS source, n_chars FROM fused LEFT JOIN k USING (doc_id)
    """,
    "gated_facts": f"WITH {_POSTS}, {_HYBRID}, {SENTENCES}, {_GATED} SELECT query_id, rank, pos, fact, relevance FROM passed JOIN o USING (query_id, rank, pos) WHERE k <= 6",
    "evidence_pool": f"""
        WITH {_POSTS}, {_HYBRID}, {SENTENCES}, {_GATED},
        every AS (SELECT doc_id AS query_id, fact, 'own' AS origin FROM facts WHERE doc_id % 100 = 0 UNION ALL SELECT query_id, fact, 'gated' FROM passed JOIN o USING (query_id, rank, pos) WHERE k <= 6)
        SELECT query_id, origin, count(*) AS n_facts FROM every WHERE fact <> '' AND NOT contains(fact, 'No relevant information') GROUP BY query_id, origin
    """,
    "candidate_union": f"""
        WITH {_POSTS}, {_BM25}, {_OVERLAP}, {_HYBRID},
        u AS (SELECT query_id, doc_id, rank, 0 AS o, 'overlap' AS kind FROM ov WHERE rank < 5 UNION ALL SELECT query_id, doc_id, rank, 1, 'bm25' FROM bm WHERE rank < 5 UNION ALL SELECT query_id, doc_id, rank, 2, 'hybrid' FROM hy WHERE rank < 5),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY o) AS k FROM u)
        SELECT query_id, doc_id, kind, rank FROM k WHERE k = 1
    """,
    "node_upsert": f"""
        WITH {_UNIT}, s AS (SELECT q.vec_id, d.vec_id AS n, round(list_dot_product(q.e, d.e) / (q.norm * d.norm), 6) AS similarity FROM u q JOIN u d ON q.vec_id % 100 = 0 AND d.vec_id % 100 <> 0),
        b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, n) AS k FROM s)
        SELECT vec_id, CASE WHEN similarity > 0.3 THEN n ELSE vec_id END AS node, similarity FROM b WHERE k = 1
    """,
    "vector_groups": f"""
        WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
        reach AS (SELECT a AS node, a AS least FROM both_ways UNION SELECT b, least FROM reach JOIN both_ways ON node = a WHERE least < b),
        c AS (SELECT node, min(least) AS component FROM reach GROUP BY node)
        SELECT component, count(*) AS n_vectors FROM c GROUP BY component
    """,
    "bm25_term_stats": f"WITH {_POSTS} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "bm25_topk": f"WITH {_POSTS}, {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank < 10",
    "overlap_topk": f"WITH {_POSTS}, {_OVERLAP} SELECT query_id, doc_id, score, rank FROM ov WHERE rank < 10",
    "rrf_fusion": f"""
        WITH {_POSTS}, {_BM25}, {_OVERLAP},
        parts AS (SELECT query_id, doc_id, 0.65 / (60 + rank) AS part FROM ov WHERE rank < 30 UNION ALL SELECT query_id, doc_id, 0.35 / (60 + rank) FROM bm WHERE rank < 30),
        f AS (SELECT query_id, doc_id, round(sum(part), 8) AS score FROM parts GROUP BY query_id, doc_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 10
    """,
    "hybrid_relevance": f"""
        WITH {_POSTS}, norms AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM posts GROUP BY doc_id),
        n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
        s AS (SELECT a.query_id, p.doc_id, sum(tf * qtf) AS dot, count(*) AS shared FROM posts p JOIN asked a ON a.term = p.term WHERE a.query_id <> p.doc_id GROUP BY ALL),
        f AS (SELECT s.query_id, s.doc_id, round(0.65 * (dot / (d.norm * q.norm) + 1) / 2 + 0.35 * shared / n, 6) AS score
            FROM s JOIN n ON n.query_id = s.query_id JOIN norms d ON d.doc_id = s.doc_id JOIN norms q ON q.doc_id = s.query_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 5
    """,
    "dense_topk": f"WITH {_EDGES} SELECT src AS query_id, dst AS vec_id, similarity, rank FROM ranked WHERE rank < 10",
    "group_centroid": f"WITH {_UNIT}, {_CENTROIDS} SELECT label, dim, round(value, 6) AS value FROM centers",
    "centroid_blend": f"""
        WITH {_UNIT},
        long AS (SELECT label, vec_id % 2 AS half, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM u),
        m AS (SELECT label, half, dim, avg(x) AS m FROM long GROUP BY ALL),
        s AS (SELECT label, half, sqrt(sum(m * m)) AS s FROM m GROUP BY ALL),
        c AS (SELECT label, vec_id % 2 AS half, count(*) AS n FROM u GROUP BY ALL),
        b AS (SELECT m.label, dim, sum(CASE WHEN s > 0 THEN m / s ELSE 0 END * n) / sum(n) AS v, sum(n)::BIGINT AS n FROM m JOIN s ON m.label = s.label AND m.half = s.half JOIN c ON m.label = c.label AND m.half = c.half GROUP BY m.label, dim),
        z AS (SELECT label, sqrt(sum(v * v)) AS z FROM b GROUP BY label)
        SELECT b.label, dim, round(CASE WHEN z > 0 THEN v / z ELSE 0 END, 6) AS value, n FROM b JOIN z ON b.label = z.label
    """,
    "route_to_group": f"""
        WITH {_UNIT}, {_CENTROIDS},
        c AS (SELECT label, list(value ORDER BY dim) AS value FROM centers GROUP BY label),
        s AS (SELECT vec_id, c.label, round(list_dot_product(e, value) / norm, 6) AS similarity FROM u JOIN c ON true),
        b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS k FROM s)
        SELECT vec_id, CASE WHEN similarity >= 0.3 THEN label END AS routed, similarity FROM b WHERE k = 1
    """,
    "similarity_edges": f"WITH {_EDGES} SELECT src, dst, similarity FROM edges",
    "graph_khop": f"""
        WITH {_EDGES},
        both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
        h0 AS (SELECT DISTINCT src AS seed, src AS node FROM edges),
        h1 AS (SELECT DISTINCT seed, b AS node FROM h0 JOIN both_ways ON a = node),
        h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN both_ways ON a = node)
        SELECT seed, node, min(hop) AS hop FROM (SELECT seed, node, 0 AS hop FROM h0 UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY seed, node
    """,
    "graph_degrees": f"""
        WITH {_EDGES} SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node
    """,
    "related_by_entity": """
        WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [0-9]{1,3}\\b')) AS entity FROM documents),
        f AS (SELECT * FROM m WHERE length(entity) BETWEEN 4 AND 100 AND len(list_filter(string_split(entity, ' '), lambda w: length(w) >= 3)) > 0)
        SELECT a.doc_id AS query_id, b.doc_id, count(*) AS n_shared FROM f a JOIN f b ON a.entity = b.entity AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY ALL
    """,
}
