"""Documents to answers, and detections to identities."""

from pyspark.sql import functions as F

import runframe as rf
from checks.registry import query, rounded


def chunks(v):
    return rf.chunk(v.docs)


@query("chunk_documents", "SELECT chunk_id, doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, md5(text) AS digest, length(text) AS chars FROM v_chunks")
def chunk_documents(v):
    return chunks(v).select("chunk_id", "doc_id", "chunk_no", F.md5("text").alias("digest"),
                            F.char_length("text").cast("long").alias("chars"))


@query("feature_hash", """
    SELECT chunk_id, idx, count, CAST(sum(count * count) OVER (PARTITION BY chunk_id) AS BIGINT) AS n2,
      round(count / sqrt(CAST(sum(count * count) OVER (PARTITION BY chunk_id) AS DOUBLE)), 9) AS w FROM v_hashed""")
def feature_hash(v):
    return rounded(rf.feature_hash(chunks(v)), "w", digits=9)


@query("embed_chunks", """
    SELECT c.chunk_id, CAST(i AS INTEGER) AS i, CAST(coalesce(count, 0) AS INTEGER) AS v FROM v_chunks c CROSS JOIN range(0, 128) t(i)
    LEFT JOIN v_hashed h ON h.chunk_id = c.chunk_id AND h.idx = i WHERE coalesce(count, 0) <> 0 OR i = 0""")
def embed_chunks(v):
    dense = rf.to_dense(rf.embed(chunks(v))).select("chunk_id", F.posexplode("vec").alias("i", "v"))
    return dense.where("v <> 0 OR i = 0")


MERGED = """
    sizes AS (SELECT source, count(*) AS shard_size FROM v_chunks GROUP BY source),
    offsets AS (SELECT source, shard_size, coalesce(sum(shard_size) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shard_offset FROM sizes),
    merged AS (SELECT chunk_id, source, shard_size, CAST(shard_offset AS BIGINT) AS shard_offset,
      CAST(shard_offset + row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) - 1 AS BIGINT) AS pos FROM v_chunks JOIN offsets USING (source))"""


def merged(v):
    sharded = chunks(v).join(v.docs.select("doc_id", "source"), "doc_id").drop("text")
    return rf.merge_index(sharded, "source").withColumnRenamed("global_pos", "pos")


@query("bucket_index", f"""
    WITH {MERGED}, b AS (SELECT CAST(('0x' || substr(md5(chunk_id), 1, 2))::INTEGER AS INTEGER) AS bucket, pos FROM merged)
    SELECT bucket, pos // 1000 AS segment, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, count(*) AS size FROM b GROUP BY ALL""")
def bucket_index(v):
    index = rf.bucket_index(merged(v), segment=1000)
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("merge_index", f"WITH {MERGED} SELECT chunk_id, source, pos FROM merged")
def merge_index(v):
    return merged(v).select("chunk_id", "source", "pos")


@query("index_summary", f"WITH {MERGED} SELECT source, min(shard_offset) AS shard_offset, count(*) AS shard_size, 128 AS dim FROM merged GROUP BY source")
def index_summary(v):
    return rf.index_summary(merged(v), "source")


HITS = """
    cn AS (SELECT chunk_id, CAST(sum(count * count) AS DOUBLE) AS n2 FROM v_hashed GROUP BY chunk_id),
    qn AS (SELECT query_id, CAST(sum(count * count) AS DOUBLE) AS n2 FROM v_query_hashed GROUP BY query_id),
    dots AS (SELECT query_id, chunk_id, CAST(sum(q.count * c.count) AS DOUBLE) AS d FROM v_query_hashed q JOIN v_hashed c USING (idx) GROUP BY ALL),
    scored AS (SELECT b.item_id AS query_id, m.chunk_id, m.pos, CASE WHEN qn.n2 > 0 AND cn.n2 > 0 THEN coalesce(d, 0) / sqrt(qn.n2 * cn.n2) ELSE 0 END AS score
      FROM benchmark b CROSS JOIN merged m LEFT JOIN cn ON cn.chunk_id = m.chunk_id LEFT JOIN qn ON qn.query_id = b.item_id
      LEFT JOIN dots ON dots.query_id = b.item_id AND dots.chunk_id = m.chunk_id),
    hits AS (SELECT query_id, chunk_id, pos, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored QUALIFY rank <= 5)"""


def hits(v):
    queries = rf.embed(v.table("benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    vectors = rf.embed(chunks(v)).join(merged(v).select("chunk_id", "pos"), "chunk_id")
    return rf.retrieve(queries, vectors)


@query("retrieve", f"WITH {MERGED}, {HITS} SELECT query_id, chunk_id, pos, score, rank FROM hits")
def retrieve(v):
    return hits(v)


@query("retrieval_hits", f"""
    WITH {MERGED}, {HITS} SELECT query_id, string_agg(rank || ':' || chunk_id || ':' || CAST(round(score * 10000) AS BIGINT), ' ' ORDER BY rank) AS hits FROM hits GROUP BY query_id""")
def retrieval_hits(v):
    latencies = v.table("events").selectExpr("value AS latency_s")
    report, _ = rf.retrieval_report(hits(v), latencies)
    entry = F.transform("hits", lambda h: F.concat_ws(":", h["rank"], h["chunk_id"], F.round(h["score"] * 10000).cast("long")))
    return report.select("query_id", F.array_join(entry, " ").alias("hits"))


@query("retrieval_latency", """
    WITH l AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events)
    SELECT max(value) FILTER (k = n // 2) AS latency_p50, max(value) FILTER (k = floor(n * 0.95::DOUBLE)) AS latency_p95 FROM l""")
def retrieval_latency(v):
    latencies = v.table("events").selectExpr("value AS latency_s")
    none = v.table("benchmark").selectExpr("item_id AS query_id", "1 AS rank", "text AS chunk_id", "0.0D AS score")
    return rf.retrieval_report(none, latencies)[1]


# --- detections ---

@query("decode_anchors", """
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS cx, l_discount * 100 AS cy, l_tax * 100 + 5 AS w, 10.0::DOUBLE AS h,
      list_transform(range(0, 10), lambda i: CAST((l_partkey * (i + 3) + l_suppkey * 7 + l_orderkey) % 997 AS DOUBLE) / 997) AS sc FROM lineitem),
    b AS (SELECT *, list_max(sc) AS score, CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS class_id FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, class_id, CASE class_id WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' ELSE 'truck' END AS class,
      cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM b WHERE score >= 0.9 AND class_id IN (2, 3, 5, 7)""")
def decode_anchors(v):
    anchors = v.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity AS cx", "l_discount * 100 AS cy", "l_tax * 100 + 5 AS w", "10.0D AS h",
        "transform(sequence(0, 9), i -> cast((l_partkey * (i + 3) + l_suppkey * 7 + l_orderkey) % 997 AS double) / 997) AS scores")
    return rf.decode_anchors(anchors, conf=0.9).drop("cx", "cy", "w", "h")


@query("frame_index", "SELECT det_id, CAST(dense_rank() OVER (PARTITION BY camera ORDER BY frame) - 1 AS BIGINT) AS frame_index FROM v_boxes")
def frame_index(v):
    return rf.frame_index(v.boxes).select("det_id", "frame_index")


@query("nms", """
    WITH f AS (SELECT camera, frame, list([{'i': det_id, 's': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ORDER BY score DESC, det_id) AS boxes FROM v_boxes GROUP BY camera, frame),
    k AS (SELECT camera, frame, unnest(list_reduce(boxes, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o:
        greatest(least(o.x2, b[1].x2) - greatest(o.x1, b[1].x1), 0) * greatest(least(o.y2, b[1].y2) - greatest(o.y1, b[1].y1), 0) * 1.5
        > 0.5 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (b[1].x2 - b[1].x1) * (b[1].y2 - b[1].y1)))) = 0 THEN list_concat(kept, b) ELSE kept END)) AS o FROM f)
    SELECT camera, frame, o.i AS det_id, o.s AS score FROM k""")
def nms(v):
    return rf.nms(v.boxes, ["camera", "frame"]).select("camera", "frame", "det_id", "score")


def tracked(v, *unused):
    return rf.track(rf.frame_index(v.boxes.drop("score", "class_id", *unused)).drop(*(["frame"] if unused else [])))


@query("track")
def track(v):
    return tracked(v, "class").select("camera", "frame_index", "det_id", "track_id")


@query("summarize_tracks")
def summarize_tracks(v):
    return rf.summarize_tracks(tracked(v)).select("camera", "track_id", "det_count", "class", "frame_first", "frame_last",
                                                  F.round(F.element_at("embedding", 1), 9).alias("e0"))


@query("summarize_groups", """
    WITH t AS (SELECT camera, camera || '-' || class_id AS track_id, det_id, frame, class, embedding FROM v_boxes),
    m AS (SELECT camera, track_id, count(*) AS det_count, arg_min(class, (frame, det_id)) AS class, min(frame) AS frame_first, max(frame) AS frame_last,
      avg(embedding[1]) AS a, avg(embedding[2]) AS b, avg(embedding[3]) AS c FROM t GROUP BY ALL)
    SELECT camera, track_id, det_count, class, frame_first, frame_last, round(a / sqrt(a * a + b * b + c * c), 9) AS e0, round(c / sqrt(a * a + b * b + c * c), 9) AS e2
    FROM m WHERE det_count >= 2""")
def summarize_groups(v):
    given = rf.frame_index(v.boxes).withColumn("track_id", F.concat_ws("-", "camera", "class_id"))
    out = rf.summarize_tracks(given)
    return rounded(out.select("camera", "track_id", "det_count", "class", "frame_first", "frame_last",
                              F.element_at("embedding", 1).alias("e0"), F.element_at("embedding", 3).alias("e2")), "e0", "e2", digits=9)


# at most three tracklets a side: all six ways to pair them; the added thousand puts the number of pairs first
MATCHES = """
    numbered AS (SELECT tracklet_id // 12 AS block, camera, tracklet_id, embedding,
      row_number() OVER (PARTITION BY tracklet_id // 12, camera ORDER BY tracklet_id) AS k FROM v_tracklets),
    sims AS (SELECT a.block, a.camera AS cam_i, b.camera AS cam_j, a.k AS i, b.k AS j, a.tracklet_id AS id_i, b.tracklet_id AS id_j,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS sim
      FROM numbered a JOIN numbered b ON a.block = b.block AND a.camera < b.camera),
    ways AS (SELECT * FROM (VALUES (1, 1, 2, 3), (2, 1, 3, 2), (3, 2, 1, 3), (4, 2, 3, 1), (5, 3, 1, 2), (6, 3, 2, 1)) x(way, j1, j2, j3)),
    picks AS (SELECT way, 1 AS i, j1 AS j FROM ways UNION ALL SELECT way, 2, j2 FROM ways UNION ALL SELECT way, 3, j3 FROM ways),
    totals AS (SELECT block, cam_i, cam_j, way, sum(sim + 1000) AS total FROM sims JOIN picks USING (i, j) GROUP BY ALL),
    chosen AS (SELECT block, cam_i, cam_j, arg_max(way, total) AS way FROM totals GROUP BY ALL),
    matched AS (SELECT block, cam_i, cam_j, id_i, id_j, sim FROM chosen JOIN picks USING (way) JOIN sims USING (block, cam_i, cam_j, i, j) WHERE sim >= 0.3)"""


def matches(v):
    """Optimal matches inside blocks of twelve neighbouring vectors: three tracklets of each of four cameras."""
    return rf.match_cameras(v.tracklets.withColumn("block", F.expr("tracklet_id div 12")), sim_min=0.3, by="block")


@query("match_cameras", f"WITH {MATCHES.strip()} SELECT block, cam_i, cam_j, id_i, id_j, round(sim, 9) AS sim FROM matched")
def match_cameras(v):
    return rounded(matches(v), "sim", digits=9)


PAIR_TABLE = MATCHES + """,
    pairs AS (SELECT cam_i, cam_j, id_i, id_j FROM matched),
    nodes AS (SELECT camera || '/' || lpad(CAST(tracklet_id AS VARCHAR), 9, '0') AS id FROM v_tracklets),
    e AS (SELECT cam_i || '/' || lpad(CAST(id_i AS VARCHAR), 9, '0') AS a, cam_j || '/' || lpad(CAST(id_j AS VARCHAR), 9, '0') AS b FROM pairs),
    two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT id, id AS root FROM nodes UNION SELECT two.a, reach.root FROM reach JOIN two ON two.b = reach.id),
    member AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query("identities", f"""
    WITH RECURSIVE {PAIR_TABLE.strip()}
    SELECT split_part(id, '/', 1) AS camera, CAST(split_part(id, '/', 2) AS BIGINT) AS tracklet_id, split_part(root, '/', 1) AS root_camera,
      CAST(split_part(root, '/', 2) AS BIGINT) AS root_tracklet FROM member""")
def identities(v):
    return rf.identities(v.tracklets, matches(v))


GLOBAL = PAIR_TABLE + """,
    g AS (SELECT dense_rank() OVER (ORDER BY root) AS global_id, id, camera, class, det_count FROM member
      JOIN v_tracklets ON id = camera || '/' || lpad(CAST(tracklet_id AS VARCHAR), 9, '0')),
    c AS (SELECT global_id, class, sum(det_count) AS w, min(id) AS first FROM g GROUP BY ALL),
    best AS (SELECT global_id, class FROM c QUALIFY row_number() OVER (PARTITION BY global_id ORDER BY w DESC, first) = 1),
    summary AS (SELECT CAST(global_id AS BIGINT) AS global_id, best.class, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, count(*) AS hop_count,
      CAST(sum(det_count) AS BIGINT) AS det_count_total FROM g JOIN best USING (global_id) GROUP BY ALL)"""


@query("global_tracks", f"WITH RECURSIVE {GLOBAL.strip()} SELECT * FROM summary")
def global_tracks(v):
    return rf.global_tracks(rf.identities(v.tracklets, matches(v)), v.tracklets)[0]


@query("identity_report", f"""
    WITH RECURSIVE {GLOBAL.strip()} SELECT *, row_number() OVER (ORDER BY class, det_count_total DESC, global_id) AS rank FROM summary""")
def identity_report(v):
    """From tracklets to the ranked traffic report through optimal matching."""
    tracks, hops = rf.global_tracks(rf.identities(v.tracklets, matches(v)), v.tracklets)
    return rf.traffic_report(tracks.select("global_id", "class"), hops)[1]


# the same four over whole camera pairs: an assignment of any size has no closed SQL form, tests compare it with brute force

def whole_matches(v):
    """Optimal matches of all tracklets of each camera pair."""
    return rf.match_cameras(v.tracklets, sim_min=0.3)


@query("match_cameras_whole")
def match_cameras_whole(v):
    return rounded(whole_matches(v), "sim", digits=9)


@query("identities_whole")
def identities_whole(v):
    return rf.identities(v.tracklets, whole_matches(v))


@query("global_tracks_whole")
def global_tracks_whole(v):
    return rf.global_tracks(identities_whole(v), v.tracklets)[0]


@query("identity_report_whole")
def identity_report_whole(v):
    tracks, hops = rf.global_tracks(identities_whole(v), v.tracklets)
    return rf.traffic_report(tracks.select("global_id", "class"), hops)[1]


@query("stage_flow", "SELECT source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_chunks GROUP BY source")
def stage_flow(v):
    flow = rf.Stages()
    flow.source("docs", v.docs)
    flow.stage("chunks", ["docs"], lambda inputs: rf.chunk(inputs["docs"]))
    flow.stage("report", ["chunks", "docs"], lambda inputs: (
        inputs["chunks"].join(inputs["docs"].select("doc_id", "source"), "doc_id").groupBy("source")
        .agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text")).alias("chars"))))
    return flow.result("report")
