"""runframe: run telemetry, document retrieval and multi-source tracking on Spark DataFrames."""

from runframe.functions.geometry import (
    assoc_candidates, box_to_letterbox, box_to_original, center_to_corners, iou_pairs, letterbox_geometry, links)
from runframe.functions.runtime import configure, spread
from runframe.functions.values import (
    backfill_start, map_values, normalize_resources, normalize_sizes, parse_names, pct, run_diff, runs_of, search,
    two_hop_phases, valid_runs)
from runframe.functions.vectors import cosine_pairs, normalize_vectors
from runframe.operators.aggregates import (
    agent_overhead, cluster_totals, correctness_rollup, ema_profile, finalize_stale, fuse_detections,
    heat_band, link_classes, link_ema, link_traffic, majority_class, mean_pair_bandwidth, merge_summary,
    mission_summary, observed_bandwidth, outcome_counts, pivot_matrix, placement_share, profile_matrix,
    provenance, run_rollup, source_counts, template_summary, traffic_report)
from runframe.operators.graph import connected_components, critical_path, dag_layers, successors, upward_rank
from runframe.operators.integrity import block_manifest, classify_puts, content_digest, digest_match, stuck_transfers
from runframe.operators.joins import (
    cluster_view, diff_reports, edge_transfers, flow_contention, owned_by, paired, paired_by_position,
    pick_flows, predicted_vs_actual, ready_tasks, resolve_bandwidth, resolve_bytes, resolve_runtime,
    with_embeddings, with_frame_meta)
from runframe.operators.scan import scan
from runframe.operators.sorting import by_created, cell_sort_key, natural_rep, sort_runs, top_values
from runframe.operators.stats import (
    cell_stats, grouped_means, histogram, history_stats, nearest_rank, paired_bootstrap, percentiles,
    prediction_error,
    seed_speedup_median, sensitivity, speedup, verdict)
from runframe.operators.text import (
    bucket_index, chunk, embed, feature_hash, index_summary, merge_index, retrieval_report, retrieve, to_dense)
from runframe.operators.tracking import (
    decode_anchors, frame_index, global_tracks, identities, match_cameras, nms, summarize_tracks, track)
from runframe.operators.windows import (
    assign_lanes, busy_time, common_keys, counter_deltas, fan_in, gc_runs, latest, max_overlap, mean_positive_delta,
    minus, node_set, number_runs, recent_history, retention, shard_offsets, size_cap, top_k, trend, warm_window)
from runframe.plans.stages import Stages
from runframe.plans.timelines import rebase, run_report
from runframe.sources.readers import (
    cell_columns, clean_runs, consolidate_cells, csv_columns, explode_runs, flatten_agent_metrics,
    flow_columns, links_from_map, parse_flow_lines, read_agent_metrics, read_blobs, read_flows,
    read_jsonl_docs, read_links, read_runs, read_two_hop, two_hop_columns)
from runframe.sources.sinks import append_flows, append_history, size_shards, write_report, write_shards, write_texts
from runframe.streaming.keyed import ema_stream, phase_changes, ready_stream, track_stream
from runframe.streaming.operators import append_once, latest_state, on, on_batch, publish, rolling_metrics, subscribe
