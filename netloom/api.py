"""The operators that take a graph first, by name; Graph offers each as a method."""

from __future__ import annotations

from netloom.operators import access, ensembles, measures, mutate, transform, traverse
from netloom.sources import constructors, dot

_MODULES = {
    mutate: "add_edges add_edge remove_edges remove_edge clear_edges sort_adj shuffle_adjs payload_update edge_status",
    access: "vertex_count edge_count at adjacency containers container neighbors raw_edges neighbor_vertices payloads adj_first is_adjacent degrees degree",
    traverse: "multi_source_bfs bfs all_sources bfs_filtered is_handled dfs bfs_mut dfs_mut",
    measures: "average_degree degree_histogram leaf_count labels connected_components_ids connected_components suggest_connections is_connected core q_core diameter longest_shortest_path transitivity vertex_biconnected_components vertex_load closeness_centrality sw_long_ranging",
    transform: "clone_topology cloned_subgraph chain_components make_connected",
    ensembles: "measure_grouped",
    constructors: "init_ring init_ring_2 graph_from_generic reset_from_graph",
    dot: "dot_lines dot_from_indices dot_with_indices dot_string to_dot to_dot_with_labels dog_dot write_dot json_state save_json",
}
METHODS = {name: getattr(module, name) for module, names in _MODULES.items() for name in names.split()}
