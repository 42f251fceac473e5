 select graph_id, cast(row_number() over (partition by graph_id order by edge_id) - 1 as integer) as edge_idx, actorID as src, objectID as dst, action as verb from small_graphs
