 select 'g' || graph_id || '_v' as sample_id, 'e' || lpad(cast(row_number() over (partition by graph_id order by edge_id) - 1 as varchar), 6, '0') as id, actorID as source, objectID as target, action as type, cast(edge_id as integer) as event_order, edge_id % 5 = 0 as is_bridge from small_graphs
