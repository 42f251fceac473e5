 select actorID as src, 'process' as actor_type, objectID as dst, max(object) over (partition by objectID) as object, action, cast(edge_id as varchar) as ts from ev_edges where action <> 'write'
