 select actorID, actor_type, objectID, object, action, cast(edge_id as varchar) as timestamp from ev_edges
