 select 'day ' || substring(graph_id, 9, 2) as dataset, graph_id, edge_id, actorID, objectID, action from ev_edges
