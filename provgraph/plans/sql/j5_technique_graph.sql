 select 'T' || actorID as src, 'T' || objectID as dst, arg_max(case action when 'read' then 'uses' else 'related-to' end, edge_id) as kind from ev_edges
where action in ('read', 'write') and actorID not like '%7' and objectID not like '%7' group by actorID, objectID
