 select r.action as rule, 'MF' as entity_type, 'n' || cast(l.edge_id as varchar) as name from (select distinct action, objectID from ev_edges) r join ev_edges l on l.objectID = r.objectID and l.edge_id % 2 = 0
