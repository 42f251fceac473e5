 select 'Group ' || actorID as actor, case when objectID like '%7' then 'S' else 'T' end || objectID as tid, edge_id as pos from ev_edges where action = 'read' and objectID is not null and actorID is not null
