 select distinct actorID || '-a' as technique_id, 'linux' as os, 'MF' as entity_type, objectID as name from ev_edges where actorID is not null and objectID is not null
