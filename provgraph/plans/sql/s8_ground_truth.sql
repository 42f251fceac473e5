, named as (select md5(actorID) as h from ev_edges union select md5(objectID) from ev_edges)
select substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) as uuid from named where h is not null
