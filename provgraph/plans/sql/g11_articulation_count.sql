, ends as (select graph_id, actorID as node from small_graphs union select graph_id, objectID from small_graphs),
links as (select graph_id, actorID as s, objectID as d from small_graphs where actorID <> objectID union select graph_id, objectID, actorID from small_graphs where actorID <> objectID),
walks as (
  select graph_id, s as cut, min(d) as node from links group by graph_id, s
  union
  select w.graph_id, w.cut, l.d from walks w join links l on l.graph_id = w.graph_id and l.s = w.node and l.d <> w.cut),
parted as (
  select l.graph_id, l.s as cut from links l left join walks w on w.graph_id = l.graph_id and w.cut = l.s and w.node = l.d
  group by l.graph_id, l.s having count(w.node) < count(*))
select e.graph_id, count(p.cut) as articulation from ends e left join parted p on p.graph_id = e.graph_id and p.cut = e.node group by e.graph_id
