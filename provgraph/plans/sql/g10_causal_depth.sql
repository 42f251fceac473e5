, ends as (select graph_id, actorID as node from small_graphs union select graph_id, objectID from small_graphs),
links as (select distinct graph_id, actorID as s, objectID as d from small_graphs where actorID <> objectID),
reach as (select graph_id, node as s, node as d from ends union select r.graph_id, r.s, l.d from reach r join links l on l.graph_id = r.graph_id and l.s = r.d),
parts as (select a.graph_id, a.s as node, min(a.d) as part from reach a join reach b on b.graph_id = a.graph_id and b.s = a.d and b.d = a.s group by a.graph_id, a.s),
condensed as (select distinct l.graph_id, p.part as s, q.part as d from links l join parts p on p.graph_id = l.graph_id and p.node = l.s join parts q on q.graph_id = l.graph_id and q.node = l.d where p.part <> q.part),
paths as (select graph_id, s as node, 0 as steps from condensed union select p.graph_id, c.d, p.steps + 1 from paths p join condensed c on c.graph_id = p.graph_id and c.s = p.node)
select e.graph_id, coalesce(max(p.steps), 0) as depth, round(coalesce(max(p.steps), 0) / e.n, 6) as depth_ratio
from (select graph_id, count(*) as n from ends group by graph_id) e left join paths p on p.graph_id = e.graph_id group by e.graph_id, e.n
