, links as (select distinct src as s, dst as d from trade_edges),
paths as (select s as node, 0 as steps from links union select l.d, p.steps + 1 from paths p join links l on l.s = p.node)
select 'trade' as graph_id, max(steps) as depth, round(max(steps) / (select count(*) from (select s from links union select d from links)), 6) as depth_ratio from paths
