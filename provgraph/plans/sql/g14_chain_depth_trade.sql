, links as (select distinct src, dst from trade_edges),
sources as (select distinct src as node from links where src not in (select dst from links)),
reach as (select node as source, node, 0 as hop from sources union select r.source, l.dst, r.hop + 1 from reach r join links l on l.src = r.node),
nearest as (select source, node, min(hop) as hop from reach group by source, node),
far as (select source, max(hop) as hop from nearest group by source)
select 'trade' as graph_id, round(least(coalesce(avg(hop), 0) / 6, 1), 6) as chain_depth from far
