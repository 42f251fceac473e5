 select 'T' || cast(edge_id as varchar) as tid,
  case edge_id % 5 when 0 then '00000000100001' when 1 then '00010000000000' when 4 then '00000001000000' else '00000000000000' end as tactics,
  case edge_id % 3 when 0 then '110000000' when 1 then '001000000' else '000000000' end as platforms,
  cast(case edge_id % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.2 else 0.0 end as double) as privilege, cast(1 - edge_id % 2 as double) as impact from ev_edges
