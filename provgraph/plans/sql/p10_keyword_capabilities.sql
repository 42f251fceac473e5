 select 'T' || cast(edge_id as varchar) as tid, array_to_string(list_sort(list_distinct(list_concat(
  case edge_id % 5 when 0 then ['discovery', 'file', 'network', 'impact'] when 1 then ['execution', 'file', 'process'] when 4 then ['credential', 'file'] else [] end,
  case edge_id % 4 when 0 then ['credential'] when 1 then ['network'] when 2 then ['file'] else [] end))), ',') as capabilities from ev_edges
