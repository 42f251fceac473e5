, told as (
  select edge_id, action, list_sort(list_distinct(list_concat(list_concat(
    case edge_id % 5 when 0 then ['discovery', 'file', 'network', 'impact'] when 1 then ['execution', 'file', 'process'] when 4 then ['credential', 'file'] else [] end,
    case edge_id % 4 when 0 then ['credential'] when 1 then ['network'] when 2 then ['file'] else [] end),
    list_concat(case when edge_id % 7 = 0 or action = 'execute' then ['execution'] else [] end, [])))) as caps from ev_edges)
select 'T' || cast(edge_id as varchar) as tid, action as name,
  case edge_id % 5 when 0 then 'discovery,impact' when 1 then 'execution' when 4 then 'credential-access,unknown' else '' end as tactics,
  case edge_id % 3 when 0 then 'linux,windows' when 1 then 'macos' else '' end as platforms,
  case when edge_id % 7 = 0 then 'process: commands' else '' end as data_sources, array_to_string(caps, ',') as capabilities,
  cast(case edge_id % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.2 else 0.0 end as double) as privilege, edge_id % 2 = 0 as impact,
  list_contains(caps, 'network') as requires_network, list_contains(caps, 'execution') as requires_execution,
  list_contains(caps, 'credential') or list_contains(caps, 'persistence') or list_contains(caps, 'privilege') as produces_access from told
