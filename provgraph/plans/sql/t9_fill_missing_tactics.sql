, candidates as (select id as item, case id % 3 when 0 then 'execution' when 1 then 'persistence' else 'exfiltration' end as tactic, vec from vectors),
chain as (select cast(floor(item / 50) as bigint) as chain_id, cast(item % 50 as bigint) as pos, item, tactic, vec from candidates where item % 50 < 3 and item % 7 < 5),
last1 as (
  select chain_id, max(pos) as pos, arg_max(vec, pos) as vec from chain group by chain_id
  having count(*) filter (tactic = 'exfiltration') = 0 and count(*) < 4),
filled1 as (
  select * from chain
  union all
  select chain_id, pos, item, 'exfiltration', vec from (
    select l.chain_id, l.pos + 1 as pos, c.item, c.vec,
      row_number() over (partition by l.chain_id order by round(list_dot_product(cast(l.vec as double[]), cast(c.vec as double[])) / (sqrt(list_dot_product(cast(l.vec as double[]), cast(l.vec as double[]))) * sqrt(list_dot_product(cast(c.vec as double[]), cast(c.vec as double[])))), 9) desc, c.item) as place
    from last1 l join candidates c on c.tactic = 'exfiltration')
  where place = 1),
last2 as (
  select chain_id, max(pos) as pos, arg_max(vec, pos) as vec from filled1 group by chain_id
  having count(*) filter (tactic = 'execution') = 0 and count(*) < 4),
filled2 as (
  select * from filled1
  union all
  select chain_id, pos, item, 'execution', vec from (
    select l.chain_id, l.pos + 1 as pos, c.item, c.vec,
      row_number() over (partition by l.chain_id order by round(list_dot_product(cast(l.vec as double[]), cast(c.vec as double[])) / (sqrt(list_dot_product(cast(l.vec as double[]), cast(l.vec as double[]))) * sqrt(list_dot_product(cast(c.vec as double[]), cast(c.vec as double[])))), 9) desc, c.item) as place
    from last2 l join candidates c on c.tactic = 'execution')
  where place = 1),
last3 as (
  select chain_id, max(pos) as pos, arg_max(vec, pos) as vec from filled2 group by chain_id
  having count(*) filter (tactic = 'persistence') = 0 and count(*) < 4),
filled3 as (
  select * from filled2
  union all
  select chain_id, pos, item, 'persistence', vec from (
    select l.chain_id, l.pos + 1 as pos, c.item, c.vec,
      row_number() over (partition by l.chain_id order by round(list_dot_product(cast(l.vec as double[]), cast(c.vec as double[])) / (sqrt(list_dot_product(cast(l.vec as double[]), cast(l.vec as double[]))) * sqrt(list_dot_product(cast(c.vec as double[]), cast(c.vec as double[])))), 9) desc, c.item) as place
    from last3 l join candidates c on c.tactic = 'persistence')
  where place = 1)
select chain_id, pos, item, tactic from filled3
