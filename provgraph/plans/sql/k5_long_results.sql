, records as (select rq, condition, seed, cast(count(*) as double) as n, max(qty) as q from results group by rq, condition, seed)
select rq, condition, seed, 'rows' as metric, n as value from records
union all select rq, condition, seed, 'largest', q from records
union all select rq, condition, seed, 'none', null from records
