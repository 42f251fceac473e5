, rows as (select 'runs/' || cast(run_id as varchar) as run_id, step, round(f1, 6) as f1 from steps where cast(run_id as varchar) like '1%' and step % 3 <> 0 and f1 is not null)
select run_id, row_number() over (partition by run_id order by step) as episode, f1, arg_max(f1, step) over (partition by run_id) as last_f1 from rows
