 select 'prob' as run, grp, count(prob) as n, count(*) filter (prob >= 0.5) as above from scores group by grp
union all select 'prob_after', grp, count(prob_after), count(*) filter (prob_after >= 0.5) from scores group by grp
