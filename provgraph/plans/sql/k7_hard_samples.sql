 select sample_id, 'e' || cast(sample_id as varchar) as edge, prob from scores where label = 1 and prob < 0.5
union all select sample_id, 'e' || cast(sample_id as varchar), prob_after from scores where label = 1 and prob_after < 0.5
