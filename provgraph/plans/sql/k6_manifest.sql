 select 'corpus' as name, count(*) as n_total, count(*) filter (label = 1) as n_mal, count(*) filter (label = 0) as n_ben, count(*) as n_listed, cast(sum(sample_id) as bigint) as ids from scores
