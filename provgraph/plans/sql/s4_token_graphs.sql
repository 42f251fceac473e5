 select count(*) as graphs, cast(3 as double) as mean_nodes, round(avg(n), 6) as mean_edges from (select graph_id, count(*) as n from small_graphs group by graph_id)
