"""Event-graph views over the given tables, in Spark and in the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provgraph.session import read_table

_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}
_DAY = {"spark": "date_format(ts, 'yyyy-MM-dd')", "duckdb": "strftime(ts, '%Y-%m-%d')"}
_DIV = {"spark": "div", "duckdb": "//"}
_HEX = {"spark": "cast(conv(substring(md5(concat_ws('|', '{salt}', cast({key} as string))), 1, 6), 16, 10) as bigint)", "duckdb": "cast('0x' || substring(md5(concat_ws('|', '{salt}', cast({key} as varchar))), 1, 6) as bigint)"}
_TEXT = {"spark": "string", "duckdb": "varchar"}

#: Fixed lists of the mixed view.
VERBS, TYPES = ["RD", "WR", "EX", "UK", "CD", "FR", "IJ", "ST", "RF"], ["MP", "TP*", "3_MF-x", "SF", "TF", "SO", "*MP", "ZZ"]
TOOLS = ["bash", "0_MP*-find", "TP-curl", "cmd.exe", "/usr/bin/python3", "ssh-keygen", "MP-12", "nmap*", "", "evil.bin", "C:\\\\tools\\\\gdb.exe", "cat"]
TARGETS = ["run.sh", "notes.txt", "unknown", "", "10.0.0.7", "http://a.b/c.py", "3_SF-1.zip", "tool.EXE", "passwd", "lib.so", "x.9", "job.py"]
CODES, KINDS = ["FR", "RF", "WF", "EX", "ST", "RCV", "IJ", "LOAD", "LATERAL_MOVE"], ["process", "file", "socket"]


def _hex(engine: str, salt: str, key: str) -> str:
    return _HEX[engine].format(salt=salt, key=key)


def _pick(engine: str, values: list[str], salt: str, key: str = "edge_id") -> str:
    at = f"{_hex(engine, salt, key)} % {len(values)}"
    return f"(case {at} " + " ".join(f"when {i} then '{v if engine == 'spark' else v.replace(chr(92) * 2, chr(92))}'" for i, v in enumerate(values)) + " end)"


def view_sql(engine: str) -> dict[str, str]:
    k, text = _K[engine], _TEXT[engine]
    share = lambda salt, key: f"(cast({_hex(engine, salt, key)} % 101 as double) / 100)"
    wide = lambda x: f"cast({x} as double)"
    kind = lambda n: f"case {n} % 3 when 0 then 'process' when 1 then 'file' else 'socket' end"
    action = "case event_type when 'view' then 'read' when 'click' then 'execute' when 'purchase' then 'send' when 'signup' then 'clone' else 'write' end"
    return {
        "ev_edges": f"select {_DAY[engine]} as graph_id, event_id as edge_id, 'u' || cast(user_id as {text}) as actorID, 'process' as actor_type, 'o' || cast({k} as {text}) as objectID, "
        f"case when {k} % 10 = 0 then 'socket' else 'file' end as object, {action} as action from events",
        "small_graphs": f"select cast(event_id {_DIV[engine]} 40 as {text}) as graph_id, event_id as edge_id, 'n' || cast(user_id % 48 as {text}) as actorID, {kind('(user_id % 48)')} as actor_type, "
        f"'n' || cast({k} % 48 as {text}) as objectID, {kind(f'({k} % 48)')} as object, {action} as action from events",
        "mix_edges": f"select graph_id, edge_id, {_pick(engine, VERBS, 'verb')} as verb, {_pick(engine, TYPES, 'src')} as src_type, {_pick(engine, TYPES, 'dst')} as dst_type, {_pick(engine, TOOLS, 'tool')} as tool, "
        f"{_pick(engine, TARGETS, 'target')} as target, {_pick(engine, CODES, 'code')} as code, {_pick(engine, KINDS, 'sk')} as src_kind, {_pick(engine, KINDS, 'dk')} as dst_kind, {_hex(engine, 'bridge', 'edge_id')} % 5 = 0 as is_bridge from ev_edges",
        "trade_edges": f"select 'trade' as graph_id, 1 as stage, 'c' || cast(o_custkey as {text}) as src, 'o' || cast(o_orderkey as {text}) as dst from orders "
        f"union all select 'trade', 2, 'o' || cast(l_orderkey as {text}), 'p' || cast(l_partkey as {text}) from lineitem "
        f"union all select 'trade', 3, 'p' || cast(l_partkey as {text}), 's' || cast(l_suppkey as {text}) from lineitem "
        f"union all select 'trade', 4, 's' || cast(s_suppkey as {text}), 'n' || cast(s_nationkey as {text}) from supplier",
        "scores": f"select l.doc_id as sample_id, l.toxic as label, {wide(share('base', 'l.doc_id'))} as prob, case when {_hex(engine, 'skip', 'l.doc_id')} % 17 = 0 then null else {wide(share('after', 'l.doc_id'))} end as prob_after, "
        f"d.lang as grp, {'cast(' + _hex(engine, 'camo', 'l.doc_id') + ' % 4 as double) / 2'} as camo_ratio from labels l join documents d on l.doc_id = d.doc_id",
        "vectors": "select vec_id as id, embedding as vec, label as grp from embeddings",
        "steps": f"select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as step, (row_number() over (partition by user_id order by ts, event_id) - 1) {_DIV[engine]} 10 as episode, "
        f"case when event_type in ('click', 'purchase') then 1 else 0 end as tp, case when event_type = 'signup' then 1 else 0 end as fp, case when event_type = 'error' then 1 else 0 end as fn, event_type, "
        f"{wide(f'case when user_id % 3 = 0 then 0.75 + {share("f1", "event_id")} / 5 else {share("f1", "event_id")} / (1 + user_id % 2 * 29) end')} as f1, "
        f"{wide(f'case when user_id % 3 = 0 then 0.1 + {share("miss", "event_id")} / 50 else 0.75 + {share("miss", "event_id")} / 4 end')} as miss_rate, {wide(share('reward', 'event_id') + ' / (1 + user_id % 4)')} as reward, {wide(share('comb', 'event_id'))} as combined from events",
        "results": "select 'q' as rq, concat(l_returnflag, l_linestatus) as condition, cast(extract(year from l_shipdate) as int) as seed, cast(l_quantity as double) as qty, cast(l_discount as double) as disc from lineitem",
    }


NEEDS = {"mix_edges": ["ev_edges"]}
TABLES = {
    "ev_edges": ["events"], "small_graphs": ["events"], "mix_edges": ["events"], "trade_edges": ["orders", "lineitem", "supplier"],
    "scores": ["labels", "documents"], "vectors": ["embeddings"], "steps": ["events"], "results": ["lineitem"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; tables are passed by reference, so no name is left in the catalog."""
    sql, frames = view_sql("spark"), {}
    for table in TABLES[name]:
        frames[table] = read_table(spark, sf_dir, table)
    for other in NEEDS.get(name, []):
        frames = {other: view(spark, sf_dir, other)}
    text = sql[name].replace("{", "{{").replace("}", "}}")
    for frame in frames:
        for lead in ("from ", "join "):
            text = text.replace(f"{lead}{frame}", f"{lead}{{{frame}}}")
    return spark.sql(text, **frames)


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL: the query behind the views that it names."""
    sql = view_sql("duckdb")
    order = [*(n for x in names for n in NEEDS.get(x, [])), *names]
    return "with recursive " + ", ".join(f"{n} as ({sql[n]})" for n in dict.fromkeys(order)) + " " + query
