"""Graphs that a task can hold: they are dealt whole, one row a graph, while larger ones go through rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from provgraph.session import Scratch

#: Most edges of a graph that is dealt whole.
HELD = 256
#: Types of nodes that tasks take as text.
PLAIN = (StringType, LongType, IntegerType, ShortType, ByteType)
#: Types of what is found in a graph.
TYPES = {"bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
#: Graphs that a task turns into Python values at a time.
SLICE = 256


def split(edges: DataFrame, scratch: Scratch, held: int = HELD, columns: Sequence[str] = ()) -> tuple[DataFrame | None, DataFrame | None]:
    """Graphs of up to ``held`` edges (graph_id, src, dst, ...) as rows (graph_id, src, dst, columns; arrays, nodes as text), and the edges of the others; None for none.

    Nodes must be text or whole numbers for the first; otherwise all graphs count as large. Repeated edges count for the size.
    """
    if held <= 0 or not all(isinstance(edges.schema[c].dataType, PLAIN) for c in ("src", "dst")):
        return None, edges
    sizes = scratch.table(edges.groupBy("graph_id").agg(F.count("*").alias("_n")))
    least, most = sizes.agg(F.min("_n"), F.max("_n")).first()
    if least is None or least > held:
        return None, edges
    small, large = edges, None
    if most > held:
        of = sizes.where(F.col("_n") > held).select(F.col("graph_id").alias("_of")).hint("merge")
        same = F.col("graph_id").eqNullSafe(F.col("_of"))
        small, large = edges.join(of, same, "left_anti"), edges.join(of, same, "left_semi")
    names = ["src", "dst", *columns]
    ends = F.struct(*(F.col(c).cast("string").alias(c) for c in ("src", "dst")), *columns)
    whole = small.groupBy("graph_id").agg(F.collect_list(ends).alias("_e"))
    return whole.select("graph_id", *(F.col(f"_e.{c}").alias(c) for c in names)), large


def per_graph(whole: DataFrame, found: Callable[..., tuple], results: str) -> DataFrame:
    """(graph_id, results): what ``found`` says of each row (graph_id, lists) of ``split``; ``results`` are columns with types of ``TYPES``."""
    schema = f"graph_id {whole.schema['graph_id'].dataType.simpleString()}, {results}"
    named = [part.split() for part in results.split(",")]
    names, types = ["graph_id", *(name for name, _ in named)], [TYPES[kind] for _, kind in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = zip(*(found(*lists) for lists in zip(*(c.to_pylist() for c in part.columns[1:]))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(values, kind) for values, kind in zip(rows, types))], names=names)

    return whole.mapInArrow(run, schema)
