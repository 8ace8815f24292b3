"""Result tables to files; what has to be one document is bounded before it is gathered."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_csv(index: DataFrame, path: str) -> None:
    """The entity index as CSV: one line for each entity, most documents first, documents joined by a semicolon."""
    grouped = index.groupBy("entity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), "; ").alias("documents"))
    grouped.orderBy(F.desc("n"), "entity").write.mode("overwrite").option("header", True).csv(path)


def csv(result: DataFrame, path: str, order: tuple[str, ...] = (), blank: tuple[str, ...] = ()) -> None:
    """A result as CSV with a header, lists joined by a semicolon, and empty columns to be filled in by hand."""
    columns = [F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in result.schema.fields]
    flat = result.select(*columns, *[F.lit("").alias(b) for b in blank])
    (flat.orderBy(*order) if order else flat).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def graph_of(document: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link document, as ``node_link`` writes it."""
    parsed = document.select(F.from_json(column, "nodes array<struct<id:string,degree:long,strength:long>>, links array<struct<source:string,target:string,weight:long>>").alias("g"))
    nodes = parsed.select(F.explode("g.nodes").alias("n")).select(F.col("n.id").alias("node"), "n.degree", "n.strength")
    edges = parsed.select(F.explode("g.links").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.weight")
    return nodes, edges


def tables(results: dict[str, DataFrame], path: str) -> None:
    """Each result as Parquet in a folder of its name."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def node_link(nodes: DataFrame, edges: DataFrame, most: int = 300) -> DataFrame:
    """One JSON document of at most ``most`` nodes, the strongest first, the edges among them, and how many nodes there are in all."""
    kept = nodes.orderBy(F.desc("strength"), "node").limit(most)
    inner = edges.join(F.broadcast(kept.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(kept.select(F.col("node").alias("dst"))), "dst", "left_semi")
    n = kept.agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), "degree", "strength"))).alias("nodes"))
    e = inner.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"))).alias("links"))
    total = nodes.agg(F.count("*").alias("nodes_total"))
    return n.crossJoin(e).crossJoin(total).select(F.to_json(F.struct("nodes", "links", "nodes_total")).alias("json"))  # one row each


def gexf(nodes: DataFrame, edges: DataFrame, most: int = 300) -> str:
    """A graph of at most ``most`` nodes, the strongest first, as a GEXF document that says how many there are in all."""
    kept = nodes.orderBy(F.desc("strength"), "node").limit(most)
    names = [r["node"] for r in kept.select("node").collect()]
    place = {n: i for i, n in enumerate(names)}
    inner = edges.join(F.broadcast(kept.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(kept.select(F.col("node").alias("dst"))), "dst", "left_semi")
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', f"<!-- {len(names)} of {nodes.count()} nodes -->", '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>']
    lines += [f'<node id="{i}" label={quoteattr(n)}/>' for n, i in place.items()]
    lines += ["</nodes><edges>"]
    lines += [f'<edge id="{k}" source="{place[r["src"]]}" target="{place[r["dst"]]}" weight="{r["weight"]}"/>' for k, r in enumerate(inner.orderBy("src", "dst").toLocalIterator())]
    return "\n".join([*lines, "</edges></graph></gexf>"])
