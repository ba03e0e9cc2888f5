"""Property graphs as two DataFrames: guards, bounded traversal, upserts, and ingestion of chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, InvalidGraph
from tessella.model import Page, conformed, guarded, valid_edges, valid_nodes
from tessella.predicate import bind, compiled, is_empty
from tessella.runtime import local_rows, stored
from tessella.schema import Schema, empty_schema

DIRECTIONS = ("outbound", "inbound", "undirected")


@dataclass(frozen=True)
class GraphSchema:
    nodes: Schema
    edges: Schema


@dataclass(frozen=True)
class Graph:
    """nodes (id, labels, content, attributes, _ord) and edges (id, source_id, target_id, type, attributes, _ord)."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Traversal:
    seeds: Sequence[str]
    direction: str = "outbound"
    depth: int = 1
    node_filter: object = None
    edge_filter: object = None
    page: Page | None = None

    def __post_init__(self) -> None:
        if not self.seeds:
            raise InvalidArgument("a traversal needs seeds")
        if self.direction not in DIRECTIONS:
            raise InvalidArgument(f"direction {self.direction!r}")
        if not isinstance(self.depth, int) or isinstance(self.depth, bool) or self.depth <= 0:
            raise InvalidArgument("depth must be positive")


def violations(graph: Graph) -> DataFrame:
    """(problem, id) of repeated node and edge ids and of edges whose ends aren't among the nodes."""
    twice = lambda df, what: df.groupBy("id").count().filter("count > 1").select(F.lit(what).alias("problem"), "id")
    ids = graph.nodes.select("id").distinct()
    out = twice(graph.nodes, "repeated node").unionByName(twice(graph.edges, "repeated edge"))
    for end in ("source_id", "target_id"):
        lost = graph.edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        out = out.unionByName(lost.select(F.lit(f"dangling {end}").alias("problem"), "id"))
    return out


def checked(graph: Graph) -> Graph:
    """The graph with guards on its rows, after one action that finds no violation."""
    found = violations(graph).limit(5).collect()
    if found:
        raise InvalidGraph("; ".join(f"{r['problem']} {r['id']}" for r in found))
    return Graph(valid_nodes(graph.nodes), valid_edges(graph.edges))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"))
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    return {"outbound": out, "inbound": back, "undirected": out.unionByName(back)}[direction]


#: Nodes of a frontier up to which it is sent to the edges; a larger one meets them in a shuffle.
FRONTIER = 100_000


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FRONTIER else ids


def traverse(graph: Graph, request: Traversal, schema: GraphSchema | None = None) -> Graph:
    """Nodes and edges within ``depth`` steps of the seeds.

    The edge filter decides which edges are walked. The node filter only decides which nodes come out: paths
    lead through filtered nodes. The page applies to nodes in insertion order, and edges come out if both ends do.
    Each level picks the frontier's edges first and makes only their ends distinct; the frontier is written to the
    shared folder to cut lineage. Nodes and edges are checked again on their way out: an edge that was walked to a
    node that isn't there, or attributes that the schema doesn't declare, fail the traversal.
    """
    told = schema is not None
    schema = schema or GraphSchema(empty_schema(), empty_schema())
    node_tree, edge_tree = bind(request.node_filter, schema.nodes), bind(request.edge_filter, schema.edges)
    edges = graph.edges if is_empty(edge_tree) else graph.edges.filter(compiled(edge_tree, schema.edges.root))
    steps = _steps(edges, request.direction)
    seeds = local_rows(graph.nodes.sparkSession, id=list(dict.fromkeys(request.seeds)))
    frontier = seen = walked = stored(graph.nodes.select("id").join(seeds, "id", "left_semi").distinct())
    for level in range(request.depth):
        out = steps.join(_sent(frontier.withColumnRenamed("id", "at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = stored(out.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
        if level + 1 == request.depth or frontier.isEmpty():
            break
        walked = walked.unionByName(frontier)
    lost = seen.join(graph.nodes.select("id"), "id", "left_anti").limit(5).collect()
    if lost:
        raise InvalidGraph("edges to missing nodes: " + ", ".join(str(r["id"]) for r in lost))
    nodes = valid_nodes(conformed(graph.nodes, schema.nodes) if told else graph.nodes).join(seen, "id", "left_semi")
    if not is_empty(node_tree):
        nodes = nodes.filter(compiled(node_tree, schema.nodes.root))
    if request.page is not None:
        nodes = nodes.orderBy("_ord", "id").offset(request.page.offset).limit(request.page.limit)
    kept = nodes.select("id")
    ends = {"outbound": ("source_id",), "inbound": ("target_id",), "undirected": ("source_id", "target_id")}[request.direction]
    used = None
    for end in ends:
        part = edges.join(walked.withColumnRenamed("id", end), end, "left_semi")
        used = part if used is None else used.unionByName(part.select(*used.columns)).dropDuplicates(["id"])
    for end in ("source_id", "target_id"):
        used = used.join(kept.withColumnRenamed("id", end), end, "left_semi")
    used = valid_edges(used.select(*graph.edges.columns))
    return Graph(nodes, conformed(used, schema.edges) if told else used)


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by id: new ones replace old ones in their place, others follow."""
    last = old.agg(F.max("_ord")).first()[0]
    base = -1 if last is None else last
    places = old.select("id", F.col("_ord").alias("_old"))
    placed = new.join(places, "id", "left").withColumn("_ord", F.coalesce("_old", F.col("_ord") + F.lit(base + 1))).drop("_old")
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(placed.select(*old.columns))


def normalised(snapshot: Graph, schema: GraphSchema) -> Graph:
    """The snapshot with its attributes in the declared kinds; undeclared ones and other kinds fail the query."""
    return Graph(conformed(snapshot.nodes, schema.nodes), conformed(snapshot.edges, schema.edges))


def upsert(graph: Graph, snapshot: Graph, schema: GraphSchema | None = None) -> Graph:
    """The graph after a snapshot, whose edges must have their ends in the snapshot itself."""
    new = checked(snapshot if schema is None else normalised(snapshot, schema))
    return Graph(_replaced(graph.nodes, new.nodes), _replaced(graph.edges, new.edges))


def ingest(docs: DataFrame, split: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], Graph], graph: Graph | None = None) -> tuple[DataFrame, Graph]:
    """Documents to chunks to a snapshot to the graph; nothing is merged from an invalid snapshot."""
    chunks = split(docs)
    snapshot = checked(extract(chunks))
    return chunks, snapshot if graph is None else upsert(graph, snapshot)


def sequence_graph(chunks: DataFrame) -> Graph:
    """A graph that needs no model: each document and chunk a node, PART_OF from chunk to document."""
    own = chunks.select("id", F.array(F.lit("Chunk")).alias("labels"), "content", F.struct(F.col("attributes.tenant").alias("tenant")).alias("attributes"), F.xxhash64("id").alias("_ord"))
    docs = chunks.groupBy(F.col("source_id").alias("id")).agg(F.max("attributes.tenant").alias("t")).select("id", F.array(F.lit("Document")).alias("labels"), F.lit("").alias("content"), F.struct(F.col("t").alias("tenant")).alias("attributes"), F.xxhash64("id").alias("_ord"))
    edges = chunks.select(F.concat_ws("→", "id", "source_id").alias("id"), F.col("id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("PART_OF").alias("type"), F.struct(F.col("index").cast("long").alias("index")).alias("attributes"), F.xxhash64("id").alias("_ord"))
    return Graph(own.unionByName(docs), edges)


def guarded_edges(graph: Graph) -> Graph:
    """The graph whose edges fail the query where an end is missing, without an action of its own."""
    ids = graph.nodes.select(F.col("id")).distinct()
    edges = graph.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    both = guarded(edges, (F.col("_source_id") & F.col("_target_id"), "InvalidGraph: dangling edge"))
    return Graph(graph.nodes, both.select(*graph.edges.columns))
