"""Graph documents (JSON) to one row per document.

A document is one row, so its nodes and edges are handled by array functions inside that row:
no explode, no shuffle. The table form of the edge clean-up is for edges stored as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.values import let
from phasegrid.operators.columns import split_names

# Node types a complete document has.
REQUIRED_TYPES = ("dataset", "encoder", "circuit", "optimizer")
#: Keys over which the edges of one node are dealt.
EDGE_SALTS = 8

DOCUMENT_SCHEMA = """
    version string,
    nodes array<struct<id: bigint, type: string, name: string, params: map<string, string>>>,
    edges array<struct<source: bigint, target: bigint>>,
    drawflow struct<Home: map<string, struct<name: string, data: struct<type: string, params: map<string, string>>>>>
"""

NODES = "array<struct<id: bigint, type: string, params: map<string, string>>>"
EDGES = "array<struct<source: bigint, target: bigint>>"


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """Add ``nodes`` (type, params), ``edges`` and ``is_broken`` from the JSON text column.

    Both shapes are read: a node list, and a map of nodes keyed by id whose type may be left to
    the node's name.
    """
    doc = df.withColumn("__doc", F.from_json(text, DOCUMENT_SCHEMA))
    listed = F.transform(
        F.col("__doc.nodes"),
        lambda n: F.struct(n["id"].alias("id"), n["type"].alias("type"), n["params"].alias("params")),
    )

    def from_map(entry: Column) -> Column:
        node = entry["value"]
        name = F.lower(F.coalesce(node["name"], F.lit("")))
        kind = F.coalesce(node["data"]["type"], name)
        for part in ("encoder", "circuit"):
            kind = F.when(name.contains(part), F.lit(part)).otherwise(kind)
        return F.struct(
            entry["key"].try_cast("bigint").alias("id"), kind.alias("type"), node["data"]["params"].alias("params")
        )

    keyed = F.transform(F.map_entries(F.col("__doc.drawflow.Home")), from_map)
    return doc.withColumns({
        "nodes": F.coalesce(listed, keyed, F.array().cast(NODES)),
        "edges": F.coalesce(F.col("__doc.edges"), F.array().cast(EDGES)),
        "is_broken": F.col("__doc").isNull() | (F.col("__doc.nodes").isNull() & F.col("__doc.drawflow").isNull()),
    }).drop("__doc")


def _last_params(kind: str) -> Column:
    """Parameters of the last node of a type: later nodes win."""
    return F.try_element_at(F.filter("nodes", lambda n: n["type"] == kind), F.lit(-1))["params"]


def _param(kind: str, key: str) -> Column:
    return F.nullif(F.col(f"__{kind}")[key], F.lit(""))


def flatten_documents(parsed: DataFrame) -> DataFrame:
    """Add the settings of each document, with the defaults where a node or parameter is missing."""
    number = lambda kind, key, default: F.coalesce(_param(kind, key).try_cast("int"), F.lit(default))
    last = parsed.withColumns({f"__{kind}": _last_params(kind) for kind in REQUIRED_TYPES})
    names = split_names(F.coalesce(_param("dataset", "features"), F.lit("")))
    return last.withColumn("feature_columns", names).withColumns({
        "dataset_path": _param("dataset", "path"),
        "label_column": F.coalesce(_param("dataset", "label"), F.lit("")),
        "encoder": F.coalesce(_param("encoder", "type"), F.lit("angle")),
        "circuit": F.coalesce(_param("circuit", "type"), F.lit("realamplitudes")),
        # one qubit per feature; a document without features keeps its own number
        "num_qubits": F.when(F.size("feature_columns") > 0, F.size("feature_columns")).otherwise(
            F.greatest(number("circuit", "num_qubits", 0), F.lit(1))
        ),
        "reps": number("circuit", "reps", 2),
        "optimizer": F.coalesce(_param("optimizer", "type"), F.lit("cobyla")),
        "maxiter": number("optimizer", "maxiter", 20),
        "ansatz": F.coalesce(_param("circuit", "ansatz"), F.lit("ry")),
        "entanglement": F.coalesce(_param("circuit", "entanglement"), F.lit("linear")),
        "layers": number("circuit", "layers", 2),
    }).drop(*[f"__{kind}" for kind in REQUIRED_TYPES])


def missing_types() -> Column:
    """Required node types a parsed document lacks, in the fixed order."""
    return F.array_except(F.array(*[F.lit(t) for t in REQUIRED_TYPES]), F.transform("nodes", lambda n: n["type"]))


def clean_edge_array() -> Column:
    """Distinct edges of a parsed document whose two ends exist."""
    return let(
        F.transform("nodes", lambda n: n["id"]),
        lambda ids: F.filter(
            F.array_distinct("edges"),
            lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]),
        ),
    )


def clean_edges(edges: DataFrame, nodes: DataFrame, document: str = "doc_id") -> DataFrame:
    """Distinct edges (document, source, target) with both ends among the nodes (document, id).

    Each edge stands once for each end in a single semi join, and a grouping by edge keeps those whose two ends were
    found, which also drops duplicates. A node may be an end of very many edges, and a document may hold very many: an
    end's rows are dealt over EDGE_SALTS keys by the edge's other end, and the nodes, two narrow columns, are repeated
    for each.
    """
    ends = nodes.select(document, "id").where("id IS NOT NULL").distinct()
    ends = ends.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(EDGE_SALTS - 1))))
    sides = F.array(
        F.struct(F.col("source").alias("__end"), F.col("target").alias("__other"), F.lit(1).alias("__side")),
        F.struct(F.col("target").alias("__end"), F.col("source").alias("__other"), F.lit(2).alias("__side")),
    )
    both = edges.select(document, "source", "target", F.inline(sides))
    both = both.withColumn("__salt", F.pmod(F.xxhash64("__other"), F.lit(EDGE_SALTS)).cast("int"))
    # the repeated nodes grow with the input: never broadcast
    found = both.join(ends.withColumnRenamed("id", "__end").hint("merge"), [document, "__end", "__salt"], "left_semi")
    return found.groupBy(document, "source", "target").agg(F.bit_or("__side").alias("__sides")).where("__sides = 3").drop("__sides")


def drop_node(edges: DataFrame, node_id: int) -> DataFrame:
    """Edges left after a node is deleted."""
    return edges.where((F.col("source") != node_id) & (F.col("target") != node_id))
