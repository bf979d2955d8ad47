"""Graph documents and run specs, one document per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.operators import documents as D
from phasegrid.operators.specs import broken_rules
from phasegrid.queries.registry import query
from phasegrid.sources.tables import table

# The document text of an event, in SQL that both engines read; k is the number in the event's props.
_TEXT = """
CASE WHEN event_type = 'error' THEN concat(
  '{"drawflow":{"Home":{"1":{"name":"Encoder","data":{"type":"encoder","params":{"type":"', CASE WHEN k % 2 = 0 THEN 'basis' ELSE 'iqp' END,
  '"}}},"2":{"name":"My Circuit","data":{"params":{"ansatz":"rz","layers":"', k % 3, '"}}}}}}')
ELSE concat('{"version":"0.1","nodes":[', concat_ws(',',
  CASE WHEN k % 7 <> 0 THEN concat('{"id":1,"type":"dataset","name":"Dataset","params":{"path":"', CASE WHEN k % 6 = 0 THEN '' ELSE concat('data/', event_type, '.csv') END,
    '","label":"', CASE WHEN k % 3 = 0 THEN '' ELSE 'risk_flag' END, '","features":"', CASE WHEN k % 5 = 0 THEN '' ELSE 'value, hour,, weekday ' END, '"}}') END,
  CASE WHEN k % 4 <> 1 THEN concat('{"id":2,"type":"encoder","name":"Encoder","params":{"type":"', CASE WHEN k % 13 = 0 THEN 'fourier' WHEN k % 3 = 1 THEN 'basis' ELSE 'angle' END, '"}}') END,
  CASE WHEN k % 2 = 0 THEN '{"id":6,"type":"encoder","name":"Encoder","params":{"type":"iqp"}}' END,
  CASE WHEN k % 5 <> 2 THEN concat('{"id":3,"type":"circuit","name":"Circuit","params":{"type":"ry","num_qubits":"', k % 4, '","reps":"', 1 + k % 3,
    '","ansatz":"', CASE WHEN k % 11 = 0 THEN 'star' ELSE 'rx' END, '","layers":"', k % 3, '"}}') END,
  CASE WHEN k % 3 <> 1 THEN concat('{"id":4,"type":"optimizer","name":"Optimizer","params":{"type":"spsa","maxiter":"', 10 + k % 20, '"}}') END,
  '{"id":5,"type":"output","name":"Output","params":{"predictions":"true"}}'),
  '],"edges":[{"source":1,"target":2},{"source":2,"target":3},{"source":1,"target":2},{"source":3,"target":4},{"source":4,"target":9}]}')
END"""

_SQL_DOCS = f"""
WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
docs AS (SELECT event_id, {_TEXT} AS doc FROM k),
listed AS (
  SELECT event_id, unnest(json_extract(doc, '$.nodes[*]')) AS node, generate_subscripts(json_extract(doc, '$.nodes[*]'), 1) AS pos FROM docs),
keyed AS (
  SELECT event_id, unnest(json_extract(doc, '$.drawflow.Home.*')) AS node, generate_subscripts(json_extract(doc, '$.drawflow.Home.*'), 1) AS pos FROM docs),
nodes AS (
  SELECT event_id, pos, CAST(json_extract(node, '$.id') AS BIGINT) AS id, node->>'$.type' AS kind, json_extract(node, '$.params') AS params FROM listed
  UNION ALL
  SELECT event_id, pos, pos, CASE WHEN lower(node->>'$.name') LIKE '%encoder%' THEN 'encoder' WHEN lower(node->>'$.name') LIKE '%circuit%' THEN 'circuit'
         ELSE coalesce(node->>'$.data.type', lower(node->>'$.name')) END, json_extract(node, '$.data.params') FROM keyed),
ends AS (
  SELECT event_id, arg_max(params, pos) FILTER (WHERE kind = 'dataset') AS ds, arg_max(params, pos) FILTER (WHERE kind = 'encoder') AS en,
         arg_max(params, pos) FILTER (WHERE kind = 'circuit') AS ci, arg_max(params, pos) FILTER (WHERE kind = 'optimizer') AS op
  FROM nodes GROUP BY event_id),
flat AS (
  SELECT event_id, nullif(ds->>'$.path', '') AS dataset_path, coalesce(ds->>'$.label', '') AS label_column,
         list_filter(list_transform(string_split(coalesce(ds->>'$.features', ''), ','), lambda s: trim(s)), lambda s: s <> '') AS features,
         coalesce(nullif(en->>'$.type', ''), 'angle') AS encoder, coalesce(nullif(ci->>'$.type', ''), 'realamplitudes') AS circuit,
         coalesce(TRY_CAST(ci->>'$.num_qubits' AS INTEGER), 0) AS raw_qubits, coalesce(TRY_CAST(ci->>'$.reps' AS INTEGER), 2) AS reps,
         coalesce(nullif(op->>'$.type', ''), 'cobyla') AS optimizer, coalesce(TRY_CAST(op->>'$.maxiter' AS INTEGER), 20) AS maxiter,
         coalesce(ci->>'$.ansatz', 'ry') AS ansatz, coalesce(ci->>'$.entanglement', 'linear') AS entanglement,
         coalesce(TRY_CAST(ci->>'$.layers' AS INTEGER), 2) AS layers
  FROM ends),
settings AS (
  SELECT *, CAST(CASE WHEN len(features) > 0 THEN len(features) ELSE greatest(raw_qubits, 1) END AS INTEGER) AS num_qubits FROM flat)"""


def parsed(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    docs = table(spark, folder, "events").withColumn("k", k).select("event_id", F.expr(_TEXT).alias("doc"))
    return D.parse_documents(docs, "doc").drop("doc")


@query("spec_flatten", _SQL_DOCS + """
SELECT event_id, dataset_path, label_column, array_to_string(features, ',') AS feature_columns, encoder, circuit, num_qubits, reps,
       optimizer, maxiter, ansatz, entanglement, layers FROM settings""")
def spec_flatten(spark, folder):
    flat = D.flatten_documents(parsed(spark, folder))
    return flat.select(
        "event_id", "dataset_path", "label_column", F.array_join("feature_columns", ",").alias("feature_columns"), "encoder",
        "circuit", "num_qubits", "reps", "optimizer", "maxiter", "ansatz", "entanglement", "layers",
    )


@query("spec_rules", _SQL_DOCS + """
SELECT event_id, concat_ws(',', CASE WHEN dataset_path IS NULL THEN 'no_path' END, CASE WHEN label_column = '' THEN 'no_label' END,
  CASE WHEN len(features) = 0 THEN 'no_features' END, CASE WHEN layers < 1 THEN 'no_layers' END,
  CASE WHEN ansatz NOT IN ('ry', 'rz', 'rx', 'rxyz') THEN 'unknown_ansatz' END,
  CASE WHEN encoder = 'fourier' THEN 'unknown_encoder' END) AS broken FROM settings""")
def spec_rules(spark, folder):
    flat = D.flatten_documents(parsed(spark, folder))
    return flat.select("event_id", F.array_join(broken_rules(), ",").alias("broken"))


@query("graph_missing", _SQL_DOCS + """
SELECT event_id, concat_ws(',', CASE WHEN ds IS NULL THEN 'dataset' END, CASE WHEN en IS NULL THEN 'encoder' END,
  CASE WHEN ci IS NULL THEN 'circuit' END, CASE WHEN op IS NULL THEN 'optimizer' END) AS missing FROM ends""")
def graph_missing(spark, folder):
    return parsed(spark, folder).select("event_id", F.array_join(D.missing_types(), ",").alias("missing"))


_SQL_EDGES = _SQL_DOCS + """,
edges AS (
  SELECT DISTINCT event_id, CAST(json_extract(e, '$.source') AS BIGINT) AS source, CAST(json_extract(e, '$.target') AS BIGINT) AS target
  FROM (SELECT event_id, unnest(json_extract(doc, '$.edges[*]')) AS e FROM docs)),
kept AS (
  SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.event_id = e.event_id AND n.id = e.source)
                          AND EXISTS (SELECT 1 FROM nodes n WHERE n.event_id = e.event_id AND n.id = e.target))
"""


@query("edge_clean", _SQL_EDGES + "SELECT event_id, source, target FROM kept")
def edge_clean(spark, folder):
    return parsed(spark, folder).select("event_id", F.inline(D.clean_edge_array()))


@query("edge_clean_rows", _SQL_EDGES + "SELECT event_id, source, target FROM kept")
def edge_clean_rows(spark, folder):
    """The same clean-up for edges and nodes stored as rows."""
    docs = parsed(spark, folder)
    edges = docs.select("event_id", F.inline("edges"))
    nodes = docs.select("event_id", F.inline(F.transform("nodes", lambda n: F.struct(n["id"].alias("id")))))
    return D.clean_edges(edges, nodes, "event_id")


@query("edge_without_node", _SQL_EDGES + "SELECT event_id, source, target FROM kept WHERE source <> 2 AND target <> 2")
def edge_without_node(spark, folder):
    edges = parsed(spark, folder).select("event_id", F.inline(D.clean_edge_array()))
    return D.drop_node(edges, 2)
