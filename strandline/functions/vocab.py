"""The fixed vocabulary of the data model."""

#: Relations that make the target depend on the source (``reads``: the other way round).
DEPENDENCY_RELATIONS = ("produces", "renders", "supports", "cites", "derives_from", "reads", "motivates", "predicts", "tested_by", "concludes")
#: Relations that are recorded and never propagate.
ANNOTATION_RELATIONS = ("supersedes", "superseded_by", "refutes", "retracts", "tried_before", "related", "evidenced_by")
#: Statuses that nothing current may depend on.
RETIRED = ("deprecated", "retracted", "dead_end", "superseded")
#: All statuses.
STATUSES = ("planned", "current", "confirmed", "null", "dead_end", "retracted", "superseded", "stale", "deprecated")
#: Node types that get type checks.
NODE_TYPES = ("question", "hypothesis", "prediction", "data", "artifact", "code", "figure", "claim", "conclusion", "doc", "doc_span", "experiment", "method", "decision", "reference", "concept")
#: Types whose files a render can be older than, unless told otherwise.
INPUT_TYPES = ("data", "artifact", "code")
#: Severities from the gravest on.
SEVERITIES = ("error", "warning", "pending", "info")
