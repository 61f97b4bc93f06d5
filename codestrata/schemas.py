"""Static schemas of the model's tables. Ids are deterministic string keys; '' in param_types (no argument) differs from NULL."""

from pyspark.sql import types as T


def _s(text: str) -> T.StructType:
    kinds = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(","))])


REPOS = _s("id STRING, root_path STRING, created_at BIGINT, last_indexed_at BIGINT")
FILES = _s("id STRING, repo_id STRING, path STRING, mtime BIGINT, sha STRING, size BIGINT, lang STRING, indexed_at BIGINT")
SYMBOLS = _s("id STRING, repo_id STRING, file_id STRING, parent_id STRING, kind STRING, package STRING, simple_name STRING, fqn STRING, signature STRING, return_type STRING, modifiers STRING, framework_role STRING, start_line INT, end_line INT, param_types STRING")
ANNOTATIONS = _s("id STRING, symbol_id STRING, name STRING, fqn STRING, args_json STRING")
IMPORTS = _s("id STRING, file_id STRING, fqn STRING, is_static BOOLEAN, is_wildcard BOOLEAN")
EDGES = _s("id STRING, repo_id STRING, src_symbol_id STRING, dst_symbol_id STRING, dst_fqn STRING, dst_member STRING, kind STRING, file_id STRING, line INT, resolution STRING, param_types STRING")
#: What typing across files needs: types (arity: of type parameters), their supertypes (level: position), methods and fields, expressions with the type
#: or the expression (ref) that they stand behind (level: how far out the type encloses them), and lambda parameters (level: argument, arity: parameter).
#: Types have full names, and #0; for the owner's first type parameter; params are joined by |. was_ columns hold an expression's edge, or any
#: other edge (kind edge), as parsed.
FACTS = _s("repo_id STRING, file_id STRING, kind STRING, id STRING, edge_id STRING, owner STRING, name STRING, level INT, arity INT, many BOOLEAN, static BOOLEAN, type STRING, params STRING, ref STRING, was_fqn STRING, was_kind STRING, was_resolution STRING")
INDEX_STATUS = _s("repo_id STRING, state STRING, phase STRING, files_total INT, files_changed INT, files_done INT, symbols_count BIGINT, edges_count BIGINT, started_at BIGINT, finished_at BIGINT, error STRING")
FAILURE_HISTORY = _s("id STRING, repo_id STRING, signature STRING, exception_fqn STRING, top_class_fqn STRING, top_method STRING, file_path STRING, source STRING, occurred_at BIGINT")
META = _s("key STRING, value STRING")
COMMITS = _s("hash STRING, short_hash STRING, author STRING, email STRING, date STRING, message STRING, path STRING")
DIFFS = _s("change_type STRING, old_path STRING, new_path STRING, added_lines INT, deleted_lines INT, patch STRING")

SYMBOL_KINDS = ("PACKAGE", "CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION_TYPE", "METHOD", "CONSTRUCTOR", "FIELD")
TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION_TYPE")
FLOW_KINDS = ("CALLS", "STATIC_CALL", "NEW")
CLASS_KINDS = (*FLOW_KINDS, "EXTENDS", "IMPLEMENTS")
