"""Schemas of the relations and the enumerations whose order matters."""

from __future__ import annotations

FILES = "path string, language string, is_config boolean, text string, size_bytes long, skipped boolean, skip_reason string, skip_detail string"
DEFINITIONS = "qualified_name string, name string, kind string, file string, start_line int, end_line int, name_line int, name_col int, ord int"
CALLS = "caller string, callee_expr string, line int, arg_text string, file string, callee_line int, callee_col int, ord int"
IMPORTS = "file string, raw string, line int, ord int"
ASSIGNMENTS = "file string, name string, line int, value string, host string, ord int"
CONFIG_VALUES = "path string, key_path string, value string, line int, ord int"
SPANS = "symbol string, display_name string, kind string, file string, name_line int, name_col int, start_line int, end_line int, has_enclosing_range boolean, is_local boolean"
GAPS = "stage string, scope string, kind string, path string, detail string, impact string, count long, samples array<string>"
PATTERN_MATCHES = "file string, line int, label string"
FLOW = "kind string, source struct<code:string,file:string,line:int,method:string>, steps array<struct<code:string,file:string,line:int,method:string>>, conditions array<struct<code:string,file:string,line:int,method:string>>"
FLOW_RESULTS = f"file string, line int, found_call boolean, found_argument boolean, flows array<struct<{FLOW.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>"

#: Statuses of a call, tiers in the order in which they win, shapes in the order in which they are tried.
STATUS = ("internal", "internal_unmapped", "external_candidate", "unresolved")
RESOLVED_VIA = ("scip", "lexical_fallback", "tail_name")
LITERAL_METHODS = ("literal", "const_prop", "joern", "llm_inferred")
MATCH_TIERS = (("host_value", "high"), ("service_dns", "high"), ("service_name", "medium"), ("text", "low"))
SHAPES = ("empty", "opaque_placeholder", "string_literal", "bare_identifier", "self_attribute", "dotted_name", "concatenation", "fstring", "template_literal", "call_expression", "other_expression")
COVERAGE = ("scip", "treesitter_only", "fallback_lines", "skipped", "unparsed")
SKIP_REASONS = ("too_large", "minified", "stat_error", "read_error", "parse_exception")
CHUNK_KINDS = ("function", "method", "class", "file_header", "file", "config")
