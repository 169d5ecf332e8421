"""The relations' schemas."""

FILES = "id long, path string, language string, size long, line_count long, is_test boolean, mtime long, indexed_at timestamp"
SYMBOLS = "id long, file_id long, name string, kind string, line_start long, line_end long, parent_symbol_id long, signature string"
IMPORTS = "id long, file_id long, module string, names string"
CALLS = "id long, caller_symbol_id long, callee_name string, line long"
EDGES = "id long, kind string, source_file_id long, source_symbol_id long, target_file_id long, target_symbol_id long, target_name string"
METADATA = "key string, value string"
RELATIONS = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS, "edges": EDGES, "metadata": METADATA}

PARSED = (
    "symbols array<struct<name:string,kind:string,line_start:long,line_end:long,parent:int,signature:string>>, "
    "imports array<struct<module:string,names:string>>, "
    "calls array<struct<caller:int,callee:string,line:long>>"
)
