"""Schemas of rows and nested values, as DDL."""

CHUNK_META = (
    "content_type string, language string, path string, section string, symbol_name string, parent_symbol string, "
    "line_range struct<start:int,end:int>, author string, thread_id string, timestamp timestamp, extra string")
SOURCE_ITEM = "id string, source_id string, source_kind string, content_type string, content string, metadata string, created_at timestamp"
PIECE = (
    "item_id string, content string, token_count int, start_index bigint, end_index bigint, chunk_index int, "
    "meta_type string, language string, path string, section string, symbol_name string, line_start int, line_end int, author string, thread_id string, ts string, strategy string")
CHUNK = ("id string, source_item_id string, source_id string, source_kind string, content string, token_count int, start_index bigint, "
         f"end_index bigint, chunk_index int, metadata struct<{CHUNK_META.replace(' string', ':string').replace(' struct', ':struct').replace(' timestamp,', ':timestamp,')}>, created_at timestamp")
CHAT_THREAD = "channel string, thread_ts string, messages array<struct<user:string,text:string,ts:string>>"
TICKET = ("key string, title string, description string, status string, priority string, assignee string, reporter string, "
          "comments array<struct<author:string,body:string>>")
ENTITY = "struct<entity_type:string,name:string,start_line:int,end_line:int,content:string>"
EVENT = (f"event_id string, source_id string, file_path string, language string, normalized_content string, entities array<{ENTITY}>, "
         "metadata map<string,string>, timestamp string")
CHUNK_EVENT = ("event_id string, source_id string, file_path string, chunk_id string, chunk_index int, total_chunks int, content string, token_count int, "
               "metadata struct<language:string,entity_type:string,entity_name:string,start_line:int,end_line:int,profile:string>, timestamp string")
NOTIFICATION = "event_type string, source_id string, message string, metadata map<string,string>"
SYMBOL = "name string, symbol_type string, line_start int, line_end int, parent string, documentation string"
IMPORT = "module_path string, symbols array<string>, is_wildcard boolean"
JOB = ("job_id string, status string, total_items int, processed_items int, chunks_created int, error string, started_at timestamp, "
       "completed_at timestamp, created_at timestamp")

# The names that rows may hold.
SOURCE_KINDS = ("code_repo", "document", "chat", "ticketing", "wiki", "email", "web", "other")
JOB_STATES = ("pending", "running", "completed", "failed")
SYMBOL_TYPES = ("function", "method", "class", "struct", "enum", "interface", "trait", "module", "variable", "constant", "type")
ENTITY_TYPES = SYMBOL_TYPES[:-1]
LARGE_FILE_STRATEGIES = ("split_by_symbols", "split_by_tokens", "split_by_lines", "hierarchical")
