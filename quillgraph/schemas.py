"""Schemas of the data model."""

from __future__ import annotations

PROVENANCE = "struct<chunk_id:int,start_index:int,end_index:int,source_text:string>"
DOCUMENTS = "document_id bigint, user_id bigint, name string, status string, llm_used string, progress int, nodes int, edges int, relations int, estimated_tokens int, processing_time double, error_message string, created_at timestamp"
LOGS = "document_id bigint, stage string, message string, created_at timestamp"
SESSIONS = "session_id bigint, document_id bigint, user_id bigint, title string, created_at timestamp, updated_at timestamp"
MESSAGES = "session_id bigint, role string, content string, query string, query_rows string, provenance string, highlight string, question_analysis string, created_at timestamp"
CHUNKS = "document_id bigint, chunk_id int, text string, start_index int, end_index int, analysis_text string, source_chunk_ids array<int>"
ENTITIES = "document_id bigint, ord bigint, label string, name string, chunk_id int, start_index int, end_index int"
RELATIONS = "document_id bigint, ord bigint, source string, source_label string, target string, target_label string, type string, chunk_id int, start_index int, end_index int"
NODES = f"id string, name string, original_name string, aliases array<string>, label string, label_counts map<string,int>, document_id bigint, ord bigint, chunk_id int, start_index int, end_index int, provenance {PROVENANCE}"
EDGES = f"id string, source string, target string, source_name string, target_name string, source_label string, target_label string, type string, document_id bigint, ord bigint, chunk_id int, start_index int, end_index int, provenance {PROVENANCE}"

STATUSES = ("pending", "processing", "complete", "error")
LLMS = ("llama3", "mistral", "gpt4")
LABELS = ("Person", "Organization", "Location", "Concept")
