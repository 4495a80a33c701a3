"""Table schemas, as Spark DDL."""

from __future__ import annotations

PAGE = "number int, content string, char_count int, word_count int"
METADATA = (
    "title string, author string, subject string, keywords array<string>, language string, "
    "page_count int, word_count int, char_count int, creation_date timestamp, "
    "modification_date timestamp, extra map<string,string>"
)
DOCUMENT = "doc_id string, version_id string, text string, clean_text string"
CHUNK = (
    "chunk_id string, doc_id string, chunk_index int, text string, start_offset int, end_offset int, "
    "token_count int, page_number int, section string, heading string, strategy string"
)
INDEX = (
    "collection string, chunk_id string, embedding array<float>, text string, dimensions int, "
    "report_id string, version_id string, embedding_model string, embedding_provider string, "
    "extra map<string,string>"
)
HITS = "query_id string, chunk_id string, score double, rank int"
CONTEXT = (
    "query_id string, chunk_id string, content string, score double, source_id string, "
    "source_title string, source_version string, page_number int, section_name string, "
    "token_count int, citations array<string>, metadata map<string,string>"
)
SESSION = (
    "session_id string, user_id string, title string, mode string, report_ids array<string>, "
    "summary string, archived boolean, created_at timestamp, updated_at timestamp"
)
MESSAGE = "message_id string, session_id string, role string, content string, created_at timestamp"
TRACE = (
    "request_id string, user_id string, prompt_version string, model string, provider string, "
    "cache_hit boolean, stages map<string,double>, counts map<string,bigint>, created_at timestamp"
)
EVAL_SET = (
    "document string, document_path string, topic string, queries array<struct<id:string,"
    "query:string,expected_topics:array<string>,expected_grounded:boolean>>"
)
EVAL_RUN = (
    "run_id string, created_at timestamp, judge_model string, llm_model string, embedding_model string, "
    "retrieval_top_k int, mmr_lambda double, prompt_version string, overall double, "
    "metrics map<string,double>"
)
