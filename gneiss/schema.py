"""Schemas of the index tables, as DDL."""

REPOS = "repo_id long, path string, name string, last_indexed timestamp, created_at timestamp"
CHUNKS = (
    "chunk_id long, repo_id long, file_path string, start_line int, end_line int, code string, language string,"
    " symbols array<struct<name:string,type:string>>, ast_hash string, embedding_id long, created_at timestamp, updated_at timestamp"
)
DOC_STATS = "chunk_id long, language string, doc_len int"
POSTINGS = "term string, chunk_id long, tf int"
TERM_STATS = "term string, df long"
CORPUS_STATS = "doc_count long, term_count long, total_length long, avg_len double"
EMBEDDINGS = "chunk_id long, embedding array<float>, norm double, cell int"
EMB_CACHE = "key string, model string, embedding array<float>, created_at timestamp"
FILE_STATE = "file_path string, file_hash string, seen_at timestamp"
FILE_EVENTS = "event_type string, file_path string, ts timestamp, file_hash string"
SYMBOLS = "array<struct<name:string,type:string,start_line:int,end_line:int,parent:string,signature:string>>"
