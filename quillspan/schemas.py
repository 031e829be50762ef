"""Schemas of the engine's tables, declared once (Spark DDL)."""

NOTES = "corpus_id string, note_id string, text string, source string, created_at timestamp, seq bigint"
SPAN = "struct<start:int,end:int>"
CHUNKS = f"note_id string, chunk_id string, ord int, text string, token_count int, span {SPAN}, truncated boolean"
VECTORS = "corpus_id string, chunk_id string, note_id string, model_id string, embedding array<float>"
CENTROIDS = "corpus_id string, note_id string, model_id string, embedding array<double>"
NOTE_EVENTS = "corpus_id string, event_time timestamp, op string, note_id string, text string, source string"
ADMISSIONS = "status string, reason string"
EVAL_REPORT = "id string, status string, detail string"
LANGUAGES = "model struct<id:string,baseModel:string>, tunedLanguages array<struct<bcp47:string,name:string>>, specialCases array<struct<bcp47:string,name:string,note:string>>"
SAMPLE_CORPUS = "notes array<struct<id:string,topic:string,text:string>>"
