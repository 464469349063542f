"""Record types of the pipeline's stages; readers use them instead of inference."""

_PROVISION = (
    "act_id STRING, title STRING, chapter STRING, section_number STRING, section_title STRING, state STRING, year INT, amendment_count INT, "
    "act_status STRING, section_status STRING, source_url STRING, source_publisher STRING, source_snapshot STRING, source_dataset STRING, text STRING"
)
_QA = "question STRING, answer STRING, section STRING, act_id STRING, source_id STRING, question_type STRING"
_SEQUENCE = "input_ids ARRAY<INT>, labels ARRAY<INT>, attention_mask ARRAY<INT>"

#: Name of a record type -> its schema as DDL, which every reader takes.
RECORDS: dict[str, str] = {
    "raw_provisions": _PROVISION,
    "clean_provisions": f"{_PROVISION}, text_sha256 STRING",
    "tokenized": "act_id STRING, section_number STRING, jurisdiction STRING, tokens ARRAY<INT>",
    "lm_blocks": "split STRING, block BIGINT, input_ids ARRAY<INT>, targets ARRAY<INT>",
    "pdf_pages": "source_file STRING, page_number INT, text STRING, character_count INT",
    "chunks": "chunk_id STRING, source_file STRING, page_number INT, section_number STRING, section_title STRING, text STRING, character_count INT",
    "grounded_answer": "question STRING, answer STRING, sources ARRAY<STRUCT<section: STRING, title: STRING, page: INT, score: DOUBLE, text: STRING>>, "
                       "grounded BOOLEAN, retrieved_count INT, unique_source_count INT",
    "qa_v1": "question STRING, context STRING, answer STRING, section STRING, act_id STRING, source_id STRING, question_type STRING",
    "qa_tokenized": f"{_SEQUENCE}, {_QA}, original_context_tokens INT, original_answer_tokens INT, prepared_context_tokens INT, "
                    "prepared_sequence_tokens INT, answer_tokens_used INT",
    "qa_chunked": f"{_SEQUENCE}, {_QA}, chunk_index INT, chunk_count INT, answer_tokens INT",
    "qa_v2": f"{_SEQUENCE}, {_QA}, chunk_index INT, chunk_count INT, answer_tokens INT, prompt_length INT, answer_truncation STRING, "
             "answer_cleanup STRING, prompt_template STRING",
    "history": "epoch INT, step BIGINT, train_loss DOUBLE, validation_loss DOUBLE, learning_rate DOUBLE, train_perplexity DOUBLE, "
               "validation_perplexity DOUBLE, epoch_checkpoint STRING, best_checkpoint STRING",
    "retrieval_cases": "query STRING, expected_sections ARRAY<STRING>",
    "checkpoint_meta": "checkpoint_version INT, epoch INT, next_batch_in_epoch BIGINT, epoch_order ARRAY<BIGINT>, global_step BIGINT, running_loss DOUBLE, "
                       "batches_seen BIGINT, best_validation_loss DOUBLE, model_config MAP<STRING, STRING>, training MAP<STRING, STRING>",
}
