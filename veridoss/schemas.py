"""Declared schemas; nothing is inferred. All names and orders here are fixed values of the data's format."""

from __future__ import annotations

# Columns of the Parquet tables of a sample.
REVIEWS = "review_id string, hotel_id string, review_date string, rating_normalized_5 double, text string"
FEATURES = "source_dataset string, hotel_id string, review_id string, review_date string, rating double, review_text string, text_sha256 string, input_row_position long, minilm_embedding_row long, minilm_verified boolean, absa_aspect string, absa_sentiment string, absa_confidence double, absa_method string, absa_reusable_status string, duplicate_group_id string, cluster_id string"
MAPPING = "sample_row_position long, review_id string, hotel_id string, source_input_row_position long, source_minilm_embedding_row long"
# Nested types of aspect results, model answers and assessments.
ASPECTS = "array<struct<raw_aspect:string,canonical_aspect:string,start:int,end:int,extractor_label:string,aspect_extraction_score:double,sentiment:string,sentiment_source:string,sentiment_score:double,sentiment_scores:map<string,double>>>"
ENTITIES = "array<struct<entity_group:string,word:string,start:int,end:int,score:double>>"
PREDICTIONS = "review_id string, absa_method string, absa_aspect string, absa_sentiment string, absa_confidence double, inference_status string, error_message string, absa_aspect_predictions_json string, absa_canonical_aspect string, extracted_aspect_count long, aspect_score_count long, sentiment_score_count long"
EVIDENCE = "array<struct<summary:string,review_ids:array<string>,recurrence:string>>"
LEDGER = f"hotel_id string, chunk_id string, review_count long, positive_evidence {EVIDENCE}, concern_evidence {EVIDENCE}"
ASSESSMENT = f"hotel_id string, evidence_review_count long, band string, band_label string, band_position string, recurrence_level string, property_relevance_status string, material_evidence_ids array<string>, positive_evidence {EVIDENCE}, concern_evidence {EVIDENCE}"
# Fields of a record and of a document, in the order that the format gives them, and new names of columns.
RECORD = "source_dataset hotel_id review_id review_date rating review_text text_sha256 input_row_position embedding_row embedding_verified absa_aspect absa_sentiment absa_confidence absa_method absa_reusable_status duplicate_group_id semantic_cluster_id".split()
DOCUMENT = "schema_version dataset_namespace hotel_id hotel_metadata temporal_summaries semantic_clusters absa_evidence review_evidence_records provenance methodology_notes warnings".split()
ALIASES = {"minilm_embedding_row": "embedding_row", "minilm_verified": "embedding_verified", "cluster_id": "semantic_cluster_id"}
# Words that no key of a document may be.
FORBIDDEN_KEYS = "score band recommendation safe unsafe severity credibility deterioration recovery confidence_judgment".split()
# Files of a sample's folder.
SAMPLE_FILES = ("reviews.parquet", "features.parquet", "embeddings.npz", "review_hotel_mapping.parquet", "sample_definition.json", "SHA256_MANIFEST.csv", "SOURCE_PROVENANCE.json")
SCHEMA_VERSION = "1.0"
