"""Schemas of the relational corpus, the logs and the questions. Nothing is inferred."""

LABEL_DOCUMENT = "label_id STRING, concept_name STRING, set_id STRING, document_id_root STRING, document_code STRING, document_code_display_name STRING, document_title STRING, created_at TIMESTAMP"
LABEL_VERSION = "label_version_id STRING, label_id STRING, version_number INT, effective_time STRING, source_xml_path STRING, xml_sha256 STRING, is_locked_version BOOLEAN, created_at TIMESTAMP"
LABEL_PRODUCT = "label_product_id STRING, label_version_id STRING, product_index INT, product_name STRING, product_code STRING, product_code_system STRING, dosage_form_code STRING, dosage_form_display_name STRING, route_names ARRAY<STRING>, active_moieties ARRAY<STRING>, created_at TIMESTAMP"
SECTION = (
    "section_uid STRING, parent_section_uid STRING, order_index INT, depth INT, loinc_code STRING, code_display_name STRING, raw_title STRING, normalized_title STRING, "
    "canonical_section_name STRING, mapping_method STRING, nearest_canonical_section_name STRING, nearest_canonical_source_section_uid STRING, retrieval_family STRING, "
    "retrieval_family_source_section_uid STRING, is_unclassified BOOLEAN, direct_text STRING, direct_text_sha256 STRING, direct_char_count INT, child_count INT, heading_path ARRAY<STRING>"
)
INGREDIENT = "class_code STRING, name STRING, unii_code STRING, strength_numerator_value STRING, strength_numerator_unit STRING, strength_denominator_value STRING, strength_denominator_unit STRING"
PRODUCT = f"product_index INT, product_name STRING, product_code STRING, product_code_system STRING, dosage_form_code STRING, dosage_form_display_name STRING, ingredients ARRAY<STRUCT<{INGREDIENT.replace(' STRING', ': STRING')}>>"
QUESTIONS = "query_id STRING, query STRING, drug STRING, family STRING, top_k INT"
ALIASES = "alias STRING, rxcui STRING, name STRING, synonym STRING, tty STRING"
CONCEPT_RELATIONS = "rxcui STRING, related_rxcui STRING, related_name STRING, related_tty STRING"
SEEDS = "concept_name STRING, query_name STRING, name_type STRING, target_profile STRING, prefer_title_contains ARRAY<STRING>, exclude_title_contains ARRAY<STRING>, set_id STRING, locked_spl_version INT, locked_published_date STRING, locked_title STRING, lock_reason STRING, notes STRING"
HISTORY = "data STRUCT<spl: STRUCT<title: STRING, setid: STRING>, history: ARRAY<STRUCT<spl_version: INT, published_date: STRING>>>"
BUILD_LOG = "build_id STRING, built_at TIMESTAMP, documents BIGINT, versions BIGINT, sections BIGINT, chunks BIGINT, index_points BIGINT"
