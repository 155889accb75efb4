"""Schemas of the tables the operators pass around."""

from __future__ import annotations

INVENTORY = "key string, name string, size bigint, last_modified timestamp, etag string"

OBJECT_VERSIONS = (
    "key string, version_id string, is_latest boolean, size bigint, last_modified timestamp, etag string"
)

TEMPLATE_META = (
    "id string, name string, description string, placeholders array<string>, "
    "context_questions array<string>, content_outline array<string>, field_config array<struct<id:string,"
    "label:string,question:string,required:boolean,field_type:string,source:string>>, current_version string, "
    "active_version string, versions array<struct<version:string,status:string,changelog:string,"
    "created_at:string,created_by:string,modified_at:string,s3_key:string,previous_version:string>>, "
    "created_by string, tags array<string>, usage_count bigint"
)

FACT = "doc_id bigint, role string, ord bigint, value string, confidence double, evidence string, extractor string"

COLLECTION = (
    "doc_id bigint, role string, ord bigint, items array<map<string,string>>, confidence double, "
    "evidence string, extractor string"
)
