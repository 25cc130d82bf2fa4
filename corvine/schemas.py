"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in ddl.split())])


SCHEMAS = {
    "repos": _struct("id:string github_url:string name:string default_branch:string status:string last_indexed_at:timestamp onboarding_guide:string onboarding_guide_generated_at:timestamp created_at:timestamp updated_at:timestamp"),
    "index_jobs": _struct("id:string repo_id:string status:string progress:int error:string started_at:timestamp finished_at:timestamp created_at:timestamp"),
    "files": _struct("id:string repo_id:string path:string language:string content_hash:string size_bytes:bigint created_at:timestamp"),
    "chunks": _struct("id:string file_id:string symbol_name:string symbol_type:string start_line:int end_line:int content:string embedding:array<float> created_at:timestamp"),
    "file_edges": _struct("id:string source_file_id:string target_file_id:string edge_type:string"),
    "conversations": _struct("id:string repo_id:string title:string created_at:timestamp updated_at:timestamp"),
    "messages": _struct("id:string conversation_id:string role:string content:string parts:string created_at:timestamp"),
}
