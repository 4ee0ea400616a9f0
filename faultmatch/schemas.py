"""Table schemas, as DDL."""

TABLES = {
    "kb": """kb_id string, error_hash string, error_signature string, error_text string,
        resolution_steps array<string>, embedding array<float>, confidence_score double,
        solution_source string, created_at timestamp, updated_at timestamp, source string, notes string""",
    "feedback": """feedback_id string, session_id string, solution_hash string, solution_source string,
        solution_version string, was_helpful boolean, confidence_rating double, user_comment string,
        user_expertise string, created_at timestamp, error_signature string,
        resolution_time_minutes int, environment_context string""",
    "kb_versions": """version_id string, kb_entry_id string, error_hash string, resolution_steps array<string>,
        created_at timestamp, created_by string, change_type string, parent_version string,
        confidence_score double, feedback_count int, is_active boolean""",
    "patterns": """pattern_id string, pattern_regex string, priority int, resolution_steps array<string>,
        created_at timestamp, description string, effectiveness_score double, usage_count int,
        last_successful_match timestamp""",
    "vector_index": """index_id string, error_hash string, vector array<float>, lsh_hash_0 string,
        lsh_hash_1 string, lsh_hash_2 string, created_at timestamp""",
    "vector_cache": """cache_key string, query_hash string, results array<struct<error_hash string, similarity double>>,
        created_at timestamp, hit_count int, last_accessed timestamp""",
    "security_log": """event_id string, created_at timestamp, event_type string, user_id string,
        session_id string, details string, severity string""",
    "tree_paths": """path_id string, session_id string, error_hash string,
        path array<struct<node_id string, decision boolean>>, was_successful boolean,
        duration_seconds int, nodes_visited int, created_at timestamp, created_by string""",
}
