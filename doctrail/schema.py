"""Schemas of the data model, as DDL."""

COMMIT_LOG = "write_seq long, target string, message string, author string, content string, mode string, is_pinned boolean, timestamp string, style_audit string"
COMMITS = (
    "commit_id string, target string, message string, author string, timestamp string, is_pinned boolean, mode string, blob_hash string, "
    "byte_size long, compressed_size long, parent_commit_id string, style_audit string, write_seq long"
)
BLOBS = "blob_hash string, content string, byte_size long"
SECTIONS = "sec_pos int, heading string, level int, title string, norm_title string, lines array<string>"
UNITS = "unit_pos int, unit_type string, text string"
OPCODE = "op string, i1 int, i2 int, j1 int, j2 int, old string, new string"
ALIGNMENT = "ord int, op string, old_pos int, new_pos int"
TAGS = "tag_pos int, raw_tag string, inner_content string, typology string, start int, end int"
ISSUES = "doc_id long, seq long, severity string, rule_id string, level string, type string, line int, term string, suggestion string"
SEGMENTS = "start_line int, end_line int, text string"
PLAN = "frag_pos int, type string, text string, sentences array<string>"
AUDIT_ISSUE = "struct<type:string,line:int,term:string,suggestion:string>"
ITERATION = f"struct<iteration:int,verdict:string,total_issues:int,hard_blockers:int,soft_warnings:int,tier_breakdown:map<string,int>,issues:array<{AUDIT_ISSUE}>>"
AUDITS = f"commit_id string, target string, timestamp string, summary string, is_overleaf boolean, final_verdict string, iterations array<{ITERATION}>"
