"""The relations of a review."""

TARGET = "path string, status string, diff_text string, changed_lines array<int>, old_path string, target_ord bigint"
FINDING = (
    "check_id string, tier string, source string, severity string, title string, explanation string, file string,"
    " line_start int, line_end int, suggestion string, raw string, also_flagged_by array<string>"
)
FINDING_COLUMNS = [x.strip().split(" ")[0] for x in FINDING.split(",")]
REPORT = (
    "repo_path string, mode string, base_ref string, head_ref string, generated_at string, tiers_run array<string>, findings array<variant>,"
    " files_reviewed array<string>, duration_seconds double, skipped array<string>, file_hashes map<string, string>"
)
