"""Explicit schemas, as DDL text, of the records that cross a storage boundary."""

from __future__ import annotations

ISSUE = "struct<message:string,path:string>"
LABEL_COMMIT = f"struct<subject:string,files:array<string>,body:string,issues:array<{ISSUE}>>"
PLAN_COMMIT = (
    f"struct<subject:string,hunks:array<string>,body:string,breaking_change:string,issues:array<{ISSUE}>>"
)
MESSAGE = "struct<role:string,content:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
LABEL = f"struct<commits:array<{LABEL_COMMIT}>,gitignore:array<string>,model:string,usage:{USAGE}>"

EXAMPLE = (
    "repo_url string, branch string, base_commit string, head_commit string, n_commits int, diff string, "
    "changed_files array<string>, original_commits array<struct<sha:string,subject:string,files:array<string>>>, "
    "existing_gitignore array<string>, languages array<string>"
)

LABELLED = f"{EXAMPLE}, noise_injected boolean, injected_files array<string>, label {LABEL}"
SFT = f"messages array<{MESSAGE}>"
EVAL_RESULT = (
    "repo_url string, languages array<string>, noise_injected boolean, parsed boolean, file_grouping_f1 double, "
    "type_accuracy double, junk_routing double"
)
HUNK = "hunk_id string, file_path string, patch string, is_untracked boolean, is_binary boolean"
PLAN = f"commits array<{PLAN_COMMIT}>, gitignore array<string>, hunk_patches map<string,string>"
STORED_MESSAGE = (
    "conv_id bigint, msg_id string, role string, content string, turn bigint, parent_id string, kind string"
)
