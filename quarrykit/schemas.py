"""Explicit schemas of the tables and of the payloads read from feeds."""

from __future__ import annotations

ATTACHMENTS = "array<struct<name: string, url: string>>"
NOTICE = (
    "id long, source string, title string, organization string, category string, bid_no string, start_date string, end_date string, "
    "status string, url string, keywords string, collected_at timestamp, content string, target string, region string, budget string, "
    f"contact string, procure_class string, attachments {ATTACHMENTS}"
)
TAG = "notice_id long, tag string, tagged_by long, memo string, created_at timestamp, updated_at timestamp"
KEYWORD = "id long, keyword string, keyword_group string, is_active int, source_id long"
LEDGER = "id long, type string, amount double, description string, notice_id long, model string, tokens_in long, tokens_out long, created_at timestamp"
CLAIM = (
    "claim_id string, source_id long, category string, statement string, tags array<string>, sections array<string>, variants map<string, string>, "
    "recurrence long, confidence double, verified int, merged_from array<string>"
)
HINT = "id long, source_id long, type string, name string, year int, organization string, section string, action string"
FEED_ITEMS = "totalCount long, data array<map<string, string>>"
ANSWER = "struct<claims: array<struct<category: string, statement: string, tags: array<string>, proposal_sections: array<string>, length_variants: map<string, string>, confidence: double>>, quantitative_hints: array<struct<type: string, name: string, year: int, org: string>>>"
