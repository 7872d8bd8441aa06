"""Explicit schemas of every source; nothing is inferred."""

from __future__ import annotations

MANIFEST = "name string, law_id string, mst string, status string, promulgated string, effective string, promulgation_no string, path string, sha256 string"
PARAGRAPH = "struct<no: string, text: string, items: array<string>>"
ARTICLE = f"law string, law_id string, level string, version_effective string, article_key string, title string, chapter string, effective string, paragraphs array<{PARAGRAPH}>, amended array<string>"
CASE = "id string, case_no string, decided string, title string, ref_articles string, issues string, holding string, holding_from_reasons boolean"
CHUNK = "chunk_id string, law string, article_ids array<string>, text string, part int, parts int, start int, stop int"
GOLD = "id string, level string, question string, expected_status string, as_of string, gold_evidence array<string>, key_points array<string>, key_point_literals array<array<string>>, reference_answer string, recent_amendment boolean, notes string"
RETRIEVED = "struct<rank: int, chunk_id: string, article_ids: array<string>, score: double, linked: boolean, via: string>"
CITATION = "struct<source: string, chunk_id: string, article_ids: array<string>, law: string, article: string, quote: string, url: string, source_type: string, status: string, status_notes: array<string>>"
PREDICTION = f"id string, status string, answer string, citations array<{CITATION}>, retrieval array<{RETRIEVED}>, meta struct<model: string, prompt_version: string, strategy: string, as_of: string, latency_ms: bigint, usage: struct<input: bigint, output: bigint, cached_input: bigint>, cost_krw: double, refusal_reason: string, raw_answer: string, cached: boolean>"
JUDGMENT = "id string, judge_error string, grade struct<key_points: array<struct<index: int, key_point: string, asserted: boolean, quote: string>>, temporal_error: boolean, asserts_conclusion: boolean>, grounding struct<claims: array<struct<claim: string, supported: boolean, source: string, derived: boolean>>, n_claims: int, n_unsupported: int>"
LABEL = "item string, rater string, kp array<boolean>, claims array<string>, temporal boolean, conclusion boolean, at string"
PAIR = "id string, source string, query string, positives array<string>, max_gold_sim double, nearest_gold string"
SCORE = "id string, level string, split string, expected string, status string, refusal_reason string, refusal_mode string, m0_correct boolean, m1_recall_any boolean, m1_recall_all boolean, m1_rr double, m1_with_links_any boolean, m2_correct_status boolean, m3_citation_precision double, m3_citation_recall double, m4_kp_coverage double, m4_all_kp boolean, m4_complete boolean, m5_unsupported_rate double, m6_temporal_error boolean, soft_refusal_ok boolean, cost_krw double, latency_ms bigint"
