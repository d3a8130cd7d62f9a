"""Schemas of the engine's tables."""

from __future__ import annotations

PLACEMENT = "struct<row:int,col:int,letter:string,is_blank:boolean>"
CELL = "struct<row:int,col:int,letter:string,is_blank:boolean,is_existing:boolean>"
MOVE = f"struct<placements:array<{PLACEMENT}>,score:int,words:array<string>>"
POSITION = (
    f"id string, band_ply int, source_game_id string, source_seed int, board array<{CELL}>, rack string, player_to_move int, "
    f"bag_count int, tiles_played int, optimal_score int, optimal_moves array<{MOVE}>, canonical_optimal_move {MOVE}"
)
RUN = (
    "id string, model_id string, model_name string, company_slug string, release_date string, reasoning_effort string, mode string, "
    "board_count int, status string, started_at string, finished_at string, raw_points bigint, optimal_raw_points bigint, "
    "score_pct double, avg_total_tokens double, min_total_tokens int, max_total_tokens int, error string"
)
BOARD_RESULT = (
    "id bigint, run_id string, position_id string, attempt_index int, raw_response string, parsed_move string, "
    "validation_error string, attempt_trace string, retry_used int, move_score int, optimal_score int, is_optimal int, "
    "prompt_tokens int, completion_tokens int, total_tokens int, latency_ms int, created_at string"
)
#: Row and column are text, and cast leniently: models send "7" as well as 7.
RAW_PLACEMENT = "struct<row:string,col:string,letter:string>"
TRACE_EVENT = "struct<type:string,elapsed_ms:int,delta_ms:int,chars:int,source:string>"
RUN_EVENT = (
    "type string, run_id string, index int, board_count int, position_id string, attempt_index int, model string, "
    "reasoning_effort string, concurrency int, runner string, cli_agent string, cli_model string, channel string, text string, "
    "elapsed_ms int, delta_ms int, chars int, error string, move_score int, optimal_score int, retry_used boolean, "
    "validation_error string, total_tokens int, latency_ms int"
)
