"""Schemas (DDL text) of the tables that the engine reads and writes."""

from __future__ import annotations

TABLES = {
    "stock_master": "stock_code string, stock_name string, market_type string, is_active boolean, sector_code string, created_at timestamp",
    "daily_price": "date date, stock_code string, close_price double, return_rate double, excess_return double, volume long, sector_return double",
    "news_url": "url_hash string, url string, source string, status string, published_at_hint date, created_at timestamp, collected_at timestamp, source_name string, author_name string, image_url string, is_json_ld boolean, meta_data string",
    "news_content": "url_hash string, title string, content string, published_at timestamp, keywords string, extracted_content string",
    "news_mapping": "url_hash string, stock_code string, relevance_score double, is_relevant boolean",
    "sentiment_dict": "stock_code string, word string, beta double, version string, source string, updated_at timestamp",
    "sentiment_dict_meta": "stock_code string, version string, source string, lookback_months int, train_start_date date, train_end_date date, metrics string, is_active boolean, created_at timestamp, parent_version string, promotion_status string, promotion_metrics string, use_sector_beta boolean",
    "predictions": "stock_code string, prediction_date date, sentiment_score double, intensity double, expected_alpha double, confidence_score double, actual_alpha double, prediction int, status string, is_correct boolean, top_keywords string, evidence string, created_at timestamp",
    "fundamentals": "stock_code string, base_date date, per decimal(15,2), pbr decimal(15,2), roe decimal(15,2), market_cap long, sector string",
    "daily_targets": "stock_code string, status string, auto_activate_daily boolean, optimal_lag int, optimal_window_months int, optimal_alpha double, model_type string, started_at timestamp, backfill_until date, updated_at timestamp",
    "jobs": "job_id long, job_type string, params string, status string, progress double, started_at timestamp, created_at timestamp, updated_at timestamp, completed_at timestamp, worker_id string, message string, retry_count int",
    "verification_jobs": "v_job_id long, stock_code string, v_type string, params string, status string, progress double, result_summary string, created_at timestamp, updated_at timestamp, worker_id string, error_message string, retry_count int",
    "verification_results": "v_job_id long, target_date date, predicted_score double, actual_alpha double, is_correct boolean, used_version string",
    "awo_checkpoints": "v_job_id long, stock_code string, window_months int, alpha double, hit_rate double, mae double, stability_score double, status string, created_at timestamp",
    "global_lexicon": "word string, avg_volatility double, impact_score double, occurrence_count long, last_seen_at timestamp",
    "news_errors": "error_id long, url_hash string, error_msg string, retry_count int, occurred_at timestamp",
    "system_events": "timestamp timestamp, event_type string, severity string, component string, message string, metadata string",
    "system_health": "check_type string, status string, details string, updated_at timestamp",
}
#: Columns that name a row; the last write of a key wins.
KEYS = {
    "stock_master": ["stock_code"], "daily_price": ["date", "stock_code"], "news_url": ["url_hash"], "news_content": ["url_hash"],
    "news_mapping": ["url_hash", "stock_code"], "sentiment_dict": ["stock_code", "word", "version", "source"],
    "sentiment_dict_meta": ["stock_code", "version", "source"], "predictions": ["stock_code", "prediction_date"], "fundamentals": ["stock_code", "base_date"],
    "daily_targets": ["stock_code"], "jobs": ["job_id"], "verification_jobs": ["v_job_id"], "verification_results": ["v_job_id", "target_date"],
    "awo_checkpoints": ["v_job_id", "window_months", "alpha"], "global_lexicon": ["word"], "news_errors": ["error_id"], "system_health": ["check_type"],
}
