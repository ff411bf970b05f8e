"""Declared schemas of the canonical tables."""

SCHEMAS = {
    "customers": "customer_id long, persona string, uplift_segment_true string, signup_date timestamp, acquisition_month string, region string, device_type string, "
                 "acquisition_channel string, price_sensitivity double, coupon_affinity double, support_contact_propensity double",
    "treatment_assignments": "customer_id long, treatment_group string, treatment_flag int, campaign_type string, coupon_cost int, assigned_at timestamp",
    "campaign_exposures": "exposure_id string, customer_id long, exposure_time timestamp, campaign_type string, coupon_cost int",
    "events": "event_id string, customer_id long, timestamp timestamp, event_type string, session_id string, item_category string, quantity int",
    "orders": "order_id string, customer_id long, order_time timestamp, item_category string, quantity int, gross_amount double, discount_amount double, "
              "net_amount double, coupon_used int",
    "state_snapshots": "customer_id long, snapshot_date timestamp, last_visit_date timestamp, last_purchase_date timestamp, visits_total int, purchases_total int, "
                       "monetary_total double, inactivity_days int, current_status string",
    "customer_summary": "customer_id long, persona string, recency_days double, frequency long, monetary double, churn_probability double, uplift_score double, "
                        "clv double, coupon_cost double, expected_incremental_profit double, expected_roi double, uplift_segment string",
    "cohort_retention": "cohort_month string, period int, cohort_size long, retained_customers long, retention_rate double, observed boolean, "
                        "activity_definition string, retention_mode string, min_events_per_period int",
}
LIVE_EVENT = "customer_id long, event_type string, event_time timestamp, amount double, source_event_id string, item_category string, channel string, session_id string, raw_payload string"
# Event types the live source accepts.
LIVE_EVENT_TYPES = ["visit", "login", "page_view", "browse", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact", "refund",
                    "coupon_open", "coupon_redeem", "signup", "other"]
