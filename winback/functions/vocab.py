"""The words by which uploaded columns and event values are recognised, in order of precedence."""

# Column names of each role.
ROLES = {
    "customer_id": ["customer_id", "cust_id", "user_id", "userid", "member_id", "memberid", "account_id", "accountid", "client_id", "clientid", "id", "고객id",
                    "고객번호", "회원번호", "customer_no", "cust_no", "subscriber_id",
                    "account_no", "account_number", "acct_no", "acct_id", "cif", "cif_no", "client_no", "party_id", "household_id", "card_customer_id",
                    "loan_customer_id", "계좌번호", "계좌id", "고객계좌번호", "거래고객번호", "차주번호"],
    "timestamp": ["timestamp", "date", "datetime", "event_date", "event_time", "created_at", "updated_at", "order_date", "order_time", "purchase_date",
                  "transaction_date", "txn_date", "txn_time", "trade_date", "posting_date", "value_date", "signup_date", "registration_date",
                  "account_open_date", "card_issue_date", "loan_start_date", "maturity_date", "일시", "날짜", "주문일", "가입일",
                  "거래일", "거래일시", "이체일", "계좌개설일", "대출실행일", "exposure_time", "assigned_at", "snapshot_date", "time", "ts"],
    "event_type": ["event_type", "event", "action", "activity", "action_type", "activity_type", "transaction_type", "txn_type", "trade_type", "channel_event",
                   "service_event", "transaction_code", "txn_code", "banking_event", "financial_event", "product_event",
                   "이벤트유형", "행동유형", "거래유형", "거래종류", "금융거래유형", "금융이벤트", "업무구분", "거래구분", "behavior", "behaviour"],
    "amount": ["amount", "revenue", "price", "total", "net_amount", "gross_amount", "monetary", "spend", "payment", "금액", "매출", "결제금액", "주문금액",
               "transaction_amount", "txn_amount", "order_amount", "sales", "net_revenue", "balance", "account_balance", "avg_balance", "average_balance",
               "deposit_amount", "withdrawal_amount", "transfer_amount", "card_spend", "card_amount", "loan_amount", "loan_balance", "credit_limit",
               "available_credit", "outstanding_balance", "principal_balance", "aum", "asset", "assets",
               "잔고", "평균잔고", "예금", "출금", "입금", "이체금액", "카드이용금액", "대출금액", "대출잔액", "한도", "자산", "운용자산"],
    "churn_flag": ["churn", "churned", "is_churn", "churn_flag", "churn_label", "이탈", "이탈여부", "attrition", "left", "cancelled", "canceled", "unsubscribed",
                   "closed", "account_closed", "account_closure", "inactive", "dormant", "defaulted", "delinquent", "loan_default", "card_cancelled",
                   "status", "current_status", "customer_status", "account_status", "relationship_status",
                   "해지", "해지여부", "계좌해지", "휴면", "휴면여부", "연체", "부도"],
    "category": ["category", "item_category", "product_category", "카테고리", "상품분류", "product_type", "item_type", "department", "section",
                 "financial_product", "financial_product_type", "product_family", "product_name", "account_type", "card_type", "loan_type", "fund_type",
                 "insurance_type", "deposit_type", "asset_class", "service_type",
                 "상품유형", "금융상품", "금융상품유형", "계좌유형", "카드유형", "대출유형", "펀드유형"],
    "quantity": ["quantity", "qty", "수량", "items", "item_count", "count"],
    "persona": ["persona", "segment", "customer_segment", "group", "tier", "등급", "고객유형", "membership_tier", "customer_type",
                "risk_grade", "credit_grade", "asset_segment", "wealth_segment", "relationship_segment", "리스크등급", "신용등급", "자산구간", "거래등급"],
    "region": ["region", "city", "state", "country", "지역", "도시", "location", "area", "province", "zip", "zipcode", "postal_code"],
}
# Column names of physical measurements.
SENSOR_WORDS = ["latitude", "longitude", "lat", "lng", "lon", "pixel", "image_url", "photo", "dna", "genome", "gene", "chromosome", "temperature",
                "humidity", "pressure", "altitude", "speed", "voltage", "current", "resistance", "wavelength"]
# Event values of each standard type.
EVENT_VALUES = {
    "purchase": ["purchase", "purchased", "buy", "bought", "checkout", "checkout_complete", "checkout_start", "order", "order_complete", "order_placed",
                 "transaction", "payment", "paid", "complete_purchase", "payment_success", "payment_complete", "payment_fail", "payment_failed",
                 "subscription_start", "subscribe", "renewal", "renew", "plan_change", "plan_upgrade", "plan_downgrade", "upgrade", "downgrade",
                 "deposit", "withdrawal", "transfer", "wire_transfer", "bank_transfer", "remittance", "card_payment", "card_use", "card_transaction",
                 "loan_payment", "repayment", "auto_payment", "investment_order", "fund_purchase", "trade", "securities_trade", "account_open",
                 "loan_disbursement", "card_approval", "card_issued", "premium_payment", "fee_payment",
                 "결제", "구매", "주문", "주문완료", "결제완료", "입금", "출금", "이체", "송금", "카드결제", "카드이용",
                 "상환", "투자", "매매", "계좌개설", "대출실행", "카드발급", "보험료납입"],
    "visit": ["visit", "visited", "session_start", "session_begin", "session_end", "session_close", "login", "logged_in", "logout", "log_out",
              "app_open", "app_close", "app_launch", "site_visit", "launch", "sign_in", "signin", "active_session", "push_open", "notification_open",
              "balance_check", "account_login", "mobile_banking_login", "statement_view", "branch_visit", "atm_use", "banking_app_open", "online_banking_login",
              "방문", "로그인", "접속", "세션시작", "세션종료", "잔고조회", "계좌조회", "영업점방문", "앱실행"],
    "page_view": ["page_view", "pageview", "view", "viewed", "product_view", "viewed_product", "item_view", "page", "screen_view", "impression", "view_item",
                  "view_item_list", "select_item", "scroll", "feature_use", "feature_view", "click", "tap", "select", "browse", "explore", "review_write", "review",
                  "stream_start", "stream_complete", "stream_end", "watch", "watched", "video_play", "video_complete", "video_pause", "play", "pause", "resume",
                  "push_received", "notification_received", "coupon_use", "coupon", "point_use", "points_use",
                  "account_view", "balance_view", "statement_download", "card_statement_view", "loan_product_view", "fund_view", "insurance_view",
                  "조회", "상품조회", "페이지뷰", "둘러보기", "계좌조회", "명세서조회", "금융상품조회"],
    "search": ["search", "searched", "query", "find", "lookup", "filter", "sort", "loan_calculator", "rate_search", "product_compare", "eligibility_check",
               "limit_check", "credit_score_check", "branch_search", "atm_search", "fx_rate_search",
               "검색", "필터", "금리조회", "상품비교", "한도조회", "신용점수조회", "환율조회"],
    "add_to_cart": ["add_to_cart", "addtocart", "cart_add", "add_cart", "added_to_cart", "remove_from_cart", "cart_remove", "wishlist_add", "favorite", "favorited",
                    "like", "liked", "bookmark", "save", "application_start", "loan_apply_start", "card_apply_start", "account_apply_start",
                    "quote_saved", "product_saved", "pre_approval", "preapproved", "limit_precheck",
                    "장바구니", "장바구니추가", "찜", "즐겨찾기", "신청시작", "대출신청시작", "카드신청시작", "관심상품저장"],
    "support_contact": ["support", "support_contact", "support_chat", "contact", "inquiry", "help", "feedback", "cs", "customer_service", "ticket", "ticket_open",
                        "ticket_close", "complaint", "report_issue", "nps", "nps_submit", "survey", "refund_request", "refund", "return", "returned", "return_request",
                        "cancel_request", "cancel", "cancellation", "uninstall", "uninstall_signal", "unsubscribe", "loan_inquiry", "card_cancel", "account_close",
                        "close_account", "delinquency_notice", "chargeback", "fraud_report", "card_lost", "card_block", "limit_increase_request",
                        "deferment_request", "hardship_request", "complaint_banking",
                        "문의", "상담", "고객센터", "신고", "환불", "반품", "취소", "해지", "계좌해지", "연체", "분실신고", "카드정지", "한도상향요청", "상환유예요청"],
}
# Texts that count as yes, as no issue, and as a churn label.
TRUTHY = ["1", "true", "t", "y", "yes", "used", "redeemed", "open", "opened", "exposed"]
NO_ISSUE = ["", "none", "nan", "no", "없음"]
CHURN_TEXTS = {"yes": 1.0, "no": 0.0, "y": 1.0, "n": 0.0, "true": 1.0, "false": 0.0, "1": 1.0, "0": 0.0, "churn": 1.0, "active": 0.0, "churned": 1.0,
               "churn_risk": 1.0, "dormant": 0.5}
# Finance names of the event types.
FINANCE_EVENTS = {"visit": "채널접속", "page_view": "계좌·상품조회", "search": "상품탐색", "add_to_cart": "신청시작/관심상품", "purchase": "금융거래", "support_contact": "상담/민원"}
FINANCE_OTHER = "기타 금융활동"
DATE_PATTERN = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"

# Upload column names of the known customer columns.
KNOWN_COLUMNS = {
    "amount": ["amount", "net_amount", "transaction_amount"],
    "order_count": ["total_order_count", "order_count", "orders_count", "purchase_count"],
    "registration_days": ["days_since_registration", "customer_age_days", "days_from_signup"],
    "channel": ["access_channel", "channel", "device", "platform"],
    "gender": ["gender"],
    "age_group": ["age_group", "age_band", "age_range"],
    "payment_method": ["payment_method"],
    "delivery_type": ["delivery_type", "shipping_type"],
    "session": ["session_duration_sec", "session_duration", "duration_sec"],
    "pages": ["page_views", "pageviews", "views"],
    "discount": ["discount_amount", "discount", "coupon_discount"],
    "points": ["point_used", "points_used", "mileage_used"],
    "exposure": ["coupon_exposure", "coupon_exposed", "coupon_sent", "coupon_offer", "promotion_exposure", "campaign_exposure"],
    "redeem": ["coupon_used", "coupon_use", "coupon_redeemed", "coupon_redemption", "redeemed_coupon"],
    "campaign": ["campaign_id", "campaign", "campaign_name", "promotion_id", "coupon_id"],
    "reason": ["refund_reason", "return_reason", "cancel_reason"],
}
# Upload column names of the finance numbers.
FINANCE_NUMBERS = {
    "account_balance_current": ["account_balance", "balance", "current_balance", "잔고", "계좌잔고"],
    "avg_balance": ["avg_balance", "average_balance", "평균잔고"],
    "loan_balance": ["loan_balance", "outstanding_balance", "principal_balance", "대출잔액"],
    "loan_amount": ["loan_amount", "대출금액"],
    "credit_limit": ["credit_limit", "available_credit", "한도", "카드한도"],
    "card_spend_total": ["card_spend", "card_amount", "카드이용금액"],
    "deposit_amount_total": ["deposit_amount", "입금액", "예금액"],
    "withdrawal_amount_total": ["withdrawal_amount", "출금액"],
    "transfer_amount_total": ["transfer_amount", "이체금액"],
    "aum": ["aum", "asset", "assets", "자산", "운용자산"],
    "credit_score": ["credit_score", "신용점수"],
    "delinquency_days": ["delinquency_days", "days_past_due", "dpd", "연체일수"],
    "missed_payment_count": ["missed_payment_count", "연체횟수", "미납횟수"],
    "tenure_months": ["tenure_months", "relationship_months", "거래개월수", "가입개월수"],
    "digital_login_count": ["digital_login_count", "mobile_login_count", "app_login_count", "모바일로그인횟수"],
    "branch_visit_count": ["branch_visit_count", "영업점방문횟수"],
    "product_count": ["product_count", "num_products", "보유상품수"],
}
# Upload column names of the finance texts.
FINANCE_TEXTS = {
    "financial_product": ["financial_product", "product_type", "product_name", "account_type", "card_type", "loan_type", "fund_type", "금융상품", "상품유형"],
    "risk_grade": ["risk_grade", "credit_grade", "리스크등급", "신용등급"],
    "account_status": ["account_status", "relationship_status", "status", "계좌상태", "고객상태"],
    "income_band": ["income_band", "소득구간"],
}
