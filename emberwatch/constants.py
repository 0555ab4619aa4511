"""Fixed values that must equal the reference's for results to match.

They are stated here once, as plain text, in their natural order.
"""

# The six simulated services, in catalogue order.
SERVICES = [
    "api-gateway",
    "payment-service",
    "order-service",
    "user-service",
    "notification-service",
    "inventory-service",
]

# Monitored metrics, their default anomaly type and default severity.
MONITORED_METRICS = [
    ("service_latency_p99_ms", "LATENCY_SPIKE", "HIGH"),
    ("service_error_rate_percent", "ERROR_RATE_SPIKE", "HIGH"),
    ("service_cpu_percent", "CPU_SATURATION", "HIGH"),
    ("service_memory_percent", "MEMORY_LEAK", "HIGH"),
    ("service_db_connections", "DB_CONNECTION_EXHAUSTION", "HIGH"),
    ("kafka_consumer_lag", "KAFKA_CONSUMER_LAG", "MEDIUM"),
]
METRIC_NAMES = [m for m, _, _ in MONITORED_METRICS]

# Per-metric severity bounds in sigma (CRITICAL, HIGH); other metrics use 6.0 / 3.0.
SEVERITY_THRESHOLDS = [
    ("service_latency_p99_ms", 5.0, 3.0),
    ("service_error_rate_percent", 6.0, 3.5),
    ("service_cpu_percent", 5.5, 3.0),
    ("service_memory_percent", 5.0, 3.0),
    ("service_db_connections", 4.0, 2.8),
    ("kafka_consumer_lag", 5.0, 3.0),
]
DEFAULT_CRITICAL_SIGMA = 6.0
DEFAULT_HIGH_SIGMA = 3.0

# Detection parameters.
SIGMA_THRESHOLD = 2.5
DEDUP_TTL_S = 300
BASELINE_WINDOW = 50
MIN_SAMPLES = 10
BASELINE_GAP_S = 3600
SCRAPE_DEDUP_S = 14
BURST_GAP_S = 60
BURST_COUNT = 5
BURST_SCORE = 0.7
INCIDENT_LOCK_S = 1800
CORRELATION_WINDOW_MIN = 30
DEPLOY_WINDOW_MIN = 60

# Anomaly, severity and status enums.
ANOMALY_TYPES = [
    "LATENCY_SPIKE", "ERROR_RATE_SPIKE", "CPU_SATURATION", "MEMORY_LEAK",
    "DB_CONNECTION_EXHAUSTION", "KAFKA_CONSUMER_LAG", "DEPLOYMENT_FAILURE",
    "DEPENDENCY_OUTAGE", "NETWORK_PARTITION", "UNKNOWN",
]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
STATUSES = ["DETECTING", "CORRELATING", "INVESTIGATING", "RCA_COMPLETE", "REMEDIATING", "RESOLVED"]
EMAIL_STATUSES = ["PENDING", "SENT", "FAILED"]
LOG_LEVELS_KEPT = ["ERROR", "FATAL", "WARN"]

# Sustained alert rules (metric, limit, hold seconds, alert name).
ALERT_RULES = [
    ("service_latency_p99_ms", 2000.0, 60, "HighLatencyP99"),
    ("service_error_rate_percent", 5.0, 60, "HighErrorRate"),
    ("service_cpu_percent", 85.0, 120, "CPUSaturation"),
    ("service_memory_percent", 80.0, 120, "MemoryPressure"),
    ("kafka_consumer_lag", 10000.0, 60, "KafkaConsumerLag"),
]

# Service registry rows
# (service, team, criticality, sla p99 ms, sla error %, on-call, slack, upstream, downstream).
REGISTRY = [
    ("api-gateway", "platform-team", "P0", 200, 0.5, "platform-oncall@company.com", "#platform-alerts",
     [], ["payment-service", "order-service", "user-service"]),
    ("payment-service", "payments-team", "P0", 500, 0.1, "payments-oncall@company.com", "#payments-alerts",
     ["api-gateway"], ["postgres", "redis"]),
    ("order-service", "commerce-team", "P0", 400, 0.5, "commerce-oncall@company.com", "#commerce-alerts",
     ["api-gateway"], ["payment-service", "inventory-service", "kafka", "notification-service"]),
    ("user-service", "identity-team", "P1", 300, 0.5, "identity-oncall@company.com", "#identity-alerts",
     ["api-gateway"], ["postgres", "redis"]),
    ("notification-service", "platform-team", "P1", 1000, 1.0, "platform-oncall@company.com", "#platform-alerts",
     ["order-service"], ["kafka"]),
    ("inventory-service", "commerce-team", "P1", 400, 1.0, "commerce-oncall@company.com", "#commerce-alerts",
     ["order-service"], ["postgres"]),
]

# Blast-radius text by criticality tier.
USER_IMPACT = [
    ("P0", "~100% of active users affected"),
    ("P1", "~30-60% of active users affected"),
    ("P2", "~5-10% of active users affected"),
]
REVENUE_IMPACT = [
    ("P0", "High — payment/order processing blocked"),
    ("P1", "Medium — degraded checkout experience"),
    ("P2", "Low — non-critical feature unavailable"),
]
UNKNOWN_USER_IMPACT = "Impact unknown"
UNKNOWN_REVENUE_IMPACT = "Unknown"
DEFAULT_CRITICALITY = "P1"

# Retrieval.
CHARS_PER_TOKEN = 4
MAX_TOKENS = 4096
BUDGET_ORDER = ["incidents", "runbooks", "architecture", "deployments", "postmortems"]
SERVICE_BOOST = 0.15
TYPE_BOOST = 0.10

# Notification recipients by role.
ONCALL = ["oncall@company.com"]
ALL_RECIPIENTS = ["oncall@company.com", "sre-team@company.com", "engineering-management@company.com"]

# Fixed value: DNS namespace UUID used for stable point ids (RFC 4122).
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# The list of things that went well in every report.
REPORT_WENT_WELL = ["The anomaly was detected automatically within the detection window",
                    "Root cause analysis was completed without manual triage",
                    "Automated postmortem generated within minutes of resolution"]

# Titles of the evidence sections, by collection.
SECTION_TITLES = [
    ("incidents", "SIMILAR HISTORICAL INCIDENTS"),
    ("runbooks", "RELEVANT RUNBOOKS"),
    ("architecture", "SERVICE ARCHITECTURE"),
    ("deployments", "RECENT DEPLOYMENTS"),
    ("postmortems", "POSTMORTEM PATTERNS"),
]

# The fallback plan ({service} is the primary service), its owner without a registry row, and its duration.
DEFAULT_ON_CALL = "on-call-engineer@company.com"
DEFAULT_RESOLUTION_TIME = "15-30 minutes"
DEFAULT_STEPS = [
    {"priority": "IMMEDIATE",
     "action": "Check health endpoint of {service} and review recent logs",
     "rationale": "Establish current service state before taking action",
     "risk_level": "LOW",
     "rollback": "N/A",
     "expected_outcome": "Clear picture of current service state",
     "runbook_source": "SRE best practice"},
    {"priority": "IMMEDIATE",
     "action": "Rollback the most recent deployment to {service} if deployed in last 60 minutes",
     "rationale": "Deployment correlation detected — rollback is fastest path to recovery",
     "risk_level": "LOW",
     "rollback": "Redeploy the rolled-back version",
     "expected_outcome": "Error rate drops within 2 minutes of rollback",
     "runbook_source": "deployment-rollback runbook"},
]

# The report's list of what could be improved ({type} is the anomaly type).
REPORT_IMPROVE = ["Review alert thresholds to reduce time-to-detect", "Ensure runbooks are up-to-date for {type} scenarios"]

# Bodies of the notifications by kind; `{{name}}` is filled from the event's context.
BODIES = {
    "anomaly": "<h2>{{severity}} {{anomaly_type}} on {{service}}</h2><p>INC-{{incident_id_short}}, detected {{detection_time}}</p>"
               "<p>{{trigger_metric}}: {{observed_value}} against {{baseline_value}} ({{deviation_sigma}} sigma)</p><p>{{description}}</p>"
               "<p>Services: {{affected_services}}. Users: {{user_impact}}. Revenue: {{revenue_impact}}.</p><small>{{generated_at}}</small>",
    "rca": "<h2>Root cause of INC-{{incident_id_short}}</h2><p>{{top_root_cause}} ({{confidence_pct}}%)</p><ul>{{evidence_list}}</ul>"
           "{{similar_incidents_html}}{{deployment_section}}<ul>{{signals_list}}</ul><small>{{generated_at}}</small>",
    "plan": "<h2>Plan for INC-{{incident_id_short}}</h2><p>{{top_root_cause}}, {{estimated_time}}</p>{{steps_html}}"
            "<p>Escalation: {{escalation_path}}</p>{{runbook_refs_html}}<small>{{generated_at}}</small>",
    "resolved": "<h2>{{anomaly_type}} on {{service}} resolved</h2><p>INC-{{incident_id_short}} ({{severity}}), {{mttr}} min, "
                "{{resolution_method}}</p><p>{{top_root_cause}}</p><p>{{detection_time}} to {{resolved_at}}</p><small>{{generated_at}}</small>",
    "postmortem": "<h2>Postmortem of INC-{{incident_id_short}}: {{anomaly_type}} on {{service}}</h2><p>{{severity}}, {{mttr}} min, "
                  "{{affected_services}}</p><p>{{executive_summary}}</p><pre>{{full_markdown}}</pre><small>{{date}} {{generated_at}}</small>",
}
