"""Constants whose values are part of the results."""

from __future__ import annotations

# Session rules.
IDLE_GAP_S, MAX_AGE_S, AUTO_CLOSED_AGE_S, MAX_SIZE = 15 * 60, 4 * 3600, 30 * 60, 1000
RAW_LOG_BYTES = 1_024_000
HEARTBEAT_RULE = "100999"

# Severity by rule level, risk weights and bands.
SEVERITY_LEVELS = ((12, "critical"), (8, "high"), (5, "medium"))
SEVERITIES = ("critical", "high", "medium", "low")
RISK_BASE = {"critical": 70, "high": 50, "medium": 28, "low": 10}
RISK_ASSET = {"high": 30, "medium": 10, "low": 0, "unknown": 0}
RISK_IDENTITY = 15
RISK_IOC = {"malicious": 25, "suspicious": 10, "clean": 0, "not_found": 0, "skipped": 0}
RISK_OCCURRENCES = ((100, 10), (10, 5))
RISK_CONTEXT_CAP, RISK_CAP = 25, 100
RISK_BANDS = ((24, "low"), (49, "medium"), (74, "high"), (100, "critical"))
REPUTATIONS = ("clean", "suspicious", "malicious")
RETRIAGE_FACTOR, RETRIAGE_DELTA = 10, 200
QUEUE_PAGE, QUEUE_PAGE_MOST = 50, 200

# Correlation, history and retrieval.
CORRELATION_WINDOW_S = 2 * 3600
CORRELATION_GROUPS, CORRELATION_SAMPLES = 20, 5
HISTORY_DAYS, HISTORY_EXAMPLES = 90, 3
MATCH_LEVELS = ((0.80, "high"), (0.65, "medium"), (0.50, "low"))
OVERLAP_CANDIDATES = VECTOR_CANDIDATES = 20
MERGED_CANDIDATES, KEPT_MATCHES = 40, 3
TIMELINE_ROWS, TIMELINE_HALF = 300, 150
ENTITY_CAP, REPRESENTATIVES = 50, 15

# Rules, health, evaluation.
RULE_WIDTH_SHARE, REVIEW_TOLERANCE, BLIND_FRACTION = 30, 20, 0.5
NULL_RATIO_LIMIT, UNAVAILABLE_LIMIT, COST_LIMIT, INTAKE_AGE_S, JOB_AGE_S = 0.30, 0.10, 0.80, 300, 600
BOOTSTRAP_SEED, BOOTSTRAP_DRAWS = 20260904, 1000
HEARTBEAT_AGE_MIN, WEBHOOK_AGE_H, DIGEST_HOUR, LOOKUP_FAILURES = 30, 24, 17, 5
MACRO_F1_MAX_DROP, HIGH_CONFIDENCE, TOP_MALWARE, NEWEST_MALWARE = 0.03, 75, 10, 3
DISPLAY_TZ = "Asia/Ho_Chi_Minh"

# Alert categories, the most severe first.
CATEGORY_PRIORITY = (
    "ransomware", "impact", "malware", "c2_beacon", "data_exfiltration", "collection", "lateral_movement", "privilege_escalation",
    "credential_access", "persistence", "defense_evasion", "execution", "ssh_brute_force", "brute_force", "web_attack",
    "initial_access", "suspicious_login", "recon", "resource_development", "policy_violation", "unknown",
)
# Technique, group, decoder and port to category, for Windows event channels and for all.
WINDOWS_DECODER = "windows_eventchannel"
WINDOWS_TECHNIQUES = {
    "T1110": "brute_force", "T1110.001": "brute_force", "T1110.003": "brute_force", "T1490": "ransomware", "T1485": "ransomware",
    "T1071.001": "c2_beacon", "T1573": "c2_beacon", "T1048": "data_exfiltration", "T1567": "data_exfiltration", "T1059.001": "malware",
    "T1003": "credential_access", "T1003.001": "credential_access",
}
WINDOWS_GROUPS = {"authentication_failed": "brute_force", "authentication_failures": "brute_force", "invalid_login": "brute_force", "authentication_success": "suspicious_login"}
TECHNIQUES = {
    "T1110": "ssh_brute_force", "T1110.001": "ssh_brute_force", "T1078": "suspicious_login", "T1204": "malware", "T1105": "malware",
    "T1486": "ransomware", "T1190": "web_attack", "T1189": "web_attack", "T1505.003": "web_attack", "T1046": "recon", "T1018": "recon",
    "T1016": "recon", "T1482": "recon", "T1548": "privilege_escalation", "T1003": "credential_access", "T1003.001": "credential_access",
    "T1071": "c2_beacon", "T1071.004": "c2_beacon", "T1041": "data_exfiltration",
}
GROUPS = {
    "authentication_failed": "ssh_brute_force", "authentication_failures": "ssh_brute_force", "invalid_login": "ssh_brute_force",
    "authentication_success": "suspicious_login", "privilege_escalation": "privilege_escalation", "sudo": "privilege_escalation",
    "rootcheck": "privilege_escalation", "web_scan": "recon", "recon": "recon", "nmap": "recon", "sql_injection": "web_attack",
    "sqlinjection": "web_attack", "web_attack": "web_attack", "virus": "malware", "malware": "malware", "clamd": "malware",
    "exfiltration": "data_exfiltration",
}
DECODERS = {"sshd": "ssh_brute_force", "apache": "web_attack", "nginx": "web_attack", "iis": "web_attack", "modsecurity": "web_attack", "web-accesslog": "web_attack", "suricata": "c2_beacon", "clamd": "malware"}
PORTS = {22: "ssh_brute_force", 80: "web_attack", 443: "web_attack"}
# Which fields of an alert a rule may test, and how.
RULE_FIELDS = {
    "rule_id": ("eq", "in"), "category": ("eq", "in"), "srcip": ("eq", "in", "cidr"), "dstip": ("eq", "in", "cidr"),
    "agent_name": ("eq", "in", "prefix"), "agent_id": ("eq", "in", "prefix"), "alert_user": ("eq", "in"), "decoder": ("eq", "in"),
    "dst_port": ("eq", "in"), "src_port": ("eq", "in"), "rule_level": ("eq", "lte"), "asset_criticality": ("eq", "in"),
    "identity_privileged": ("eq",), "ioc_reputation": ("eq", "in"),
}
