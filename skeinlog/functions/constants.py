"""Fixed values of the event model: prefix lists, patterns, limits and formats."""

# Openings of injected context in user turns.
INJECTED_PREFIXES = [
    "<permissions instructions>",
    "<app-context>",
    "<collaboration_mode>",
    "<environment_context>",
    "<multi_agent_mode>",
    "<recommended_plugins>",
    "<skills_instructions>",
    "<apps_instructions>",
    "<plugins_instructions>",
    "<user_instructions>",
    "<INSTRUCTIONS>",
    "# AGENTS.md instructions",
    "# Project memory",
    "You are /root, the primary agent",
    "You are `/root`, the primary agent in a team of agents",
    "You are an agent in a team of agents collaborating",
]

# Openings of local-command telemetry in user turns.
LOCAL_COMMAND_PREFIXES = ["<local-command-caveat>", "<local-command-stdout>", "<command-name>", "<command-message>", "<command-args>"]

# Attachment inventory and scheduled-task preambles.
ATTACHMENT_OPENING = "# Files mentioned by the user:"
ATTACHMENT_MARKERS = ["\n## My request for Codex:\n", "\n# My request for Codex:\n"]
SCHEDULED_OPENING = "[IMPORTANT: You are running as a scheduled"
SCHEDULED_PATTERN = r"(?s)^\[IMPORTANT: You are running as a scheduled.*?\](\s*\n\s*\n|\s*$)"
SUMMARY_MARKERS = ["## My request for Codex:", "My request for Codex:"]
MEDIA_PATTERN = r"(?s)<image\b.*?</image>|<video\b.*?</video>"

# Secrets and personal data.
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SECRET_PATTERNS = [
    r"ghp_[A-Za-z0-9]{36,}",
    r"gho_[A-Za-z0-9]{36,}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    r"sk-[A-Za-z0-9]{32,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)\b[a-f0-9]{40,}\b",
]
EMAIL_MARK = "[REDACTED-EMAIL]"
SECRET_MARK = "[REDACTED-SECRET]"

# Conversation search and event pages.
SEARCH_DEFAULT, SEARCH_MAX, SEARCH_SCAN, PREVIEW_TURNS = 25, 100, 500, 6
PAGE_DEFAULT, PAGE_MAX = 100, 1000

# Event types.
PAYLOAD_TYPES = ["create", "update", "resolution"]
CHECKPOINT_TYPES = ["snapshot", "baseline"]
MAIN = "main"
FULL_FORMAT, DELTA_FORMAT = "acf.conversation.v1", "acf.conversation.delta.v1"

# Metrics and retention.
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PIN_TAGS = ["pinned", "keep-forever"]
