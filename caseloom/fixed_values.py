"""Word lists, thresholds, limits, formats and prompt texts.

Results depend on these being exactly as they are, so they are kept together and stated plainly.
"""

# --- fixed values: search ---
SIMILAR_THRESHOLD = 0.3
RECOMMEND_THRESHOLD = 0.4
CONTEXT_THRESHOLD = 0.5
CONTEXT_FALLBACK_THRESHOLD = 0.3
CONTEXT_FALLBACK_RECENT = 100
CANDIDATE_LIMIT = 300
SIMILAR_K = 5
RECOMMEND_K = 3
CONTEXT_K = 3
MIN_SUMMARY_CHARS = 5
LIST_K = 5
SNAPSHOT_TTL_SECONDS = 180

# --- fixed values: text features and clusters ---
MAX_FEATURES = 2000
MIN_DF = 2
MAX_DF = 0.85
N_CLUSTERS = 5
KMEANS_RESTARTS = 10
KMEANS_SEED = 42
TOP_KEYWORDS = 7
MODES_SHOWN = 3

# --- fixed values: links ---
TOKEN_CHARS = 32
TOKEN_TTL_SECONDS = 86400

# --- fixed values: message routing ---
RECOMMEND_KEYWORDS = [
    "can you recommend", "could you recommend", "please recommend",
    "show me recommendations", "give me recommendations",
    "recommend solutions", "recommend tickets", "recommend",
    "suggestion", "what should", "how to", "best practice",
    "resolution", "fix", "solve", "troubleshoot", "help with", "suggest",
]
SIMILAR_KEYWORDS = [
    "similar", "like this", "related", "comparable", "same issue",
    "same problem", "find tickets", "search tickets", "tickets about",
    "issues like", "problems like", "incidents like", "tickets similar",
]
TOPIC_STOP_WORDS = [
    "are", "there", "any", "to", "for", "about", "with", "like", "this", "that", "the", "a", "an",
    "solutions", "tickets", "some", "me", "you", "can", "could", "please", "show", "find", "get", "give",
]
TOPIC_WORDS = 3
RECOMMEND_COMMAND_TEXT = "High priority tickets"

# --- fixed values: default texts ---
NOT_AVAILABLE = "N/A"
NOT_RESOLVED = "Not resolved"
NO_COMMENTS = "No comments"
NO_RESOLUTION = "No explicit resolution information found."
NO_SUMMARY = "No summary available"

# --- fixed values: assistant prompts ---
TICKET_PROMPT = (
    "You are an expert IT support assistant. You are currently helping with ticket #%s. "
    "Your role is to help support agents resolve this specific ticket quickly and effectively. "
    "Focus exclusively on the details of this ticket. "
    "Provide specific, actionable advice based on the ticket details. "
    "Be practical and solution-focused."
)
GENERAL_PROMPT = (
    "You are an expert IT support assistant with access to a knowledge base of past incidents. "
    "Your role is to help support agents resolve issues quickly and effectively. "
    "When provided with context from past incidents, use that information to give specific, "
    "actionable advice. If no specific context is available, provide general best practices "
    "and troubleshooting steps. Always be practical and solution-focused."
)
NO_CONTEXT_PROMPT = (
    "No specific historical incidents found in knowledge base for this query. "
    "Provide general troubleshooting advice."
)
CONTEXT_PROMPT_HEAD = "Knowledge Base Context:\n"
INCIDENT_HEAD = "Current Incident Details:\n"
CONTEXT_HEAD = "Relevant past incidents from knowledge base:\n"
CONTEXT_ITEM = (
    "%d. Ticket %s (Category: %s, Similarity: %s):\n"
    "   Summary: %s\n"
    "   Resolution/Comments: %s\n"
)
NO_CONTEXT_SUMMARY = "No relevant historical incidents found"

# --- fixed values: cluster prompts ---
ANALYST_PROMPT = "You are an IT incident analyst. Provide detailed, actionable insights."
CLUSTER_SAMPLES = 5
CLUSTER_PROMPT = """As an IT incident analysis expert, analyze this cluster of incidents:

        Stats:
        - Total Incidents: %s
        - Avg Resolution: %s hours
        - Median Resolution: %s hours
        - Categories: %s
        - Task Types: %s
        - Severities: %s
        - Key Terms: %s

        Sample Incidents:
        %s

        Analyze:
        1. Root Causes
        2. Patterns
        3. Impact Areas
        4. Resolution Steps
        5. Prevention
        6. Improvements
        """
BATCH_SAMPLES = 10
BATCH_ANALYST_PROMPT = (
    "You are a helpful assistant for IT incident root cause analysis. Be concise and actionable."
)
BATCH_SUMMARY_PROMPT = """Analyze these related incidents and identify:
    1. Common patterns and themes
    2. Potential systemic issues
    3. Key impacted systems or services

    Incident descriptions:
    %s
    """
BATCH_ROOT_CAUSE_PROMPT = """Based on these related incidents, identify:
    1. Root cause patterns
    2. Contributing factors
    3. Potential preventive measures

    Be specific and concise. Incident descriptions:
    %s
    """

# --- fixed values: chat replies in markdown ---
SIMILAR_TITLE = "Similar Tickets Found"
RECOMMENDED_TITLE = "Recommended Tickets"
LATEST_TITLE = "Similar Tickets"
SCORED_TABLE_HEAD = "|Ticket Number|Description|Similarity|\n|---|---|---|\n"
PLAIN_TABLE_HEAD = "|Ticket Number|Description|\n|---|---|\n"
LINKS_HEAD = "\n**Ticket Links:**\n"
LINK_LINE = "- Ticket %s: %s\n"
