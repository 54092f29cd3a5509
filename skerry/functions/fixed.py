"""Lists, patterns and constants that results depend on."""

# --- Fixed values: question rules ---

SMALLTALK_PHRASES = ["hello", "hi", "hey", "good morning", "good afternoon", "good evening", "how are you", "how are you doing", "thanks", "thank you", "thank you very much", "bonjour", "salut", "bonsoir", "coucou", "ca va", "comment ca va", "merci", "merci beaucoup", "yo", "greetings", "good day", "nice to meet you", "pleased to meet you"]
SMALLTALK_WORDS = ["hello", "hi", "hey", "bonjour", "salut", "bonsoir", "coucou", "thanks", "thank", "merci"]
DOCUMENT_WORDS = ["document", "doc", "file", "pdf", "csv", "contract", "report", "agreement", "upload", "uploaded", "page", "section", "clause", "article", "documento", "fichier", "contrat", "rapport", "piece", "pieces", "televerse", "uploades"]
QUESTION_WORDS = ["what", "which", "where", "when", "why", "how", "who", "does", "do", "can", "could", "please", "que", "quel", "quelle", "quels", "quelles", "ou", "quand", "pourquoi", "comment", "est ce", "peux", "peut", "montre", "resume", "explique"]
INTENTS = ["smalltalk", "document_question", "mixed"]
FRENCH_WORDS = ["bonjour", "salut", "bonsoir", "coucou", "merci", "contrat", "rapport", "fichier", "document", "quel", "quelle", "quels", "quelles", "comment", "pourquoi", "quand", "peux", "peut", "montre", "resume", "explique", "page", "section"]
VAGUE_PHRASES = ["what about this", "what about that", "and this", "and that", "this one", "that one", "tell me more", "can you elaborate", "et celui ci", "et celle ci", "et ca", "et ceci", "ce document", "ce fichier"]
HEDGES = ["might", "could", "may", "possibly", "perhaps", "seems", "appears", "likely", "uncertain", "unclear", "probably", "roughly", "approximately", "arguably"]
STRONG_WORDS = ["clearly", "definitely", "certainly", "proven", "confirmed"]

# --- Fixed values: safety rules ---

HIGH_RISK = [
    r"ignore\s+(?:your\s+)?(?:previous\s+)?instructions",
    r"ignore\s+(?:your\s+)?(?:system\s+)?prompt",
    r"disregard\s+(?:your\s+)?(?:previous\s+)?instructions",
    r"forget\s+(?:your\s+)?(?:previous\s+)?instructions",
    r"you\s+are\s+now\s+(?:a\s+)?",
    r"act\s+as\s+(?:if\s+)?you\s+(?:are\s+)?",
    r"pretend\s+(?:to\s+)?be\s+(?:a\s+)?",
    r"from\s+now\s+on\s+you\s+are",
    r"repeat\s+(?:the\s+)?(?:words\s+)?above",
    r"repeat\s+(?:the\s+)?(?:words\s+)?before",
    r"show\s+(?:me\s+)?(?:your\s+)?(?:system\s+)?prompt",
    r"print\s+(?:your\s+)?(?:system\s+)?prompt",
    r"what\s+(?:were\s+)?(?:your\s+)?instructions",
    r"```\s*system",
    r"```\s*instructions",
    r"<\s*system\s*>",
    r"<\s*instructions\s*>",
    r"\b(?:api[_-]?key|apikey|secret[_-]?key|token)[\s]*[=:]+[\s]*['\"]?[a-zA-Z0-9_\-]{16,}['\"]?",
    r"(?:show|give|send|tell)\s+(?:me\s+)?(?:your\s+)?(?:api[_-]?\s*key|secret[_-]?\s*key|token|password)",
    r"(?:what\s+is|reveal|expose|disclose|share)\s+(?:your\s+)?(?:api[_-]?\s*key|secret[_-]?\s*key|token|password)",
]
MEDIUM_RISK = [
    r";\s*DROP\s+TABLE",
    r";\s*DELETE\s+FROM",
    r"UNION\s+SELECT",
    r"\\\\n\\s*system",
    r"\\\\n\\s*assistant",
    r"\\\\n\\s*user",
    r"new\s+instructions?:",
    r"updated\s+instructions?:",
    r"override\s+(?:with\s+)?:",
]
SUSPICIOUS_WORDS = ["jailbreak", "prompt injection", "system prompt", "ignore rules", "bypass", "hack", "exploit"]
TOXIC = r"\b(hate|kill|die|violence|attack)\b"
VALIDATOR_PHRASES = ["curl ", "exec(", "bash", "sh -c", "sql ", "drop table", "delete from", "<script", "javascript:", "${", "{{", "ignore previous", "forget previous", "system prompt", "jailbreak"]
VALIDATOR_SIGNS = "{}[]<>\\\"|'~`"
PII = {
    "EMAIL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    "PHONE": (r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b", 0.9),
    "SSN": (r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", 0.95),
    "CREDIT_CARD": (r"\b(?:\d{4}[-.]?){3}\d{4}\b", 0.9),
    "IP_ADDRESS": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.85),
    "API_KEY": (r"\b(?:api[_-]?key|apikey|secret[_-]?key|token)[\s]*[=:]+[\s]*['\"]?[a-zA-Z0-9_\-]{16,}['\"]?", 0.8),
}

# --- Fixed values: sizes and weights ---

CHUNK_CHARS, OVERLAP_CHARS, TABLE_ROWS = 1000, 200, 100
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, TOP_K, RERANK_K, CONTEXT_K = 60, 10, 5, 5
FACTOR_WEIGHTS = {"retrieval_quality": 0.40, "result_agreement": 0.30, "response_certainty": 0.20, "query_type_factor": 0.10}
MAX_FILE_BYTES = 50 * 1024 * 1024
UPLOAD_TYPES = ["pdf", "docx", "doc", "csv", "xlsx", "xls", "txt", "md"]

# --- Fixed values: canned responses, by kind and language ---

CANNED = {
    ("smalltalk", "fr"): "Bonjour ! Je suis la pour repondre a des questions sur vos documents televerses. Demandez-moi un fichier, un sujet, ou ajoutez des documents si vous voulez des reponses ancrees.",
    ("smalltalk", "en"): "Bonjour! Hello! I'm here to help with questions about your uploaded documents. Ask about a file, a topic inside it, or upload documents if you want grounded answers.",
    ("needs_clarification", "fr"): "J'ai besoin d'un peu plus de contexte avant de repondre a partir de vos documents. Indiquez le document, la page, la section ou le sujet que vous voulez que j'examine.",
    ("needs_clarification", "en"): "I need a bit more context before I answer that from your documents. Please mention the document, page, section, or topic you want me to look at.",
    ("missing_support", "fr"): "Je n'ai pas encore trouve assez d'informations dans vos fichiers pour la partie documentaire de votre message. Precisez le document ou le sujet que vous voulez que j'analyse, ou televersez le fichier concerne.",
    ("missing_support", "en"): "I couldn't find supporting information for the document part of your message in the files you uploaded yet. Please mention the document/topic you want me to inspect, or upload the relevant file.",
    ("not_grounded", "fr"): "Je n'ai pas trouve d'informations suffisantes dans vos documents televerses pour repondre a cela. Reformulez la question, mentionnez le document ou le sujet voulu, ou ajoutez les fichiers pertinents.",
    ("not_grounded", "en"): "I couldn't find supporting information for that in your uploaded documents. Please rephrase the question, mention the document/topic you want, or upload relevant files.",
    ("low_evidence", "fr"): "Je n'ai pas assez d'elements fiables dans vos documents televerses pour repondre avec confiance. Indiquez le document, la section ou le sujet que vous voulez que j'utilise.",
    ("low_evidence", "en"): "I don't have enough grounded evidence in your uploaded documents to answer that confidently yet. Please point me to the document, section, or topic you want me to use.",
}
BLOCKED = (
    "Your message appears to contain content that violates our safety guidelines (",
    "). Please rephrase your question without using system commands, instruction overrides, or attempts to access internal configurations. I'm here to help with questions about your uploaded documents!",
)
SIMPLE_MODE_NOTE = "\n\nNote: this answer was taken from the documents without a language model."
APOLOGY = "I couldn't find relevant information in your documents to answer this question. Please try rephrasing or upload documents related to: "
