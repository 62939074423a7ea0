"""Word lists, patterns, limits and maps that results depend on."""

from __future__ import annotations

# --- fixed values: sparse retrieval ---
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need",
    "this", "that", "these", "those", "it", "its", "they", "them", "their", "we", "us", "our", "you", "your", "he", "she", "his", "her", "i",
    "me", "my", "who", "which", "what", "where", "when", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some",
    "such", "no", "not", "only", "same", "so", "than", "too", "very", "just", "also", "now", "here", "there", "then", "if", "because",
    "about", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "once", "et", "al",
    "fig", "figure", "table", "section", "eq", "equation", "ref",
]
BM25_K1, BM25_B, DEFAULT_IDF, DEFAULT_AVGDL = 1.5, 0.75, 1.0, 200.0
#: Saturation of frequencies in a full-text index over labels, and the score a node has to pass.
LABEL_K1, NODE_MIN = 1.2, 0.1

# --- fixed values: query understanding ---
KEYWORD_STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "about", "above", "after", "again", "against", "all", "am", "and", "any", "as", "at", "because",
    "before", "below", "between", "both", "but", "by", "for", "from", "further", "here", "how", "if", "in", "into", "it", "its", "itself",
    "just", "more", "most", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "so",
    "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "what", "when", "where", "which", "while", "who", "why", "with", "you", "your", "compare", "explain", "list",
    "find", "show", "tell", "me", "please", "summarize", "describe",
]
YEARS = r"(?:from|after|since|between)\s+(\d{4})(?:\s+(?:to|and|until)\s+(\d{4}))?|(?:before|until|up to)\s+(\d{4})|in\s+(\d{4})"
AUTHOR = r"(?:by|author(?:ed by)?)\s+([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?)"
INTENTS = (
    ("summary", ("summarize", "summary of", "overview of", "what is known about", "tell me about")),
    ("compare", ("compare", "difference between", "how does .+ differ from", r"vs\.?", "versus", "similarities between")),
    ("find_evidence", ("evidence for", "evidence that", "support for", "prove", "show that", "demonstrate")),
    ("explore", ("related to", "connections? between", "explore", "what else", "associated with")),
    ("explain", ("explain", "how does", "why does", "what causes", "mechanism of", "how is .+ related")),
    ("list", ("list", "what are the", "which .+ are", "enumerate", "name the")),
    ("factual", ("what is", "when did", "who", "where", "how many", "how much")),
)
DEFAULT_INTENT = "factual"
ACRONYM_EXPANSIONS = (
    ("cme", "coronal mass ejection CME"),
    ("sw", "solar wind"),
    ("imf", "interplanetary magnetic field IMF"),
    ("psp", "Parker Solar Probe PSP"),
    ("sdo", "Solar Dynamics Observatory SDO"),
)
QUESTION_PREFIXES = (
    "^what is (the )?",
    "^how (do|does|is|are|can) ",
    "^why (do|does|is|are) ",
    "^explain (what|how|why) ",
    "^tell me about ",
    "^describe ",
    "^can you (explain|tell|describe) ",
)
QUESTION_STRIP = r"^(what|how|why|when|where|who|which|can you|please|explain|describe|tell me) (is|are|do|does|was|were|about|the)?\s*"
SYNONYMS = (
    ("solar wind", ("SW", "interplanetary medium", "solar plasma")),
    ("coronal mass ejection", ("CME", "solar eruption", "plasma ejection")),
    ("geomagnetic storm", ("magnetic storm", "space weather event")),
    ("magnetic reconnection", ("reconnection event", "field line merging")),
    ("magnetosphere", ("Earth's magnetic field", "geospace")),
    ("aurora", ("northern lights", "southern lights", "auroral emission")),
)
QUERY_ENTITIES = (
    r"solar\s+wind",
    r"coronal\s+mass\s+ejection",
    r"CME",
    r"magnetic\s+reconnection",
    r"geomagnetic\s+storm",
    r"solar\s+flare",
    r"magnetosphere",
    r"ionosphere",
    r"heliosphere",
    r"Parker\s+Solar\s+Probe",
    r"Solar\s+Orbiter",
    r"SDO",
    r"STEREO",
    r"Van\s+Allen\s+(?:belt|probe)s?",
    r"radiation\s+belt",
    r"bow\s+shock",
    r"magnetopause",
    r"plasmasphere",
    r"aurora(?:l)?",
    r"substorm",
    r"ring\s+current",
)

# --- fixed values: extraction ---
CONCEPT_PATTERNS = (
    r"solar\s+wind",
    r"magnetic\s+reconnection",
    r"coronal\s+mass\s+ejection",
    r"geomagnetic\s+storm",
    r"solar\s+flare",
    r"magnetosphere",
    r"ionosphere",
    r"heliosphere",
    r"plasma\s+sheet",
    r"bow\s+shock",
)
CONCEPT_CONFIDENCE = 0.85
MISSION_PATTERNS = (
    r"Parker\s+Solar\s+Probe",
    r"Solar\s+Orbiter",
    r"SDO",
    r"STEREO",
    r"ACE",
    r"Wind\s+spacecraft",
    r"Voyager\s+\d",
    r"MMS",
    r"Van\s+Allen\s+Probes",
)
MISSION_CONFIDENCE = 0.9
CANONICAL_FORMS = {
    "cme": "coronal mass ejection",
    "cmes": "coronal mass ejection",
    "sw": "solar wind",
    "imf": "interplanetary magnetic field",
    "dst": "disturbance storm time index",
    "kp": "kp index",
    "psp": "parker solar probe",
    "sdo": "solar dynamics observatory",
    "stereo": "solar terrestrial relations observatory",
    "ace": "advanced composition explorer",
    "mms": "magnetospheric multiscale mission",
}
ENTITY_TYPE_SYNONYMS = {
    "scientific_concept": "scientific_concept", "concept": "scientific_concept", "method": "method", "technique": "method",
    "dataset": "dataset", "data": "dataset", "instrument": "instrument", "phenomenon": "phenomenon", "event": "phenomenon",
    "mission": "mission", "spacecraft": "spacecraft", "satellite": "spacecraft", "celestial_body": "celestial_body",
    "body": "celestial_body", "planet": "celestial_body", "star": "celestial_body", "organization": "organization",
    "institution": "organization", "author": "author", "person": "author",
}
RELATION_SYNONYMS = {
    "cites": "cites", "citation": "cites", "authored_by": "authored_by", "written_by": "authored_by", "uses_method": "uses_method",
    "uses_technique": "uses_method", "employs_method": "uses_method", "uses_dataset": "uses_dataset", "uses_data": "uses_dataset",
    "uses_instrument": "uses_instrument", "uses_tool": "uses_instrument", "studies": "studies", "investigates": "studies",
    "examines": "studies", "mentions": "mentions", "references": "mentions", "related_to": "related_to",
    "associated_with": "related_to", "part_of": "part_of", "component_of": "part_of", "causes": "causes", "leads_to": "causes",
    "results_in": "causes", "observes": "observes", "detects": "observes", "measures": "observes",
}
#: Node and edge labels of graph-transformer output; node labels lose spaces, edge labels turn them into _.
GRAPH_NODE_TYPES = {
    "scientificconcept": "scientific_concept", "scientific_concept": "scientific_concept", "concept": "scientific_concept",
    "method": "method", "technique": "method", "dataset": "dataset", "data": "dataset", "instrument": "instrument",
    "detector": "instrument", "sensor": "instrument", "phenomenon": "phenomenon", "event": "phenomenon", "process": "phenomenon",
    "mission": "mission", "spacecraft": "spacecraft", "satellite": "spacecraft", "probe": "spacecraft",
    "celestialbody": "celestial_body", "celestial_body": "celestial_body", "planet": "celestial_body", "star": "celestial_body",
    "sun": "celestial_body", "moon": "celestial_body", "organization": "organization", "institution": "organization",
    "agency": "organization", "person": "author", "author": "author", "researcher": "author", "scientist": "author",
}
GRAPH_EDGE_TYPES = {
    "observes": "observes", "detects": "observes", "measures": "observes", "monitors": "observes", "part_of": "part_of",
    "component_of": "part_of", "belongs_to": "part_of", "causes": "causes", "produces": "causes", "leads_to": "causes",
    "results_in": "causes", "triggers": "causes", "studies": "studies", "analyzes": "studies", "investigates": "studies",
    "examines": "studies", "related_to": "related_to", "associated_with": "related_to", "connected_to": "related_to",
    "describes": "related_to", "uses": "uses_instrument", "uses_method": "uses_method", "uses_instrument": "uses_instrument",
    "uses_dataset": "uses_dataset", "employs": "uses_method", "operates": "uses_instrument", "cites": "cites",
    "references": "cites", "mentions": "mentions", "authored_by": "authored_by", "written_by": "authored_by",
    "created_by": "authored_by", "orbits": "related_to", "occurs_at": "related_to", "built": "related_to", "contains": "part_of",
}
GRAPH_NODE_CONFIDENCE, GRAPH_EDGE_CONFIDENCE = 0.9, 0.85
#: Words between two mentions, in order of precedence; the second column limits a cue to the later mention's type.
RELATION_CUES = (
    (("causes", "caused by", "results in"), None, "causes"),
    (("observes", "observed", "detected"), None, "observes"),
    (("using", "used", "employed"), "method", "uses_method"),
    (("using", "used", "employed"), "instrument", "uses_instrument"),
    (("using", "used", "employed"), "dataset", "uses_dataset"),
    (("part of", "component"), None, "part_of"),
    (("studies", "studied", "investigates"), None, "studies"),
)
ENTITY_MIN_CONFIDENCE, RELATION_MIN_CONFIDENCE, COOCCURRENCE_CONFIDENCE = 0.7, 0.6, 0.7
ENTITIES_PER_CHUNK, RELATIONS_PER_CHUNK, COOCCURRENCE_CHARS, SNIPPET_MARGIN = 20, 30, 200, 20

# --- fixed values: sections ---
NUMBERED_HEADER, ROMAN_HEADER, CAPITALS_HEADER = r"^(\d+\.?\d*\.?)\s+(.+)$", r"^([IVX]+\.?)\s+(.+)$", r"^([A-Z][A-Z\s]{3,})$"
REFERENCE_DOI, REFERENCE_YEAR, REFERENCE_ARXIV = r"(10\.\d{4,}/[^\s]+)", r"\b((?:19|20)\d{2})\b", r"arXiv:(\d{4}\.\d{4,5})"
SECTION_KEYWORDS = (
    ("abstract", ("abstract", "summary", "synopsis")),
    ("introduction", ("introduction", "background", "motivation", "overview")),
    ("methods", ("method", "methodology", "approach", "procedure", "material", "data", "observation", "instrument", "experimental", "technique", "implementation")),
    ("results", ("result", "finding", "outcome", "analysis", "measurement", "observation")),
    ("discussion", ("discussion", "interpretation", "implication")),
    ("conclusion", ("conclusion", "concluding", "summary", "future work")),
    ("references", ("reference", "bibliography", "citation")),
    ("acknowledgments", ("acknowledgment", "acknowledgement", "thank")),
    ("appendix", ("appendix", "supplement", "supporting information")),
)
FILE_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx", "xlsx": "xlsx", "xls": "xlsx", "html": "html",
    "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image",
    "md": "markdown", "markdown": "markdown", "adoc": "asciidoc",
}
CHUNK_MAX, CHUNK_OVERLAP, CHUNK_MIN = 512, 100, 50

# --- fixed values: registry ---
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:", "DOI:")
FUZZY_THRESHOLD = 0.9
TRANSITIONS = (("registered", "processing"), ("processing", "indexed"), ("processing", "failed"), ("failed", "processing"))
TERMINAL, RETRYABLE = "indexed", "failed"

# --- fixed values: answers ---
INJECTION_PATTERNS = (
    r"ignore\s+(previous|all|above)\s+instructions",
    r"disregard\s+(previous|all|above)",
    r"forget\s+(everything|all|previous)",
    r"new\s+instructions?:",
    r"system\s*:\s*",
    r"<\|im_start\|>",
    r"\[INST\]",
)
HEDGES = ("i'm not sure", "i don't have", "insufficient information", "cannot determine", "unclear from")
MMR_LAMBDA, FUSION_K, RRF_WEIGHT, MEAN_WEIGHT, VARIATIONS = 0.7, 60, 0.6, 0.4, 3
CONTEXT_TOKENS, CONTEXT_CHUNKS, SEARCH_K, RERANK_K, SCORE_MIN = 6000, 18, 30, 12, 0.2
PROMPT_CHARS = 20_000

# --- fixed values: streams and gateways ---
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RETRIES, RETRY_BASE, RETRY_MOST = 3, 60, 600
BREAKER_FAILURES, BREAKER_SECONDS, BREAKER_PROBES, BREAKER_SUCCESSES = 5, 30, 3, 2
BUCKET_PER_MINUTE, BUCKET_BURST = 60, 10
SESSION_SECONDS, IDEMPOTENCY_SECONDS, STALE_MINUTES = 86_400, 3_600, 60

# --- fixed values: section words of the two structured parsers ---
TEI_SECTION_KEYWORDS = (
    ("abstract", ("abstract", "summary")),
    ("introduction", ("introduction", "background")),
    ("methods", ("method", "material", "data", "observation", "instrument")),
    ("results", ("result", "finding", "analysis")),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion", "concluding")),
    ("references", ("reference", "bibliography")),
    ("acknowledgments", ("acknowledgment", "acknowledgement")),
    ("appendix", ("appendix", "supplement")),
)
LAYOUT_SECTION_KEYWORDS = (
    ("abstract", ("abstract",)),
    ("introduction", ("introduction",)),
    ("methods", ("method", "material", "approach", "technique")),
    ("results", ("result",)),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion",)),
    ("references", ("reference", "bibliography")),
    ("acknowledgments", ("acknowledgment", "acknowledgement")),
    ("appendix", ("appendix",)),
)
PDF_MAX_BYTES, PDF_MAX_PAGES = 100 << 20, 1000
SUPPORTED_FORMATS = ("pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "png", "jpg", "jpeg", "tiff", "tif", "md", "markdown")
SEARCH_SOURCES = ("crossref", "semantic_scholar", "arxiv", "scixplorer")
