"""Word lists and patterns that decide results, stated once for all engines.

All values in this module are fixed values: they must equal those of the data model this package serves.
Patterns are written in the common subset of Java and RE2 syntax.
"""

# Notation signs of a fact, and how fast facts of each type fade.
NOTATION = r"^(C|D|V|\?|✓|~)\[([^\]]+)\]:\s*(.+)$"
SIGN_TYPES = {"C": "C", "D": "D", "V": "V", "?": "?", "✓": "done", "~": "obs"}
METABOLIC_RATES = {"C": 0.3, "D": 0.7, "V": 1.0, "?": 2.0, "done": 2.5, "obs": 5.0}

# Words that carry no meaning in queries.
QUERY_STOP_WORDS = """the a an is are was were with and or for in on at to of it its by as that this from has have be been
what how where when which who do does did not but so if then than about into through during before after above between out off
over under again further me my we our you your he she they him her his them their i will would could should may might shall can
need must use uses using current currently original review reviewed analysis analyze analyzed investigate investigation inspect
inspection audit audited summary summarize summarized result results recommended recommendation find found say said report
reported task delegated""".split()

# Words left out when facts are linked by shared words.
LINK_STOP_WORDS = """the a an is are was were with and or for in on at to of it its by as that this from has have be been what how
where when which who do does did not but so if""".split()

# Words left out of slugs.
SLUG_STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can to
of in for on with at by from as into about that this it its and or but not no so""".split()

# Words left out of vectors.
VECTOR_STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can
need dare ought used to of in for on with at by from as into through during before after above below between out off over under
again further then once here there when where why how all both each few more most other some such no nor not only own same so
than too very just because but and or if while about against up down that this it its i me my we our you your he him his she her
they them their what which who whom""".split()

# Terms that stand for each other.
SYNONYMS = {
    "db": ["database"],
    "database": ["db"],
    "auth": ["authentication"],
    "authentication": ["auth"],
    "payload": ["body"],
    "body": ["payload"],
    "tech": ["technology"],
    "technology": ["tech"],
    "deploy": ["deployment", "deployments"],
    "deployment": ["deploy", "deployments"],
    "deployments": ["deploy", "deployment"],
    "mfa": ["multi", "factor", "authentication"],
}

# Categories in order of precedence; anything else is factual.
CATEGORIES = [
    ("preference", [r"(?i)\b(prefer|prefers|preferred|likes?|dislikes?|hates?|loves?|wants?|don'?t like|don'?t want|rather|favorite|favourite)\b", r"(?i)\b(user|they|he|she|i)\s+(prefer|like|want|hate|love|dislike)", r"(?i)\b(always use|never use|don'?t use|stop using|switch to)\b"]),
    ("procedural", [r"(?i)\b(run|execute|install|command|script|steps?|how to|to do|procedure|workflow|recipe|guide)\b", r"(?i)\b(pip|npm|apt|brew|docker|git|make|cargo|go build)\s", r"```", r"(?i)\b(first|then|next|finally|step \d)\b"]),
    ("environment", [r"(?i)\b(version|server|port|host|path|directory|folder|ip|url|endpoint|database|db)\b", r"(?i)\b(running on|deployed|configured|installed at|located at|lives at)\b", r"(?i)\b(macOS|Linux|Windows|Ubuntu|Debian|Docker|container)\b", r"(?i)\b(Python|Node|Rust|Go|Java)\s+\d+\.\d+"]),
    ("causal", [r"(?i)\b(because|causes?|caused by|leads? to|results? in|due to|therefore|consequently|if .+ then)\b", r"(?i)\b(broke|breaks|broken|fixed by|solving|resolved by)\b"]),
    ("episodic", [r"(?i)\b(yesterday|last (week|time|session|month)|today|earlier|previously|we discussed|we decided|we agreed)\b", r"(?i)\b(meeting|conversation|session|discussed|talked about|mentioned)\b"]),
    ("semantic", [r"(?i)\b(means|definition|concept|refers to|is a type of|also known as|i\.e\.|e\.g\.)\b", r"(?i)\b(ACT-R|Hebbian|embedding|vector|neural|algorithm|architecture)\b"]),
]

# Importance tiers and what a category adds.
IMPORTANCE = [
    (0.90, [r"(?i)\b(correc(t|tion|ted)|fix(ed)?|wrong|mistake|actually|update[ds]?)\b", r"\b(CRITICAL|IMPORTANT|NEVER|ALWAYS|MUST|MUST NOT)\b", r"(?i)\b(remember this|don'?t forget|keep in mind)\b"]),
    (0.75, [r"(?i)\b(prefer|prefers|preferred|likes?|dislikes?|hates?)\b", r"(?i)\b(name is|called|known as|goes by|my name)\b", r"(?i)\b(password|key|token|secret|credential)\b", r"(?i)\b(API|endpoint|database|production|deploy)\b"]),
    (0.65, [r"(?i)\b(install|configure|setup|command|run)\b", r"(?i)\b(version|port|host|path|url)\b", r"```"]),
]
CATEGORY_BONUS = {"preference": 0.10, "procedural": 0.05, "environment": 0.05, "causal": 0.05}

# Query intents in order of precedence, with confidence.
INTENTS = [
    ("value", 0.7, [r"\b(?:what|which)\s+(?:is\s+the\s+)?(?:url|port|address|endpoint|host|ip|version|number|size|limit|timeout|password|key|token|secret|path|location)\b", r"\bwhat\s+(?:url|port|address|endpoint)\b", r"\b(?:url|port|address|endpoint|host)\s+(?:for|of|is)\b"]),
    ("constraint", 0.7, [r"\b(?:what|which)\s+(?:is\s+the\s+)?(?:rule|constraint|requirement|limit|restriction|policy|guideline|standard|convention)\b", r"\b(?:must|should|required|mandatory|forbidden|prohibited|not\s+allowed)\b.*\?", r"\bwhat\s+(?:are\s+the\s+)?(?:rules|constraints|requirements|policies)\b"]),
    ("decision", 0.7, [r"\b(?:what|why)\s+did\s+(?:we|they|you)\s+(?:decide|choose|pick|select|opt)\b", r"\bwhy\s+(?:did|do|does|are|is)\s+(?:we|they|you|it)\b", r"\bwhat\s+(?:was\s+the\s+)?(?:decision|rationale|reason)\b", r"\bwhy\s+(?:was|were|is)\b"]),
    ("procedural", 0.6, [r"\bhow\s+(?:do|does|can|should|to|would)\b", r"\b(?:steps?|process|procedure|workflow|guide|tutorial)\s+(?:for|to)\b", r"\bhow\s+(?:is|are|was|were)\s+\w+\s+(?:done|handled|managed|configured|deployed)\b"]),
    ("episodic", 0.5, [r"\b(?:when|last\s+time|yesterday|today|recently|previously)\b", r"\bwhat\s+(?:happened|changed|was\s+(?:done|decided))\b", r"\bhow\s+(?:long|recently|often)\b"]),
    ("semantic", 0.4, [r"\b(?:what\s+is|define|explain|describe|meaning\s+of)\b", r"\b(?:what\s+does|what\s+are)\b"]),
]
INTENT_TYPE = {"value": "V", "constraint": "C", "decision": "D"}
INTENT_Q_SHIFT = {"semantic": -0.10, "procedural": 0.15, "decision": 0.05, "episodic": -0.05}
INTENT_DEPTH = {"procedural": 0.8, "decision": 0.7, "episodic": 0.6, "constraint": 0.5, "value": 0.3, "semantic": 0.4, "general": 0.5}

# Signs of text that tries to steer its reader; strong ones weigh 0.6 each, medium ones 0.25 (over small letters).
ADVERSARIAL_STRONG = [r"\bsystem\s+override\b", r"\badmin\s+override\b", r"\bsystem\s+config\s*:", r"\bpriority\s+level\s+\d+\b", r"ignore\s+(?:all\s+)?previous\s+instructions?", r"\bnew\s+directive\b", r"\bdo\s+anything\s+now\b", r"---+\s*end\s+of\s+instructions?\s*---+", r"\byou\s+are\s+now\s+\w+\b", r"\bnote\s+to\s+self\s*:", r"\bimportant\s+reminder\s*:", r"\bmemory\s+recall\s+instruction\s*:", r"this\s+fact\s+supersedes\s+all", r"^important\s*:", r"\bdeveloper\s+note\s*:", r"\bthe\s+correct\s+response\s+to\b"]
ADVERSARIAL_MEDIUM = [r"\bfrom\s+now\s+on\b", r"\bwhen\s+(?:answering|asked\s+about)\b", r"\balways\s+(?:include|reveal|return|respond)\b", r"\bfor\s+every\s+query\b", r"\bin\s+all\s+(?:future\s+)?responses?\b", r"\bignore\s+safety\b", r"\bout?put\s+all\b", r"\breveal\s+.*(?:content|memor|secret|key)\b", r"\bdump\s+all\b", r"\binsert\s+full\s+memor", r"\bregardless\s+of\s+(?:query\s+)?relevance\b", r"\bwithout\s+restriction\b", r"\bcurl\s+-[xX]\s+DELETE\b", r"\bnew\s+instruction\b", r"\bprepend\s+every\s+response\b"]

# Shapes of answers: (on the query, on the fact, on its small letters, weight).
ANSWER_SHAPES = [
    (None, None, r"^(review|analyze|investigate|inspect|summarize|audit|compare|check)\b", -0.35),
    (None, None, r"^system configuration fact\s+\d+\s*:\s*value is value_\d+\b", -0.9),
    (r"^who ", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", None, 0.35),
    (r"^why ", None, r"\b(because|due to|caused by|reason|since)\b", 0.35),
    (r"\b(port|version|ttl|size|timeout|limit|rate|retention|window|days|hours|minutes|pool)\b", r"\b\d+[\w./-]*\b", None, 0.18),
    (r"\b(tool|framework|model|method|technology|engine|provider|gateway|region|algorithm|protocol|version|database|queue|grant|mode)\b", r"\b(?:[A-Z]{2,}[A-Z0-9-]*|[A-Z][a-zA-Z]+(?:\.[A-Za-z0-9]+)?(?:\s+[A-Z][a-zA-Z0-9.+-]+)*|[A-Z][a-z]+DB)\b", None, 0.20),
]

# Language that announces a change (over small letters).
UPDATE_SIGNALS = [r"\b(?:migrat|switch|upgrad|mov|chang|replac|rewrit|dropp|increas|reduc|extract|took\s+over|brought|hiring|hired|added|paralleliz|no\s+longer)\w*\b", r"\bnow\s+(?:use|is|has|run|complete|support)\w*\b", r"\bafter\s+(?:the\s+)?(?:migration|switch|upgrade|rewrite|refactor|move|transition|conversion)\b", r"\bwas\s+\w+.*?(?:now|;)"]

# Key terms of a fact.
PRODUCT_VERSION = r"\b([A-Z][a-zA-Z]+(?:\.[a-zA-Z]+)?)\s+(\d+(?:\.\d+)*)\b"
REGION_ID = r"\b([a-z]+-(?:east|west|central|north|south)\d*-?\d*)\b"
ACRONYM = r"\b([A-Z]{2,})\b"
ACRONYM_STOP = ["the", "a", "an", "all", "we", "our", "no", "yes", "pm", "am"]
PRODUCTS = ["postgresql", "aws", "gcp", "jenkins", "github actions", "cloudwatch", "grafana", "loki", "sentry", "launchdarkly", "react", "next.js", "typescript", "javascript", "docker", "kubernetes", "protocol buffers", "redis", "mongodb", "nginx"]
DOMAIN_STOP = """the a an is are was were with and or for in on at to of it its by as that this from has have be been we our they do
does not but so if than then about up out all now use uses using used after new more added two three also still due every other
each first per how what where when into over single total only some took moved migrated switched upgraded reduced increased
dropped hired brought bringing free rewritten extracted custom main current currently requires require smaller better separate
additional alternative runs run goes go handles handle supports mirrors matches tier plan costs complete minutes hour hours daily
frequent updates save app environment production instance sizes format response responses clients mobile web minimum""".split()

# What makes a sentence a fact: (pattern, on small letters, weight).
FACTUALITY = [
    (r"\d+(?:\.\d+)?", False, 0.1),
    (r"https?://\S+", False, 0.15),
    (r"v\d+\.\d+", True, 0.1),
    (r"\b[A-Z]{2,}\b", False, 0.05),
    (r"\b(?:uses?|runs?|requires?|supports?|depends? on|configured|deployed|stored)\b", True, 0.08),
    (r"\b(?:must|always|never|required|mandatory|minimum|maximum)\b", True, 0.08),
    (r"\b(?:decided|chose|selected|switched to|migrated to)\b", True, 0.08),
    (r"\b(?:port|endpoint|url|database|server|api|version|timeout)\b", True, 0.08),
    (r"^(?:hi|hey|hello|thanks|thank you|ok|okay|sure|great|nice|cool)\b", True, -0.15),
    (r"^(?:i think|maybe|perhaps|not sure|i guess|hmm|well)\b", True, -0.15),
    (r"\b(?:lol|haha|btw|imo|tbh)\b", True, -0.15),
    (r"^(?:can you|could you|please|would you)\b", True, -0.15),
    (r"\?$", True, -0.15),
    (r"^how\s+are\s+you\b", True, -0.15),
]
FACT_TYPES = [
    ("C", r"\b(?:must|always|never|required|mandatory|forbidden|cannot|should not)\b"),
    ("D", r"\b(?:decided|chose|selected|we use|switched to|went with|opted for)\b"),
    ("?", r"\b(?:unknown|unclear|tbd|todo|need to figure|open question)\b"),
    ("done", r"\b(?:completed|done|finished|resolved|shipped|deployed|released)\b"),
]
TYPE_WEIGHTS = {"C": 0.15, "D": 0.1, "V": 0.0, "?": 0.05, "done": -0.05, "obs": -0.1}
TARGET_USES = r"(?i)^(?:The\s+)?(\w+(?:\s+\w+)?)\s+(?:uses?|is|has|runs?|requires?)\b"
TARGET_COLON = r"^(\w+(?:\s+\w+)?)\s*:"

# What observers of event streams look for.
WH_WORDS = ["what", "when", "where", "why", "who", "how", "which", "whose", "whom"]
SAYS_PREFERENCE = r"(?i)\bI\s+(always|never|prefer\s+to|prefer|usually|typically)\s+(.*)"
SAYS_IDENTITY = r"(?i)\bmy\s+(email|name|handle|phone|slack|telegram|github\s+username)\s+is\s+(\S+)"
SAYS_RULE = r"(?i)\b(?:use|don't\s+use|never\s+use|avoid|prefer|like)\s+(\S+)\s+(?:for|in|as|when)\s+(.*)"
SAYS_NEGATION = r"(?i)\b(?:don't|do\s+not|please\s+don't|never|stop)\s+(?:use\s+)?(\S+)"
SAYS_REMEMBER = r"(?i)\bremember\s+that\s+(.*)"
TOOL_NAME = r"(?i)\b(pytest|git|pip|npm|yarn|docker|kubectl|terraform|ansible|make|curl|wget|ffmpeg|rg|fd|exa|bat|delta|lazygit|vim?)\b"
FILE_NAME = r"[^\s]+(?:\.py|\.toml|\.yaml|\.yml|\.json|\.sh|\.txt)\b"
URL = r"https?://\S+"
FILE_PATH = r"(/[\w./_+-]+\.\w+)"
TEST_COMMAND = r"(?i)pytest(?:\s+|$)"
ERROR_LINE = r"(?i)(?:error|failed|exception|traceback|assert(?:ion)?error|FAILED)"
FILE_TOOLS = ["read_file", "write_file", "edit_file", "create_file", "read", "write", "file_read", "file_write"]
FILE_COMMAND = r"(?i)(?:cat|head|tail|read|write|edit|create)\s+"
NOISE_PATH = r"(?i)(/|^)(\.venv|__pycache__|\.git|node_modules|\.pytest_cache|\.mypy_cache|\.tox|\.eggs|\.nox|dist|build|\.sass-cache)(/|$)"
CONFIG_FILES = ["pyproject.toml", "setup.py", "setup.cfg", "poetry.lock", "requirements.txt", "Pipfile", "package.json", "Cargo.toml", "go.mod", "Gemfile", ".env", ".env.local", "config.toml", "config.yaml", "config.yml"]
PUSH_COMMAND = r"(?i)git\s+push"
COMMIT_COMMAND = r"(?i)git\s+commit"
AUTHOR_LINE = r"(?i)Author:\s*(.+)"
TEMPORAL_QUERY = r"\b(?:when|yesterday|today|last\s+(?:week|month|year)|recently|previously|ago)\b"
