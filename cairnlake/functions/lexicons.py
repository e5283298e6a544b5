"""Word lists, patterns and tables the rules depend on.

All of these are fixed values: results are only right when they hold exactly these
entries in exactly this order. Every operator also takes its lexicon as a parameter.
"""

from __future__ import annotations

# Marker patterns per memory type, in tie-break order.
MEMORY_MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b",
        r"\bwe (should|decided|chose|went with|picked|settled on)\b",
        r"\bi'?m going (to|with)\b",
        r"\bbetter (to|than|approach|option|choice)\b",
        r"\binstead of\b",
        r"\brather than\b",
        r"\bthe reason (is|was|being)\b",
        r"\bbecause\b",
        r"\btrade-?off\b",
        r"\bpros and cons\b",
        r"\bover\b.*\bbecause\b",
        r"\barchitecture\b",
        r"\bapproach\b",
        r"\bstrategy\b",
        r"\bpattern\b",
        r"\bstack\b",
        r"\bframework\b",
        r"\binfrastructure\b",
        r"\bset (it |this )?to\b",
        r"\bconfigure\b",
        r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b",
        r"\balways use\b",
        r"\bnever use\b",
        r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b",
        r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b",
        r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b",
        r"\bwe (always|never)\b",
        r"\bfunctional\b.*\bstyle\b",
        r"\bimperative\b",
        r"\bsnake_?case\b",
        r"\bcamel_?case\b",
        r"\btabs\b.*\bspaces\b",
        r"\bspaces\b.*\btabs\b",
        r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b",
        r"\bit worked\b",
        r"\bgot it working\b",
        r"\bfixed\b",
        r"\bsolved\b",
        r"\bbreakthrough\b",
        r"\bfigured (it )?out\b",
        r"\bnailed it\b",
        r"\bcracked (it|the)\b",
        r"\bfinally\b",
        r"\bfirst time\b",
        r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b",
        r"\bdiscovered\b",
        r"\brealized\b",
        r"\bfound (out|that)\b",
        r"\bturns out\b",
        r"\bthe key (is|was|insight)\b",
        r"\bthe trick (is|was)\b",
        r"\bnow i (understand|see|get it)\b",
        r"\bbuilt\b",
        r"\bcreated\b",
        r"\bimplemented\b",
        r"\bshipped\b",
        r"\blaunched\b",
        r"\bdeployed\b",
        r"\breleased\b",
        r"\bprototype\b",
        r"\bproof of concept\b",
        r"\bdemo\b",
        r"\bversion \d",
        r"\bv\d+\.\d+",
        r"\d+x (compression|faster|slower|better|improvement|reduction)",
        r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b",
        r"\bdoesn'?t work\b",
        r"\bnot working\b",
        r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b",
        r"\broot cause\b",
        r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b",
        r"\bthe fix (is|was)\b",
        r"\bworkaround\b",
        r"\bthat'?s why\b",
        r"\bthe reason it\b",
        r"\bfixed (it |the |by )\b",
        r"\bsolution (is|was)\b",
        r"\bresolved\b",
        r"\bpatched\b",
        r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ],
    "emotional": [
        r"\blove\b",
        r"\bscared\b",
        r"\bafraid\b",
        r"\bproud\b",
        r"\bhurt\b",
        r"\bhappy\b",
        r"\bsad\b",
        r"\bcry\b",
        r"\bcrying\b",
        r"\bmiss\b",
        r"\bsorry\b",
        r"\bgrateful\b",
        r"\bangry\b",
        r"\bworried\b",
        r"\blonely\b",
        r"\bbeautiful\b",
        r"\bamazing\b",
        r"\bwonderful\b",
        r"i feel",
        r"i'm scared",
        r"i love you",
        r"i'm sorry",
        r"i can't",
        r"i wish",
        r"i miss",
        r"i need",
        r"never told anyone",
        r"nobody knows",
        r"\*[^*]+\*",
    ],
}

# Sentiment words and signs that a problem was resolved.
POSITIVE_WORDS = (
    "pride proud joy happy love loving beautiful amazing wonderful incredible fantastic brilliant perfect excited "
    "thrilled grateful warm breakthrough success works working solved fixed nailed heart hug precious adore"
).split()
NEGATIVE_WORDS = (
    "bug error crash crashing crashed fail failed failing failure broken broke breaking breaks issue problem wrong "
    "stuck blocked unable impossible missing terrible horrible awful worse worst panic disaster mess"
).split()
RESOLUTION_PATTERNS = [
    r"\bfixed\b",
    r"\bsolved\b",
    r"\bresolved\b",
    r"\bpatched\b",
    r"\bgot it working\b",
    r"\bit works\b",
    r"\bnailed it\b",
    r"\bfigured (it )?out\b",
    r"\bthe (fix|answer|solution)\b",
]

# A line matching any of these is code; (?i) marks the ones that ignore case.
CODE_LINES = [
    r"^\s*[\$#]\s",
    r"(?i)^\s*(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s",
    r"^\s*```",
    r"(?i)^\s*(import|from|def|class|function|const|let|var|return)\s",
    r"^\s*[A-Z_]{2,}=",
    r"^\s*\|",
    r"^\s*[-]{2,}",
    r"^\s*[{}\[\]]\s*$",
    r"(?i)^\s*(if|for|while|try|except|elif|else:)\b",
    r"^\s*\w+\.\w+\(",
    r"^\s*\w+ = \w+\.\w+",
]
SPEAKER_LINES = [r"^>\s", r"(?i)^(Human|User|Q)\s*:", r"(?i)^(Assistant|AI|A|Claude|ChatGPT)\s*:"]

# Topic keywords of a conversation, in tie-break order.
TOPIC_KEYWORDS = {
    "technical": "code python function bug error api database server deploy git test debug refactor".split(),
    "architecture": "architecture design pattern structure schema interface module component service layer".split(),
    "planning": "plan roadmap milestone deadline priority sprint backlog scope requirement spec".split(),
    "decisions": "decided chose picked switched migrated replaced trade-off alternative option approach".split(),
    "problems": "problem issue broken failed crash stuck workaround fix solved resolved".split(),
}

# Folder names and the room each stands for.
FOLDER_ROOMS = {
    "frontend": "frontend",
    "front_end": "frontend",
    "front-end": "frontend",
    "client": "frontend",
    "ui": "frontend",
    "views": "frontend",
    "components": "frontend",
    "pages": "frontend",
    "backend": "backend",
    "back_end": "backend",
    "back-end": "backend",
    "server": "backend",
    "api": "backend",
    "routes": "backend",
    "services": "backend",
    "controllers": "backend",
    "models": "backend",
    "database": "backend",
    "db": "backend",
    "docs": "documentation",
    "doc": "documentation",
    "documentation": "documentation",
    "wiki": "documentation",
    "readme": "documentation",
    "notes": "documentation",
    "design": "design",
    "designs": "design",
    "mockups": "design",
    "wireframes": "design",
    "assets": "design",
    "storyboard": "design",
    "costs": "costs",
    "cost": "costs",
    "budget": "costs",
    "finance": "costs",
    "financial": "costs",
    "pricing": "costs",
    "invoices": "costs",
    "accounting": "costs",
    "meetings": "meetings",
    "meeting": "meetings",
    "calls": "meetings",
    "meeting_notes": "meetings",
    "standup": "meetings",
    "minutes": "meetings",
    "team": "team",
    "staff": "team",
    "hr": "team",
    "hiring": "team",
    "employees": "team",
    "people": "team",
    "research": "research",
    "references": "research",
    "reading": "research",
    "papers": "research",
    "planning": "planning",
    "roadmap": "planning",
    "strategy": "planning",
    "specs": "planning",
    "requirements": "planning",
    "tests": "testing",
    "test": "testing",
    "testing": "testing",
    "qa": "testing",
    "scripts": "scripts",
    "tools": "scripts",
    "utils": "scripts",
    "config": "configuration",
    "configs": "configuration",
    "settings": "configuration",
    "infrastructure": "configuration",
    "infra": "configuration",
    "deploy": "configuration",
}
ROOM_ORDER = (
    "src backend frontend design scripts fixtures testing documentation configuration planning research team meetings costs"
).split()

# Directories and files a scan never enters or reads, and the readable suffixes.
SKIPPED_FOLDERS = (
    ".git node_modules __pycache__ .venv venv env dist build .next coverage .ruff_cache .mypy_cache .pytest_cache "
    ".cache .tox .nox .idea .vscode .ipynb_checkpoints .eggs htmlcov target .dotnet .nuget bin obj"
).split()
SKIPPED_FILES = [".gitignore", "package-lock.json"]
PROJECT_SUFFIXES = (
    ".txt .md .py .js .ts .jsx .tsx .json .yaml .yml .html .css .java .go .rs .rb .sh .csv .sql .toml"
).split()
CONVERSATION_SUFFIXES = ".txt .md .json .jsonl".split()
CONVERSATION_SKIPPED_FOLDERS = (
    ".git node_modules __pycache__ .venv venv env dist build .next tool-results memory"
).split()
PROSE_SUFFIXES = ".txt .md .rst .csv".split()
READABLE_SUFFIXES = ".txt .md .py .js .ts .json .yaml .yml .csv .rst .toml .sh .rb .go .rs".split()

# Emotion and flag signals of the shorthand, in output order.
EMOTION_SIGNALS = {
    "decided": "determ",
    "prefer": "convict",
    "worried": "anx",
    "excited": "excite",
    "frustrated": "frust",
    "confused": "confuse",
    "love": "love",
    "hate": "rage",
    "hope": "hope",
    "fear": "fear",
    "trust": "trust",
    "happy": "joy",
    "sad": "grief",
    "surprised": "surprise",
    "grateful": "grat",
    "curious": "curious",
    "wonder": "wonder",
    "anxious": "anx",
    "relieved": "relief",
    "satisf": "satis",
    "disappoint": "grief",
    "concern": "anx",
}
FLAG_SIGNALS = {
    "decided": "DECISION",
    "chose": "DECISION",
    "switched": "DECISION",
    "migrated": "DECISION",
    "replaced": "DECISION",
    "instead of": "DECISION",
    "because": "DECISION",
    "founded": "ORIGIN",
    "created": "ORIGIN",
    "started": "ORIGIN",
    "born": "ORIGIN",
    "launched": "ORIGIN",
    "first time": "ORIGIN",
    "core": "CORE",
    "fundamental": "CORE",
    "essential": "CORE",
    "principle": "CORE",
    "belief": "CORE",
    "always": "CORE",
    "never forget": "CORE",
    "turning point": "PIVOT",
    "changed everything": "PIVOT",
    "realized": "PIVOT",
    "breakthrough": "PIVOT",
    "epiphany": "PIVOT",
    "api": "TECHNICAL",
    "database": "TECHNICAL",
    "architecture": "TECHNICAL",
    "deploy": "TECHNICAL",
    "infrastructure": "TECHNICAL",
    "algorithm": "TECHNICAL",
    "framework": "TECHNICAL",
    "server": "TECHNICAL",
    "config": "TECHNICAL",
}
DECISION_WORDS = (
    "decided because instead prefer switched chose realized important key critical discovered learned conclusion "
    "solution reason why breakthrough insight"
).split()
SHORTHAND_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into about between through during before after above below up down out off "
    "over under again further then once here there when where why how all each every both few more most other some "
    "such no nor not only own same so than too very just don now and but or if while that this these those it its i "
    "we you he she they me him her us them my your his our their what which who whom also much many like because "
    "since get got use used using make made thing things way well really want need"
).split()

# Name slots in text. {name} is the candidate; used case-insensitively.
DIALOGUE_SLOTS = [r"^>\s*{name}[:\s]", r"^{name}:\s", r"^\[{name}\]", r'"{name}\s+said']
ACTION_SLOTS = [
    r"\b{name}\s+said\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+replied\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+felt\b",
    r"\b{name}\s+thinks?\b",
    r"\b{name}\s+wants?\b",
    r"\b{name}\s+loves?\b",
    r"\b{name}\s+decided\b",
    r"\b{name}\s+wrote\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"\bhi\s+{name}\b",
]
ADDRESS_SLOTS = [r"\bhey\s+{name}\b|\bthanks?\s+{name}\b|\bhi\s+{name}\b"]
PROJECT_SLOTS = [
    r"\bbuilding\s+{name}\b",
    r"\bbuilt\s+{name}\b",
    r"\bship(?:ping|ped)?\s+{name}\b",
    r"\blaunch(?:ing|ed)?\s+{name}\b",
    r"\bdeploy(?:ing|ed)?\s+{name}\b",
    r"\binstall(?:ing|ed)?\s+{name}\b",
    r"\bthe\s+{name}\s+architecture\b",
    r"\bthe\s+{name}\s+pipeline\b",
    r"\bthe\s+{name}\s+system\b",
    r"\bthe\s+{name}\s+repo\b",
    r"\b{name}\s+v\d+\b",
    r"\b{name}\.py\b",
    r"\b{name}-core\b",
    r"\b{name}-local\b",
    r"\bimport\s+{name}\b",
    r"\bpip\s+install\s+{name}\b",
]
VERSION_SLOTS = [r"\b{name}[-v]\w+"]
CODE_FILE_SLOTS = [r"\b{name}\.(py|js|ts|yaml|yml|json|sh)\b"]
PRONOUNS = r"\b(?:she|her|he|him|they|them|their)\b"

# Contexts that make an ambiguous word a person or a concept.
PERSON_CONTEXTS = [
    r"\b{name}\s+said\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+was\b",
    r"\b{name}\s+is\b",
    r"\b{name}\s+called\b",
    r"\b{name}\s+texted\b",
    r"\bwith\s+{name}\b",
    r"\bsaw\s+{name}\b",
    r"\bcalled\s+{name}\b",
    r"\btook\s+{name}\b",
    r"\bpicked\s+up\s+{name}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b",
    r"\b{name}(?:'s|s')\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"^{name}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
]
CONCEPT_CONTEXTS = [
    r"\bhave\s+you\s+{name}\b",
    r"\bif\s+you\s+{name}\b",
    r"\b{name}\s+since\b",
    r"\b{name}\s+again\b",
    r"\bnot\s+{name}\b",
    r"\b{name}\s+more\b",
    r"\bwould\s+{name}\b",
    r"\bcould\s+{name}\b",
    r"\bwill\s+{name}\b",
    r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
]
COMMON_WORDS = (
    "ever grace will bill mark april may june joy hope faith chance chase hunter dash flash star sky river brook lane "
    "art clay gil nat max rex ray jay rose violet lily ivy ash reed sage monday tuesday wednesday thursday friday "
    "saturday sunday january february march july august september october november december"
).split()

# Phrases that classify an encyclopedia extract.
NAME_PHRASES = [
    "given name",
    "personal name",
    "first name",
    "forename",
    "masculine name",
    "feminine name",
    "boy's name",
    "girl's name",
    "male name",
    "female name",
    "irish name",
    "welsh name",
    "scottish name",
    "gaelic name",
    "hebrew name",
    "arabic name",
    "norse name",
    "old english name",
    "is a name",
    "as a name",
    "name meaning",
    "name derived from",
    "legendary irish",
    "legendary welsh",
    "legendary scottish",
]
PLACE_PHRASES = [
    "city in",
    "town in",
    "village in",
    "municipality",
    "capital of",
    "district of",
    "county",
    "province",
    "region of",
    "island of",
    "mountain in",
    "river in",
]

# How a combined session file is cut and named.
SESSION_MARK = "Claude Code v"
RESUME_MARKS = ["Ctrl+E", "previous messages"]
MONTHS = (
    "january february march april may june july august september october november december"
).split()
SHELL_PROMPTS = r"(?i)^(\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"
KNOWN_PEOPLE = "Alice Ben Riley Max Sam Devon Jordan".split()

# Words that are never a name.
NAME_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did "
    "will would could should may might must shall can this that these those it its they them their we our you your i "
    "my me he she his her who what when where why how which if then so not no yes ok okay just very really also "
    "already still even only here there now too up out about like use get got make made take put come go see know "
    "think return print def class import step usage run check find add set list args dict str int bool path file type "
    "name note example option result error warning info every each more less next last first second stack layer mode "
    "test stop start copy move source target output input data item key value returns raises yields self cls kwargs "
    "world well want topic choose human humans people things something nothing everything anything someone everyone "
    "anyone way time day life place thing part kind sort case point idea fact sense question answer reason number "
    "version system hey hi hello thanks thank right let click hit press tap drag drop open close save load launch "
    "install download upload scroll select enter submit cancel confirm delete paste write read search show hide "
    "desktop documents downloads users home library applications preferences settings terminal actor vector remote "
    "control duration fetch agents tools others guards ethics regulation learning thinking memory language "
    "intelligence technology society culture future history science model models network networks training inference"
).split()
