"""Word lists and constants."""

# Words that say nothing about code.
STOP_WORDS = tuple(
    "a an the is are was were be been being have has had do does did will would shall should may might must can could "
    "i me my we our you your he she it they them their this that these those what which who whom where when why how "
    "not no nor but or and if then else than too very just about above after again all also any because before between "
    "both by each for from get got here in into of on once only other out over own same so some such there through to "
    "under until up want with fix add make use find show change update need like work look way new file files code "
    "implement create".split()
)

# Phrases of questions about process, not code.
META_PHRASES = (
    "bring value",
    "how should we",
    "what should we",
    "should we use",
    "do we need",
    "is it worth",
    "what's our strategy",
    "what is our strategy",
    "summarize recent",
    "summarize the recent",
    "what changed recently",
    "who worked on",
    "when was the last",
    "how long will it",
    "how long would it",
    "estimate the effort",
    "pros and cons",
    "compare the approaches",
    "what do you think",
    "give me an overview",
    "explain the architecture",
    "how does the team",
    "what's the status of",
    "what is the status of",
    "prioritize the",
    "what's the plan for",
    "what is the plan for",
)

# Words that show that a question is about tests.
TEST_WORDS = tuple("test tests testing spec specs unittest pytest jest mocha coverage mock mocks fixture fixtures".split())

# Groups of near-synonyms, one to a line.
SYNONYMS = tuple(
    tuple(line.split())
    for line in """
auth authenticate authentication login signin logon
logout signout logoff
authorize authorization
credential credentials
password passwd
token jwt bearer
endpoint route handler
request req
response resp reply
websocket ws socket
connect connection
disconnect teardown close
reconnect reconnection
retry retries
timeout deadline
ratelimit throttle quota
backpressure backoff
cache caching memoize
invalidate evict expire
database db
query queries
migration migrate
transaction txn
schema ddl
publish publisher produce producer
subscribe subscriber consume consumer
queue topic channel
async asynchronous
concurrent parallel
log logger logging
trace tracing
metric metrics telemetry
exception panic
test spec
mock stub fake
assert expect
config configuration settings
env environment
flag toggle
secret credential
build compile
deploy release rollout
container docker
parse parser parsing
serialize marshal encode
deserialize unmarshal decode
error err
failure fail
list array
map dict dictionary
init initialize initialise setup bootstrap
start startup
stop shutdown
render draw
component widget
event signal
""".strip().splitlines()
)

# Directories that hold code of any subject.
SCAFFOLD_DIRS = tuple("src lib app pkg cmd internal".split())

# File extensions by language.
LANGUAGES = {
    "python": ("py",),
    "javascript": ("js", "mjs", "cjs"),
    "typescript": ("ts",),
    "tsx": ("tsx", "jsx"),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "c++", "hpp", "hxx", "hh", "h++"),
    "csharp": ("cs",),
}

# Fixed values, but for our own state folder: directories of tests, and those never walked.
TEST_DIRS = tuple("tests test __tests__ spec testing".split())
IGNORED_DIRS = tuple(
    ".git .hg .svn node_modules __pycache__ .tox .mypy_cache .pytest_cache venv .venv env vendor .eggs dist build target "
    ".next .nuxt .graphquarry .ruff_cache".split()
)

# Extensions of files that hold no source text.
IGNORED_EXTENSIONS = tuple(
    "pyc pyo so dylib dll exe o a class jar war zip tar gz bz2 png jpg jpeg gif ico svg woff woff2 ttf eot mp3 mp4 avi mov "
    "pdf doc docx xls xlsx ppt pptx lock".split()
)

# Names of generated files and their directories.
GENERATED_SUFFIXES = (".generated.ts", ".generated.js", ".gen.go", ".pb.go", ".pb.rs", "_generated.rs", "_generated.py", ".g.dart", ".freezed.dart")
GENERATED_DIRS = ("/generated/", "/__generated__/", "/.generated/")

# Path segments that lower a file's score, and by how much.
DIR_PENALTIES = {
    -30: ("docs", "doc", "documentation"),
    -50: ("zh-cn", "zh-tw", "ja", "ko", "fr", "de", "es", "pt", "ru", "locale", "locales", "i18n", "translations", "l10n"),
    -40: ("vendor", "node_modules", "third_party", "third-party", "assets", "dist", "build", "out", "generated", ".generated"),
    -15: ("examples", "example", "samples", "sample"),
}
MINIFIED_SUFFIXES = (".min.js", ".min.css", ".bundle.js", ".bundle.css")

# Limits and weights of retrieval.
MAX_TRACED, MAX_SYMBOLS, MAX_FILES, MAX_TESTS, MAX_TRACE_ROWS, MAX_HITS, MAX_DEPTH = 20, 40, 25, 10, 50, 200, 5
MIN_FILE_SCORE, MIN_SYMBOL_SCORE, CUTOFF = 10, 15, 0.25
STOP_RATIO, SPECIFIC_RATIO, FEW_FILES, SYNONYM_FACTOR = 0.30, 0.05, 10, 0.5
MIN_PART, MIN_STEM, MIN_FUZZY = 4, 4, 5

# Per mode files, symbols, paths, depth, steps, tests, snippets, snippet lines.
MODE_LIMITS = {"brief": (8, 15, 3, 2, 10, 5, 0, 0), "focused": (10, 20, 5, 3, 15, 8, 20, 30), "full": (999,) * 8}
