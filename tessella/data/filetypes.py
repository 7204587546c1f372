"""Extension sets, naming ladder, ignore list, languages, thresholds."""

# First matching set wins, so json, xml and yaml are code.
CATEGORIES = {
    "image": "jpg jpeg png gif bmp webp svg ico tiff tif",
    "document": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp md",
    "audio": "mp3 wav flac aac ogg wma m4a aiff",
    "video": "mp4 avi mkv mov wmv flv webm m4v",
    "archive": "zip rar 7z tar gz bz2 xz",
    "code": ("py js ts java c cpp h hpp cs go rb php html css json xml yaml yml sql sh bat rs "
             "swift kt scala r lua pl pm dart vue jsx tsx"),
    "config": "json yaml yml xml ini cfg conf toml env",
}
# The rule condition "file_type" knows fewer code extensions than the inventory.
RULE_CODE = ("py js ts java c cpp h hpp cs go rb php html css json xml yaml yml sql sh bat")
RULE_TYPES = {"image": "image", "photo": "image", "picture": "image", "document": "document",
              "doc": "document", "audio": "audio", "music": "audio", "video": "video",
              "movie": "video", "archive": "archive", "compressed": "archive", "code": "code",
              "programming": "code"}

# Ordered ladder: (style, pattern on the name without extension).
NAMING = [
    ("snake_case", r"^[a-z]+(_[a-z0-9]+)+$"),
    ("kebab-case", r"^[a-z]+(-[a-z0-9]+)+$"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"),
    ("camelCase", r"^[a-z][a-zA-Z0-9]*$"),
    ("UPPER_SNAKE_CASE", r"^[A-Z_][A-Z0-9_]*$"),
    ("date_prefix", r"^\d{4}[-_]?\d{2}[-_]?\d{2}"),
    ("numbered_suffix", r"^.*[._-]\d+$"),
    ("flat", r"^[a-zA-Z0-9]+$"),
]
TEST_HINTS = ["test", "tests", "spec", "specs", "__tests__", "unittest"]
DOC_HINTS = ["readme", "license", "changelog", "todo", "contributing"]

IGNORED = [r"\.git", "node_modules", "__pycache__", r"\.venv", "venv", r"\.idea", r"\.vscode",
           "dist", "build", "target", r"\.pyc$"]

SIZE_BUCKETS = [(1024, "<1KB"), (1024 ** 2, "1KB-1MB"), (10 * 1024 ** 2, "1MB-10MB"),
                (100 * 1024 ** 2, "10MB-100MB")]
LARGEST_BUCKET = ">100MB"

LANGUAGES = {"py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "c": "C",
             "cpp": "C++", "cs": "C#", "go": "Go", "rb": "Ruby", "php": "PHP", "rs": "Rust",
             "swift": "Swift", "kt": "Kotlin", "scala": "Scala", "r": "R", "lua": "Lua",
             "dart": "Dart", "vue": "Vue", "html": "HTML", "css": "CSS", "sql": "SQL",
             "sh": "Shell", "bat": "Batch"}
PREFERRED_NAMING = {"Python": "snake_case", "JavaScript": "camelCase", "TypeScript": "camelCase",
                    "Java": "camelCase", "C": "snake_case", "C++": "snake_case",
                    "C#": "PascalCase", "Go": "camelCase", "Ruby": "snake_case",
                    "PHP": "snake_case", "Rust": "snake_case", "Swift": "camelCase",
                    "Kotlin": "camelCase", "Vue": "PascalCase", "CSS": "kebab-case",
                    "HTML": "kebab-case", "Shell": "snake_case", "SQL": "snake_case"}

CATEGORY_DIRS = {"image": "images", "document": "documents", "audio": "audio",
                 "video": "videos", "archive": "archives", "code": "src", "config": "config",
                 "other": "misc"}

SEVERITIES = ["critical", "high", "warning", "info", "suggestion"]
LARGE_FILE = 50 * 1024 * 1024

# Import statements per language family: (extensions, pattern with one group).
IMPORTS = {
    "py": ("py", r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)"),
    "js": ("js ts jsx tsx vue", r"""(?:import|require)\s*\(?['"]([^'"]+)['"]"""),
    "java": ("java kt", r"(?m)^[ \t]*import[ \t]+([\w.]+)"),
    "c": ("c cpp h hpp", r"""(?m)^[ \t]*#include[ \t]+[<"]([^>"]+)[>"]"""),
    "go": ("go", r'"([^"]+)"'),
}

# (category, extensions, folder, label) of the suggested move rules.
SUGGESTED = [
    ("image", "jpg,jpeg,png,gif,bmp,webp,svg,ico", "Images", "图片文件"),
    ("document", "pdf,doc,docx,xls,xlsx,ppt,pptx,txt,rtf,md", "Documents", "文档文件"),
    ("audio", "mp3,wav,flac,aac,ogg,wma,m4a", "Audio", "音频文件"),
    ("video", "mp4,avi,mkv,mov,wmv,flv,webm", "Videos", "视频文件"),
    ("archive", "zip,rar,7z,tar,gz,bz2,xz", "Archives", "压缩包"),
]
