"""Word lists and patterns that results depend on.

Patterns carry (?dU): only a line feed ends a line, and classes are Unicode.
"""

# Words that open a book's front and back matter.
PREFACE_WORDS = ("まえがき", "前書き", "はじめに", "序章", "序論", "はしがき")
AFTERWORD_WORDS = ("あとがき", "後書き", "おわりに", "終章", "結論", "むすび")
INDEX_WORDS = ("索引", "インデックス")
# Order of kinds that start on one page.
KINDS = ("preface", "chapter", "afterword", "index")
# Numerals.
FULL_WIDTH, ASCII = "０１２３４５６７８９", "0123456789"
KANJI_NUMBERS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五")
NUMERALS = "０-９0-9一二三四五六七八九十"
# What may not follow a bare chapter number.
NOT_TITLE = r"[^\d\.\s\\\)]"
# Fixed value: hiragana, katakana and unified kanji.
JAPANESE = "[぀-ゟ゠-ヿ一-鿿]"
# Fixed value: characters that Markdown escapes.
MARKDOWN_SPECIAL = r"([`*{}\[\]()#+!~|-])"
# Fixed value: characters that file names may not have.
NOT_IN_NAMES = r'[/\\:*?"<>|\x00-\x1f\x7f]'
# Images in Markdown (text, path) and as tags (before, path, after).
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
IMG_TAG = r'<img ([^>]*)src="([^"]+)"([^>]*)>'
# Fixed values, in this order: what plain text leaves out of Markdown, and what it puts in its place.
PLAIN_RULES = (
    (r"(?mdU)^#{1,6}\s+", ""),
    (r"(?d)\*\*(.+?)\*\*|__(.+?)__", "$1$2"),
    (r"(?d)\*(.+?)\*|_(.+?)_", "$1$2"),
    (r"(?d)`(.+?)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "[図: $1]"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?mdU)^[-*_]{3,}\s*$", ""),
)
# What becomes _ in file names beside NOT_IN_NAMES, and their most characters.
NAME_BLANKS, NAME_CHARS = "　 ", 80

# Headings of chapters and of other parts.
CHAPTER = rf"(?dU)^第\s*([{NUMERALS}]+)\s*章\s*(.*)$"
NUMBERED = rf"(?dU)^([1-9][0-9]?)({NOT_TITLE}.*)$"
PREFACE = rf"(?dU)^({'|'.join(PREFACE_WORDS)})[\d\s]*$"
AFTERWORD = rf"(?dU)^({'|'.join(AFTERWORD_WORDS)})[\d\s]*$"
INDEX = rf"(?dU)^({'|'.join(INDEX_WORDS)})[\d\s]*$"
ANY_HEADING = rf"(?mdU)^#\s+(?:第\s*[{NUMERALS}]+\s*章|[1-9][0-9]?{NOT_TITLE}|{'|'.join(PREFACE_WORDS + AFTERWORD_WORDS + INDEX_WORDS)})"

# Tables of contents and a syllabus's chapters.
TOC_PAGE = r"(?mdU)^#\s*目次\b"
TOC_ENTRY = rf"(?mdU)第\s*([{NUMERALS}]+)\s*章\s+(.+?)\s+[・\.\s]*(\d+)\s*$"
TOC_PREFACE = rf"(?dU)^#\s+({'|'.join(PREFACE_WORDS)})\s*(\d+)\s*$"
TOC_NUMBERED = rf"(?dU)^#\s+([1-9][0-9]?)({NOT_TITLE}.+?)(?:\s+(\d+))?\s*$"
TOC_SECTION = r"(?dU)^\d+\.\s+.+?(\d+)\s*$"
HEADING_LINE = r"(?dU)^#\s+"
SYLLABUS = rf"(?dU)^第\s*([{NUMERALS}]+)\s*章\s*(.+)"

#: Fixed value: rows of a book that are searched for its table of contents.
TOC_WINDOW = 15
