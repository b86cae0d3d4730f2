"""Text cleaning patterns, chunking and retrieval parameters."""

from __future__ import annotations

# Boilerplate paragraphs and lines, matched from the start, any case, dot matches newline.
BOILERPLATE = [
    r"^(Here are|Here is|These are).*(extracted|key points|summary|facts).*:?\s*$",
    r"^(Based on the provided text|Based on the text).*(summarize|answer).*:?\s*$",
    r"^(I will summarize|I'll provide a summary).*",
    r".*You didn't ask any specific questions.*",
    r".*Please let me know if you have any specific questions.*",
    r".*If you would like me to continue summarizing.*",
    r".*It appears that the text has been cut off.*",
    r"^(The text|This chapter|The chapter|The section|This section) (discusses|describes|highlights|explains|provides|focuses on|also notes|also mentions|concludes by noting).*",
    r"^(The main points discussed are|Some key takeaways from the text include|Key points from the text include|Here are the main points|Overall, the text|Overall, this chapter|Therefore, the final answer|In summary).*",
    r"^(Here's a summary|Summary:|Key Points:|Questions:|Here are some key points).*",
]

# Runs of blanks, tabs and characters outside tab, newline, U+0020-7E and U+00A0-FFFF become one
# space; white space cut from both ends.
BLANK_OR_UNPRINTABLE = "[^\\x{0A}\\x{21}-\\x{7E}\\x{A0}-\\x{FFFF}]+"
USABLE = (
    "[\\x{21}-\\x{7E}\\x{A1}-\\x{167F}\\x{1681}-\\x{1FFF}\\x{200B}-\\x{2027}\\x{202A}-\\x{202E}\\x{2030}-\\x{205E}"
    "\\x{2060}-\\x{2FFF}\\x{3001}-\\x{FFFF}]"
)
SPACES = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
SPACE_CLASS = "[ \\t\\n\\r\\f\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
LINE_BREAK = "\\r\\n|[\\n\\r\\f\\x{0B}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
TOKEN = "[a-z0-9]{2,}"

# Chunking.
SEPARATORS = ["\n\n", "\n", ". ", "; ", ": ", ", ", " "]
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
LEAST_CHUNK_CHARS = 40
ID_TEXT_CHARS = 200
ID_LENGTH = 32

# Retrieval.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CANDIDATE_FACTOR = 2
DEFAULT_TOP_K = 5
FINAL_TOP_N = 3
RELEVANCE_CUT = -3.0

# Token budget of the context.
MAX_CONTEXT_TOKENS = 2560
CONTEXT_RESERVE = 100
CHARS_PER_TOKEN = 4
CUT_WITHOUT_BUDGET, CUT_FIRST_LINE = 2000, 8000
TRUNCATION_NOTE = "\n\n[Context truncated because of token limits.]"
NO_CONTEXT = "(No relevant context was found in the knowledge base.)"
