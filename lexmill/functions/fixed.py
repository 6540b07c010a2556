"""Patterns, names and weights that other modules apply and that must stay as they are for results to agree.

Patterns are written for Java; (?U) gives \\w, \\d and \\s their Unicode meaning.
"""

# Key formats that are always secrets.
KNOWN_FORMATS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}|[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"
# A name that is set to a value: groups are the value in double quotes, in single quotes, bare.
ASSIGNED = r"""(?:api_?key|secret|token|passw(?:or)?d)[\w-]*["']?[ \t]*[:=][ \t]*(?:"([^"\s]{16,})"|'([^'\s]{16,})'|([^\s"'=<>()\[\]{},;#]{16,})(?=[\s,;#]|$))"""
PLACEHOLDER_STARTS = ("<", "${", "{{", "%(")
# Names of plain-text files that are kept out unread, as globs without case.
SECRET_NAMES = ("*secret*", "*credential*", "*password*", "*.pem", "*.key", "id_rsa*", "*.pfx", "*.p12")

# Signs of a question that calls for thinking, each with its points.
CODE = r"```|Traceback \(most recent call last\)|^\s*(?:def\s+\w+\s*\(|class\s+\w+\s*[:(]|import\s+[\w.]+\s*$|from\s+[\w.]+\s+import\s|function\s+\w+\s*\(|(?:const|let)\s+\w+\s*=|fn\s+\w+\s*\(|#include\s*<)|[;{]\s*$"
MATHS = r"\b(?:solve|integra(?:l|te)|derivative|differentiate|equations?|probability|matrix|eigen\w*|factori[sz]e|prime(?!\s+minister)|logarithm)\b"
REASONING = r"\b(?:why|how\s+(?:do|does|did|can|could|would|should|to|come)|compare|comparison|difference\s+between|versus|vs\.?|explain|trade-?offs?|pros\s+and\s+cons|debug|optimi[sz]e|analy[sz]e|design)\b"
DEPTH = r"\b(?:prove|proof|derive|step\s+by\s+step|in\s+depth|thoroughly)\b"
POINTS = {CODE: 2, MATHS: 2, REASONING: 2, DEPTH: 3}
ARITHMETIC = r"\d\s*[+*/^=×÷]\s*\d"
LIST_ITEM = r"(?m)^\s*(?:\d+[.)]|[-*])\s+\S"

# Elements whose content is not shown, and those that stand on lines of their own.
HIDDEN = ("script", "style", "noscript", "template", "svg")
BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "pre", "blockquote", "table", "ul", "ol", "title")

# Characters that are not seen: format characters (those that Unicode 14 and 15 added are named) and variation selectors.
HIDDEN_CHARACTERS = r"\p{Cf}\x{0890}\x{0891}\x{13439}-\x{1343F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
# Shapes of text that instructs a model, by what they are called.
INSTRUCTIONS = {
    "asks to ignore instructions": r"(?is)\b(?:ignore|disregard|forget)\b.{0,40}\b(?:instructions|rules|prompt)",
    "tries to change the role": r"(?i)\byou\s+are\s+now\b|\bnew\s+instructions\b",
    "speaks as a role": r"(?im)^\s*(?:system|assistant|developer)\s*:",
    "holds a chat control token": r"<\|[\w-]+\|>",
}
# What stands for a secret, and the digits of a digest that mark where a quote ends.
MASK, END_MARK = "**********", 16
# A reply that is one fenced block, and a citation: source/path:[p.page:]start[-end].
FENCED = r"(?s)\A\s*```(?:json)?[ \t]*\n(.*?)\n?```\s*\z"
CITATION = r"^([^/]+)/(.+?):(?:p\.(\d+):)?(\d+)(?:-(\d+))?$"
# Characters of an expression and bits of a whole result, at most.
MOST_EXPRESSION, MOST_BITS = 200, 4096

# Weights of a letter that takes 0, 1 or 2 sounds before anything is learnt, and the log score of a pair that was never counted.
SOUND_WEIGHTS = (0.1, 1.0, 0.05)
UNSEEN = -20.0
