"""Regular expressions, with Unicode classes spelled out so that Java and RE2 read them alike.

Where Java needs possessive quantifiers (to survive very long texts) or RE2
lacks lookaround, there is a form for each, with equal results.

All of them are fixed values: what counts as a word, a placeholder, markup, a
link or a plural rule is the behaviour of the checks.
"""

SPACE = r"\p{Z}\t\n\x0B\f\r"
WORD = r"\p{L}\p{N}_"

PROSE = r"\p{L}[\p{L}\p{M}]*+(?:['\x{2019}\-]\p{L}[\p{L}\p{M}]*+)*+"
PROSE_RE2 = r"\p{L}[\p{L}\p{M}]*(?:['\x{2019}\-]\p{L}[\p{L}\p{M}]*)*"

IDENTIFIER = r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}++\p{Nd}*+|\p{Lu}++\p{Nd}*+|\p{Nd}++"
IDENTIFIER_RE2_SPLIT = r"(\p{Lu})(\p{Lu}\p{Ll})"
IDENTIFIER_RE2 = r"\p{Lu}?\p{Ll}+\p{Nd}*|\p{Lu}+\p{Nd}*|\p{Nd}+"

PLACEHOLDER = rf"%[a-zA-Z0-9_.]+%|%%|\{{\{{[^{{}}]*\}}\}}|\{{[a-zA-Z0-9_.]*\}}|(?<![:{WORD}]):[a-zA-Z_][{WORD}]*+"
SPRINTF = r"%(?:\p{Nd}+\$)?[-+ 0#]?(?:\p{Nd}+|\*)?(?:\.\p{Nd}+)?[bcdeEfFgGosuxX]"
HTML = r"(?s)<!--.*?-->|</?[a-zA-Z][^<>]*+>|&[a-zA-Z][a-zA-Z0-9]*+;|&#x?[0-9a-fA-F]+;"
HTML_RE2 = HTML.replace("*+", "*")
MARKDOWN = rf"(?ms)```.*?```|`[^`]*+`|!\[[^\]]*+\]\([^)]*+\)|\]\([^)]*+\)|^[{SPACE}\x85]{{4,}}[^{SPACE}\x85].*+$"
MARKDOWN_RE2 = MARKDOWN.replace("*+", "*")
URL = (
    rf"(?i)[a-z][a-z0-9+.\-]*+://[^{SPACE}]++|(?:mailto:)?[{WORD}.+\-]++@[{WORD}\-]++(?:\.[{WORD}\-]++)++"
    rf"|(?:^|[{SPACE}])/(?:[{WORD}.\-]++/)++[{WORD}.\-]*+|(?<![{WORD}])[{WORD}\-]+\.(?:php|ya?ml|xml|json|twig|xlf|css|js|ts|md|lock|neon)(?![{WORD}])"
)
URL_RE2_MAIN = rf"(?i)[a-z][a-z0-9+.\-]*://[^{SPACE}]+|(?:mailto:)?[{WORD}.+\-]+@[{WORD}\-]+(?:\.[{WORD}\-]+)+|(?:^|[{SPACE}])/(?:[{WORD}.\-]+/)+[{WORD}.\-]*"

PLURAL_PART = r"(?:[^|]++|\|\|)++"
PLURAL_PART_RE2 = r"(?:[^|]|\|\|)+"
_BOUND = r"-?(?:Inf|\p{Nd}+(?:\.\p{Nd}+)?)"
#: Numbers in braces, or an interval of two bounds in brackets of either direction.
PLURAL_RULE = rf"^[{SPACE}]*(?:\{{[\p{{Nd}},{SPACE}]+\}}|[\[\]][{SPACE}]*{_BOUND}[{SPACE}]*,[{SPACE}]*{_BOUND}[{SPACE}]*[\[\]])[{SPACE}]*"
TRIM = " \t\n\r\0\x0b"

ICU_HINT = rf"\{{\s*[{WORD}]+\s*,\s*(?:plural|select|selectordinal|number|date|time|ordinal|duration|spellout)(?![{WORD}])"
