"""The extraction contract as chained regex rewrites, rendered as DuckDB SQL.

Only used to build the oracle SQL strings; nothing here runs a query, and the
engine's own extraction (``functions.markup``) shares no pattern with it. The
rewrites hold for pages with flat tags, as the given ones are. Patterns stay
inside RE2: no look-around, no back-references.
"""

from __future__ import annotations

import re

NL = "\n"

# Named character entities decoded, ``&amp;`` last so that
# ``&amp;lt;`` becomes ``&lt;`` (one decoding pass).
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&sect;", "§"), ("&deg;", "°"),
    ("&times;", "×"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"),
    ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"),
    ("&ntilde;", "ñ"), ("&amp;", "&"),
]
# Marker of the rule that decodes every numeric entity (&#8217; and &#x2019;).
NUMERIC = "numeric:"

# One pass drops the head, scripts, styles and comments.
DROP_BLOCKS = [
    (r"(?is)<head( [^>]*)?>.*?</head>|<script( [^>]*)?>.*?</script>|<style( [^>]*)?>.*?</style>|<!--.*?-->", ""),
]

_BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|tr|table|thead|tbody|article|nav|section|header|footer|main|body|html|title|blockquote|pre"

BREAKS = [
    (rf"(?i)<br( [^>]*)?/?>|</?({_BLOCK_TAGS})( [^>]*)?>", NL),
]

STRIP_TAGS = [(r"<[^>]*>", "")]

SPACES = [
    (r"[ \t\r\f]+", " "),
    (r" *\n[ \n]*", NL),
    (r"^[ \n]+|[ \n]+$", ""),
]

INLINE_SPACES = [
    (r"[ \t\r\f\n]+", " "),
    (r"^ +| +$", ""),
]

# Attribute values in one quoting style: href, src and alt of links and images,
# single-quoted or bare, become double-quoted. Twice, as an image has two of them.
_ATTR = r"(?is)(<(?:a|img)\s(?:[^>]*\s)?(?:href|src|alt)\s*=\s*)"
QUOTE_RULES = 2 * [(_ATTR + r"'([^'\"]*)'", '$1"$2"'), (_ATTR + r"""([^\s"'>]+)""", '$1"$2"')]

# Markdown: links, images, headings, list items and table cells are kept.
MARKDOWN_REWRITES = (
    QUOTE_RULES
    + [(r'(?is)<a\s[^>]*href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
       (r'(?is)<img\s[^>]*alt\s*=\s*"([^"]*)"[^>]*\ssrc\s*=\s*"([^"]*)"[^>]*>', "![$1]($2)"),
       (r'(?is)<img\s[^>]*src\s*=\s*"([^"]*)"[^>]*\salt\s*=\s*"([^"]*)"[^>]*>', "![$2]($1)"),
       (r'(?is)<img\s[^>]*src\s*=\s*"([^"]*)"[^>]*>', "![]($1)")]
    + [(rf"(?i)<h{n}( [^>]*)?>", NL + "#" * n + " ") for n in range(1, 7)]
    + [(r"(?i)<li( [^>]*)?>", NL + "* "),
       (r"(?i)<t[dh]( [^>]*)?>", "| ")]
)

# Entities are literal replacements (no regex engine pass); the marker tells
# both renderers to use a plain string replace.
LITERAL = "literal:"
ENTITY_RULES = [(NUMERIC, ""), *((LITERAL + k, v) for k, v in ENTITIES)]

TEXT_RULES = DROP_BLOCKS + BREAKS + STRIP_TAGS + ENTITY_RULES + SPACES
MARKDOWN_RULES = DROP_BLOCKS + MARKDOWN_REWRITES + BREAKS + STRIP_TAGS + ENTITY_RULES + SPACES
INLINE_RULES = STRIP_TAGS + ENTITY_RULES + INLINE_SPACES

TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
H1_RE = r"(?is)<h1[^>]*>(.*?)</h1>"
ARTICLE_RE = r"(?is)<article[^>]*>(.*?)</article>"
BODY_RE = r"(?is)<body[^>]*>(.*?)</body>"
NAV_RE = r"(?is)<nav[^>]*>.*?</nav>"
LINK_RE = r'(?is)<a\s[^>]*href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'   # after QUOTE_RULES


def lit(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)`` pieces."""
    parts = s.split("\n")
    q = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(q) if len(q) > 1 else q[0]


def _rep(r: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", r)


def numeric(expr: str) -> str:
    """Numeric character entities, decoded piece by piece."""
    num = "regexp_extract(p, '^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});', 1)"
    code = (f"CASE WHEN lower({num}[1]) = 'x' THEN try_cast('0x' || {num}[2:] AS INTEGER) "
            f"ELSE try_cast({num} AS INTEGER) END")
    ok = f"coalesce({code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343, false)"
    return (f"array_to_string(list_transform(string_split({expr}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN {ok} THEN chr(CAST({code} AS INTEGER)) || p[length({num}) + 2:] ELSE '&#' || p END), '')")


def rules(expr: str, rule_list) -> str:
    out = expr
    for pat, rep in rule_list:
        if pat == NUMERIC:
            out = numeric(out)
        elif pat.startswith(LITERAL):
            out = f"replace({out}, {lit(pat[len(LITERAL):])}, {lit(rep)})"
        else:
            out = f"regexp_replace({out}, {lit(pat)}, {lit(_rep(rep))}, 'g')"
    return out


def extract(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, {group})"
