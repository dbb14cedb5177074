"""HTML -> clean HTML / Markdown as ordered rewrites (JVM-side).

A step is one of

* ``(pattern, replacement)``: a regex replace,
* ``('=', search, replacement)``: a plain string replace,
* ``('cut', opener, closer, other)``: removes every stretch from an opener to the
  next closer; an opener without a closer loses only its own tag, and a closer
  without an opener becomes ``other``,
* ``('number', pattern, before, after)``: the n-th match becomes before + n + after,
* ``('trim', characters)``: both ends.

Every step is linear in the text. No pattern looks past the next ``<`` or ``>``
for the end of a tag, the loops are possessive, and ``cut`` splits the text at
its closers first, so it never searches the rest of the text for a closer that
isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unclosed raw text runs to the end of the text, as in a browser.
RAW_TEXT = ("script", "style")
# These lose only their tag when they are not closed: the page goes on behind it.
SECTIONS = ("head", "nav", "footer")

# HTML entities decoded, '&amp;' last.
ENTITIES = (
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)

# How images appear in the output. Mode names, default placeholder.
IMAGE_MODES = ("placeholder", "embedded", "referenced")
IMAGE_PLACEHOLDER = "<!-- image -->"
IMG_TAG = r"(?i)<img\b[^<>]*+>"
DATA_URI = r'(?i)src="data:image/[a-z0-9.+\-]++;base64,[^"<>]*+"'

BLANKS = " \t\n"

# Comments go, but not the image placeholder.
CLEAN_STEPS = [("cut", r"<!--(?! image -->)", r"(?<!<!-- image )-->", "-->")]
CLEAN_STEPS += [(rf"(?is)<{t}\b[^<>]*+>.*?(?:</{t}[^<>]*+>|\z)", "") for t in RAW_TEXT]
CLEAN_STEPS += [("cut", rf"(?i)<{t}\b[^<>]*+>", rf"(?i)</{t}\b[^<>]*+>", "") for t in SECTIONS]
CLEAN_STEPS += [("cut", r'(?i)<div class="ad">', r"(?i)</div\b[^<>]*+>", "</div>")]

TRIM_STEPS = [("trim", BLANKS)]

# A placeholder is one control character (not allowed in HTML) until all tags are gone.
MARK = "\x01"
HIDE_STEPS = [("=", MARK, ""), ("=", IMAGE_PLACEHOLDER, MARK)]

# Tags that become Markdown; all others but links are dropped next.
BLOCK_STEPS = [(rf"(?i)<h{n}\b[^<>]*+>", "\n" + "#" * n + " ") for n in range(1, 7)]
BLOCK_STEPS += [
    (r"(?i)</h[1-6][^<>]*+>", "\n\n"),
    (r"(?i)</?(?:ul|ol)\b[^<>]*+>", "\n\n"),
    (r"(?i)<li\b[^<>]*+>", "\n- "),
    (r"(?i)<p\b[^<>]*+>", "\n\n"),
    (r"(?i)<br\b[^<>]*+>", "\n"),
    (r"(?i)</?(?:b|strong)\b[^<>]*+>", "**"),
    (r"(?i)<(?!/?a\b)[^<>]*+>", ""),
]
# A link keeps its target.
LINK = (r"""(?i)<a\b(?>[^<>]*?\shref\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)'|([^\s"'<>]++)))[^<>]*+>"""
        r"([^<>]*+)</a\b[^<>]*+>")
LINK_STEPS = [
    (LINK, "[$4]($1$2$3)"),
    (r"(?i)</?a\b[^<>]*+>", ""),
]
TEXT_STEPS = [("=", s, r) for s, r in ENTITIES]
TEXT_STEPS += [
    (r"(?<![ \t])[ \t]++\n", "\n"),  # a run of blanks is tried from its start only
    (r"\n{3,}+", "\n\n"),
] + TRIM_STEPS + [("=", MARK, IMAGE_PLACEHOLDER)]


def image_mode_steps(mode: str | None):
    """Steps of an image mode on HTML. ``referenced`` numbers the embedded images
    of a document from 1; images that are references already stay as they are."""
    mode = mode or "placeholder"
    if mode == "placeholder":
        return [(IMG_TAG, IMAGE_PLACEHOLDER)]
    if mode == "embedded":
        return []
    if mode == "referenced":
        return [("number", DATA_URI, 'src="image_', '"')]
    raise ValueError(f"unknown image mode {mode!r}")


# <img> in Markdown: the source as a Markdown image, none without a source.
IMG_STEPS = [
    (r"""(?i)<img\b(?>[^<>]*?\ssrc\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)'|([^\s"'<>]++)))[^<>]*+>""",
     "![image]($1$2$3)"),
]


def markdown_steps(image_mode: str | None = None):
    return CLEAN_STEPS + image_mode_steps(image_mode) + HIDE_STEPS + IMG_STEPS + BLOCK_STEPS + LINK_STEPS + TEXT_STEPS


def html_steps(image_mode: str | None = None):
    return CLEAN_STEPS + image_mode_steps(image_mode) + TRIM_STEPS


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def steps_sql(expr: str, steps) -> str:
    """The rewrite chain as one Spark SQL expression over ``expr``."""
    for step in steps:
        if step[0] == "=":
            expr = f"replace({expr}, {_sql_str(step[1])}, {_sql_str(step[2])})"
        elif step[0] == "trim":
            expr = f"trim(BOTH {_sql_str(step[1])} FROM {expr})"
        elif step[0] == "cut":
            # only the part behind the last closer can hold an unclosed opener
            opener, closer, other = step[1:]
            expr = (f"array_join(reverse(transform(reverse(split({expr}, {_sql_str(closer)})), (p, i) -> "
                    f"CASE WHEN i = 0 THEN regexp_replace(p, {_sql_str(opener)}, '') "
                    f"WHEN p RLIKE {_sql_str(opener)} THEN regexp_replace(p, {_sql_str('(?s)' + opener + '.*')}, '') "
                    f"ELSE concat(p, {_sql_str(other)}) END)), '')")
        elif step[0] == "number":
            pattern, before, after = step[1:]
            expr = (f"array_join(transform(split({expr}, {_sql_str(pattern)}), (p, i) -> "
                    f"if(i = 0, p, concat({_sql_str(before)}, i, {_sql_str(after)}, p))), '')")
        else:
            expr = f"regexp_replace({expr}, {_sql_str(step[0])}, {_sql_str(step[1])})"
    return expr


def to_markdown(html: str, image_mode: str | None = None) -> Column:
    """Markdown of the HTML in the column named ``html``, images in ``image_mode``."""
    return F.expr(steps_sql(f"`{html}`", markdown_steps(image_mode)))


def clean_html(html: str, image_mode: str | None = None) -> Column:
    """The HTML in the column named ``html`` without scripts, sections, comments and ads."""
    return F.expr(steps_sql(f"`{html}`", html_steps(image_mode)))


def apply_image_mode(html: str, mode: str | None) -> Column:
    return F.expr(steps_sql(f"`{html}`", image_mode_steps(mode)))
