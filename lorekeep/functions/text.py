"""Text functions. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.split() treats as white space.
# The same class is valid in Java and in RE2.
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SPACE = f"[{_SPACE}]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Fixed value: anything that is neither a Unicode word character nor white space.
NON_WORD = r"[^\p{L}\p{N}_\s]"
# Sentence ends.
SENTENCE_END = r"[.!?]+"

# The named character references resolved in page text.
# "&amp;" comes last so that "&amp;lt;" yields "&lt;".
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

# Parts of a page that carry no visible text, up to their end or that of
# the page, then all remaining tags. No pattern here looks at a character more often
# than a few times, however odd the text.
PAGE_NOISE = (
    r"(?is)<title\b.*?(?:</title>|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
)
PAGE_TAG = r"<[^<>]*>"

# Markdown marks and what stands for them, in this order: code fences,
# images and links, headings, quotes and list marks, rules, emphasis and code.
MARKDOWN = [
    (r"(?m)^[ \t]*(?:```|~~~).*$", ""),
    (r"!?\[([^\[\]\n]*)\]\([^)\n]*\)", r"\1"),
    (r"(?m)^[ \t]*#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:>|[-*+]|[0-9]+\.)[ \t]+", ""),
    (r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""),
    (r"\*\*|__|`", ""),
    (r"\*([^*\s][^*\n]*)\*", r"\1"),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text) -> Column:
    """Null or empty, the reference's notion of a missing text."""
    return F.coalesce(F.length(_col(text)), F.lit(0)) == 0


def strip(text) -> Column:
    """Python's ``str.strip()``."""
    return F.btrim(_col(text), F.lit(_SPACES))


def clean_text(text) -> Column:
    """Lower case, punctuation to space, white space collapsed; null becomes empty."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    spaced = F.regexp_replace(lowered, NON_WORD, " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def words(text) -> Column:
    """Python's ``str.split()``: white-space separated pieces without empties."""
    return F.filter(F.split(_col(text), f"{SPACE}+"), lambda w: w != "")


def word_count(text) -> Column:
    """Number of white-space separated pieces."""
    return F.regexp_count(_col(text), F.lit(f"[^{_SPACE}]+"))


def keywords(query) -> Column:
    """Lower-cased words of a question; an empty array for a blank one."""
    return words(F.lower(F.coalesce(_col(query), F.lit(""))))


def terms(text) -> Column:
    """Distinct cleaned words."""
    return F.array_distinct(F.array_remove(F.split(clean_text(text), " "), ""))


def length_score(answer, expected) -> Column:
    """How close the answer's length is to the expected one, in four inclusive bands."""
    ratio = F.length(_col(answer)) / F.nullif(F.length(_col(expected)), F.lit(0))
    return (
        F.when(is_blank(answer) | is_blank(expected), 0.0)
        .when(ratio.between(0.8, 1.2), 1.0)
        .when(ratio.between(0.5, 1.5), 0.8)
        .when(ratio.between(0.3, 2.0), 0.6)
        .otherwise(0.3)
    )


def completeness(answer, expected) -> Column:
    """Share of the expected answer's distinct terms that occur in the answer."""
    wanted = terms(expected)
    found = F.size(F.array_intersect(wanted, terms(answer)))
    # No expected terms give no quotient; the quotient is at most 1 as it is.
    covered = F.coalesce(F.try_divide(found, F.size(wanted)), F.lit(1.0))
    return F.when(is_blank(answer) | is_blank(expected), 0.0).otherwise(covered)


def clarity(answer) -> Column:
    """Mean of a sentence-length band and a structure score.

    A piece after a final full stop counts as a sentence of no words. There is one piece
    more than sentence ends, and the words of all pieces are the runs free of both white
    space and sentence ends, so two counts do. The band is a sum and not a chain of
    conditions, which would count again in every branch.
    """
    text = _col(answer)
    ends = F.regexp_count(text, F.lit(SENTENCE_END))
    mean = F.regexp_count(text, F.lit(f"[^{_SPACE}.!?]+")) / (ends + 1)
    within = lambda low, high: ((mean >= low) & (mean <= high)).cast("int")
    length_part = (F.lit(6) + 2 * within(10, 25) + 2 * within(15, 20)) / 10
    structure = (F.lit(7) + 3 * (ends > 0).cast("int")) / 10
    return F.when(is_blank(text), 0.0).otherwise((length_part + structure) / 2)


def preview(text, size: int = 100) -> Column:
    """The first ``size`` characters, with an ellipsis only when there is more."""
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def page_text(html) -> Column:
    """Visible text of an HTML page."""
    bare = F.regexp_replace(F.regexp_replace(_col(html), PAGE_NOISE, " "), PAGE_TAG, " ")
    resolved = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare)
    return strip(F.regexp_replace(resolved, f"{SPACE}+", " "))


def markdown_text(text) -> Column:
    """Text of a markdown file without its marks."""
    # Java writes a group as $1.
    bare = reduce(lambda c, m: F.regexp_replace(c, m[0], m[1].replace("\\", "$")), MARKDOWN, _col(text))
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def iso_timestamp(ts) -> Column:
    """``datetime.isoformat()`` of a UTC time: no fraction when it is zero."""
    t = _col(ts).cast("timestamp")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, fraction, F.date_format(t, "xxx"))


def seconds_between(start, end) -> Column:
    """Duration in fractional seconds."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)


def stable_id(*parts) -> Column:
    """A repeatable event id, so that replays write the same rows. A missing part keeps its
    place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("\x01")) for p in parts]), 256)
