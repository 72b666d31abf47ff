"""Text column expressions: segmentation, tokenisation and normalisation.

All functions return ``Column`` expressions evaluated inside whole-stage
codegen (regex, translate, higher-order array functions); none calls Python
per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Arabic diacritics removed by dediacritisation: tanween fath .. sukun
# (U+064B-U+0652), superscript alef (U+0670), and tatweel (U+0640).
DIACRITICS_CLASS = "[\\u064B-\\u0652\\u0670\\u0640]"
DIACRITICS = "".join(chr(c) for c in range(0x064B, 0x0653)) + "\u0670\u0640"
# Alef variants (hamza above, hamza below, madda) mapped to bare alef.
ALEF_VARIANTS = "أإآ"
ALEF_BARE = "ااا"
# Alef maqsura -> yaa, taa marbuta -> haa.
YAA_TAA_FROM = "ىة"
YAA_TAA_TO = "يه"
# Sentence-final punctuation for punctuation segmentation (Latin and Arabic
# full stop, question and exclamation marks, Arabic semicolon, newline).
SENTENCE_END_CHARS = ".!?؟؛\n"
# Clitic markers of segmented (d3tok) forms, rewritten in this order.
CLITIC_REWRITES = (("_+", " +"), ("+_", "+ "))
# ---------------------------------------------------------------------------

# Whitespace exactly as Python's ``str.split()``/``str.strip()`` see it
# (``str.isspace``): derived from that rule, not listed.  In Java regex the
# same set is Unicode White_Space (``\s`` under the ``(?U)`` flag) plus the
# four separators U+001C..U+001F, which is also the fast spelling (a property
# test, not a chain of 29 single characters); every pattern below that uses
# it starts with ``(?U)``.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
UNICODE = "(?U)"
_WS = "\\s\\x{1C}-\\x{1F}"
WS_CLASS = f"[{_WS}]"
NOT_WS = f"[^{_WS}]"
WORD_RUN = "[\\p{L}\\p{M}\\p{N}_]+"
PUNCT_ONE = f"[^{_WS}\\p{{L}}\\p{{M}}\\p{{N}}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace removed
    (a character-set trim, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def has_text(c) -> Column:
    """True when the value holds a non-whitespace character."""
    return _c(c).rlike(UNICODE + NOT_WS)


def blank_to_empty(c) -> Column:
    """Null or whitespace-only text becomes ``''``."""
    c = _c(c)
    return F.when(c.isNull() | ~c.rlike(UNICODE + NOT_WS), F.lit("")).otherwise(c)


def split_lines(c) -> Column:
    """split on newline keeping empty pieces (array, trailing kept)."""
    return F.split(_c(c), "\n", -1)


def split_lines_clean(c) -> Column:
    """F2 as an array: pieces stripped, blanks removed (positions lost)."""
    parts = F.transform(split_lines(c), strip_ws)
    return F.filter(parts, lambda x: x != F.lit(""))


def _class_escape(chars: str) -> str:
    out = []
    for ch in chars:
        if ch in "\\]^-[&":
            out.append("\\" + ch)
        elif ch == "\n":
            out.append("\\n")
        else:
            out.append(ch)
    return "".join(out)


def split_punct(c, end_chars: str = SENTENCE_END_CHARS) -> Column:
    """split after sentence-final punctuation, eating following space.
    ``end_chars`` is the separator set (a parameter: the set the reference
    takes from an external library is not available)."""
    return F.split(_c(c), f"{UNICODE}(?<={'[' + _class_escape(end_chars) + ']'}){WS_CLASS}*", -1)


def whitespace_tokens(c) -> Column:
    """F15 (whitespace form): ``text.split()`` — runs of non-space."""
    return F.regexp_extract_all(_c(c), F.lit(f"{UNICODE}{NOT_WS}+"), 0)


def word_tokens(c) -> Column:
    """F15 (punctuation-separating form): word runs or single symbols."""
    return F.regexp_extract_all(_c(c), F.lit(f"{UNICODE}{WORD_RUN}|{PUNCT_ONE}"), 0)


def dediac(c) -> Column:
    """F16: remove Arabic diacritics and tatweel (``translate`` deletes
    characters that have no replacement: a per-character map, no regex)."""
    return F.translate(_c(c), DIACRITICS, "")


def normalize_alef(c) -> Column:
    """alef variants -> bare alef."""
    return F.translate(_c(c), ALEF_VARIANTS, ALEF_BARE)


def normalize_yaa_taa(c) -> Column:
    """alef maqsura -> yaa, taa marbuta -> haa."""
    return F.translate(_c(c), YAA_TAA_FROM, YAA_TAA_TO)


def collapse_elongation(c) -> Column:
    """a character repeated three or more times -> one occurrence."""
    return F.regexp_replace(_c(c), F.lit("(.)\\1{2,}"), F.lit("$1"))


def squeeze_ws(c) -> Column:
    return strip_ws(F.regexp_replace(_c(c), F.lit(f"{UNICODE}{WS_CLASS}+"), F.lit(" ")))


def strip_punct(c) -> Column:
    """punctuation and symbols -> space, then whitespace squeezed.

    Written as one regex: every maximal run of punctuation, symbols and
    whitespace becomes one space (what the two-step form yields), then the
    ends are trimmed."""
    return strip_ws(F.regexp_replace(_c(c), F.lit(f"{UNICODE}[\\p{{P}}\\p{{S}}{_WS}]+"), F.lit(" ")))


NORMALIZE_STEPS = (
    ("dediac", dediac),
    ("alef", normalize_alef),
    ("yaa_taa", normalize_yaa_taa),
    ("elongation", collapse_elongation),
    ("punct", strip_punct),
)


def char_map(c) -> Column:
    """F16 + F20 + F21 as one ``translate``: the three character sets are
    disjoint and the replacements (bare alef, yaa, haa) are in none of
    them, so one pass over the text equals the three in sequence."""
    src = ALEF_VARIANTS + YAA_TAA_FROM + DIACRITICS
    return F.translate(_c(c), src, ALEF_BARE + YAA_TAA_TO)


def normalize(c) -> Column:
    """The whole F16, F20-F23 chain (character maps fused into one pass)."""
    return strip_punct(collapse_elongation(char_map(c)))


def rewrite_clitics(c) -> Column:
    """``_+`` -> `` +`` then ``+_`` -> ``+ `` (literal replaces)."""
    out = _c(c)
    for a, b in CLITIC_REWRITES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def template_sentence(template: str, c) -> Column:
    """a sentence built from a word through a ``%s`` template."""
    return F.format_string(template, _c(c))


def lemma_of(c) -> Column:
    """the lemma part of ``lemma#pos``."""
    return F.substring_index(_c(c), "#", 1)


def pos_of(c) -> Column:
    """the part-of-speech part of ``lemma#pos``: the second
    ``#``-separated piece (``''`` when there is none)."""
    return F.split_part(_c(c), F.lit("#"), F.lit(2))


def lemma_pos_key(lemma, pos) -> Column:
    """``dediac(lemma)#pos``, only when both parts are present (neither
    null nor empty)."""
    lemma, pos = _c(lemma), _c(pos)
    return F.when((lemma != "") & (pos != ""),
                  F.concat_ws("#", dediac(lemma), pos))
