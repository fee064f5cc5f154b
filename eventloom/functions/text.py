"""Text and document expressions: chunkers, ids, normalisers, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ITEM_CODES = ("1.01", "2.02", "4.02", "5.02", "7.01", "8.01")
SECTION_ALIASES = (
    ("business", "business"),
    ("item 1", "business"),
    ("item1", "business"),
    ("section_1", "business"),
    ("risk factors", "risk_factors"),
    ("risk_factors", "risk_factors"),
    ("item 1a", "risk_factors"),
    ("item1a", "risk_factors"),
    ("section_1a", "risk_factors"),
    ("mda", "mda"),
    ("management discussion", "mda"),
    ("managements discussion", "mda"),
    ("management's discussion and analysis", "mda"),
    ("item 7", "mda"),
    ("item7", "mda"),
    ("section_7", "mda"),
)
#: Words of company names that don't tell companies apart.
CORPORATE_WORDS = r"\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|LLC|L\.?P|N\.?V|PLC|SA|AG|HOLDINGS?|GROUP|TRUST|CLASS\s+[A-Z])\b"
SOURCE_TYPES = ("sec_10k", "sec_10q", "sec_8k", "earnings_transcript", "news", "peer_news", "sector_news", "macro", "research_13f", "short_interest", "thirteen_f", "index_change")


def word_array(text: Column) -> Column:
    """Words between white space; none for null and blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text))


def _starts(n: Column, size: int, step: int) -> Column:
    """0-based starts of windows: one after the other by step until one reaches the end; none for n = 0."""
    count = F.greatest(F.ceil((n - size) / F.lit(float(step))).cast("int"), F.lit(0)) + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def word_chunks(words: Column, target: int = 600, overlap: int = 75) -> Column:
    """Pieces of `target` words that share `overlap`; the last one reaches the end. `words` should be a stored column."""
    return F.transform(_starts(F.size(words), target, target - overlap), lambda s: F.array_join(F.slice(words, s + 1, F.lit(target)), " "))


def char_chunks(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    """Trimmed pieces of `size` characters that share `overlap`; blank ones go."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.transform(_starts(F.length(t), size, size - overlap), lambda s: F.trim(F.substring(t, s + 1, F.lit(size)))), lambda x: x != "")


def token_estimate(words: Column) -> Column:
    """Tokens of so many words, by 0.75 words a token, cut down."""
    return F.floor(words / F.lit(0.75)).cast("int")


def join_sentences(sentences: Column) -> Column:
    return F.array_join(F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: s != ""), " ")


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, entities of the plain kind are resolved, space collapses."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def item_codes(text: Column) -> Column:
    """Distinct item numbers in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d{1,2}\.\d{2})"), F.lit(1)))


def relevant_items(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in ITEM_CODES]))


def section_name(label: Column) -> Column:
    """An exact alias, else the first alias that the label contains; null if none."""
    t = F.lower(F.trim(label))
    out = F.when(t == SECTION_ALIASES[0][0], SECTION_ALIASES[0][1])
    for alias, name in SECTION_ALIASES[1:]:
        out = out.when(t == alias, name)
    for alias, name in SECTION_ALIASES:
        out = out.when(t.contains(alias), name)
    return out


def cashtag(title: Column, body: Column) -> Column:
    """The first $TICKER of the title, else of the body; null if there is none."""
    pattern = r"\$([A-Z][A-Z0-9\-.]{0,6})\b"
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")) for c in (title, body)])


def company_key(name: Column) -> Column:
    """Upper case without corporate words, letters and digits only."""
    t = F.regexp_replace(F.upper(name), CORPORATE_WORDS, "")
    return F.regexp_replace(t, "[^A-Z0-9]", "")


def first_prefix(key: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first prefix in the table that the key begins with (or is); null if none does."""
    return F.coalesce(*[F.when(key.startswith(prefix), value) for prefix, value in table], F.lit(None).cast("string"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def date_in_url(url: Column) -> Column:
    """/20YY/M/D/ or /20YY/M/ (the first); null for anything else or no real date."""
    pattern = r"/(20\d{2})/(\d{1,2})(?:/(\d{1,2}))?/"
    y, m, d = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(F.when(d == "", "1").otherwise(d), 2, "0"))
    return F.when(y != "", F.try_to_date(text, "yyyy-MM-dd"))


def symbols(text: Column, pattern: str = r"[,;\s]+") -> Column:
    """Upper-case symbols of a list in text."""
    return F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), pattern), "")


def body(title: Column, paragraphs: Column) -> Column:
    """Title and paragraphs with blank lines between; empty ones go."""
    return F.array_join(F.filter(F.concat(F.array(title), paragraphs), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")


def preview(text: Column, n: int = 220) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def source_of_id(chunk_id: Column) -> Column:
    """The first source type whose name and an underscore begin the id; null if none."""
    out = F.when(chunk_id.startswith(f"{SOURCE_TYPES[0]}_"), SOURCE_TYPES[0])
    for s in SOURCE_TYPES[1:]:
        out = out.when(chunk_id.startswith(f"{s}_"), s)
    return out


def chunk_id(prefix: Column, key: Column, ordinal: Column) -> Column:
    return F.format_string("%s_%s_%03d", prefix, key, ordinal)


def money(value: Column) -> Column:
    """Signed millions with one place."""
    return F.format_string("$%+,.1fM", value / 1e6)


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def lenient_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy")) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def optional(text: Column) -> Column:
    """Null for blanks and for the words that stand for nothing."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)
