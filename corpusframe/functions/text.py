"""Text columns: cleaning, names, headings, keywords and lenient parsing. All are built-in expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not keywords.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "when", "where", "which", "who", "how",
    "into", "about", "their", "there", "have", "has", "had", "are", "was", "were", "will", "would", "can",
    "could", "should", "may", "might", "also",
)
# Extensions that mime types imply.
EXTENSIONS = {
    "application/pdf": ".pdf",
    "text/csv": ".csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/webp": ".webp",
    "image/gif": ".gif",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
}
# Fixed value: how a caption begins.
CAPTION = r"(?i)^(fig(ure)?|table)\s*[.:]?\s*\d+"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """NUL becomes a space, white space (Unicode's too) collapses, ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)[\s\x00]+", " "))


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_of(c)) / 4).cast("int"))


def usage_tokens(c: Column) -> Column:
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("long")


def is_heading(c: Column) -> Column:
    """Short, not a sentence, and all capitals, ending in a colon, or a few mostly alphabetic words."""
    t = clean_text(c)
    n = F.length(t)
    letters = t.rlike(r"\p{L}")
    words = F.split(t, " ")
    alphabetic = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}")))
    few = (F.size(words) <= 8) & (alphabetic >= F.greatest(F.lit(1), F.size(words) - 1)) & ~F.lower(t).rlike("^(table|figure|fig) ")
    sentence = t.endswith(".") & (n > 25)
    return (n > 0) & (n <= 90) & ~sentence & (((F.upper(t) == t) & letters & (n <= 60)) | (t.endswith(":") & (n <= 70)) | few)


def is_caption_stop(c: Column) -> Column:
    """Ends a caption that goes over several blocks: short capitals, or a short line with a colon."""
    t = F.trim(text_of(c))
    return (F.length(t) > 0) & (((F.length(t) <= 40) & (F.upper(t) == t) & t.rlike(r"\p{L}")) | ((F.length(t) <= 25) & t.endswith(":")))


def keywords(c: Column, n: int = 12) -> Column:
    """The first ``n`` tokens of three characters or more that are no stop words; repeats stay."""
    tokens = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"([a-z0-9][a-z0-9_-]{2,})"), F.lit(1))
    return F.slice(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)), 1, n)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"[/\\]", "_")


def ensure_extension(name: Column, mime: Column) -> Column:
    """The extension that the mime type implies is added unless the name ends with it."""
    known = F.create_map(*map(F.lit, chain(*EXTENSIONS.items())))
    extension = F.try_element_at(known, text_of(mime))
    return F.when(extension.isNull() | F.endswith(F.lower(name), extension), name).otherwise(F.concat(name, extension))


def slugify(c: Column) -> Column:
    """Each character that is no letter or digit becomes a dash; dashes at the ends go."""
    return F.regexp_replace(F.lower(F.regexp_replace(text_of(c), r"[^\p{L}\p{N}]", "-")), r"^-+|-+$", "")


def pretty_title(c: Column) -> Column:
    """A title from a file's name. Folders, extension, leading numbers and hashes go."""
    t = F.trim(text_of(c))
    t = F.regexp_extract(t, r"([^/]*)$", 1)
    t = F.regexp_replace(t, r"(?i)\.[a-z0-9]{2,4}$", "")
    t = F.regexp_replace(t, r"(?i)^\d+[_-][0-9a-f]{6,}[_-]", "")
    t = F.regexp_replace(t, r"^\d+[_-]", "")
    t = F.regexp_replace(t, r"__+", " — ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "_", " "), r"\s+", " "))
    return F.when(t == "", "Document").otherwise(t)


def drive_id(*candidates: Column) -> Column:
    """The first external id in any of the texts: from a file URL, an ``id`` parameter, or the bare text."""
    found = []
    for c in candidates:
        t = F.trim(text_of(c))
        # Where an id stands.
        for pattern in (r"(?i)drive\.google\.com/file/d/([a-zA-Z0-9_-]{10,})", r"(?i)[?&]id=([a-zA-Z0-9_-]{10,})", r"^([a-zA-Z0-9_-]{10,})$"):
            found.append(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")))
    return F.coalesce(*found)


def route_format(title: Column, mime: Column) -> Column:
    """Name of the parser for a file, the first that fits; null where none does."""
    name, kind = F.lower(text_of(title)), F.lower(text_of(mime))
    # Extensions and types that choose the parser.
    code = r"\.(py|js|jsx|ts|tsx|java|go|rs|c|h|cpp|hpp|cc|cs|rb|php|swift|kt|scala|sh|sql|r|m|lua|pl)$"
    return (
        F.when(name.endswith(".csv") | kind.contains("csv"), "csv")
        .when(name.rlike(r"\.xls[xm]$") | kind.contains("spreadsheetml") | kind.contains("ms-excel"), "xlsx")
        .when(name.endswith(".docx") | kind.contains("wordprocessingml"), "docx")
        .when(name.rlike(code), "code")
        .when(name.rlike(r"\.(md|markdown)$") | kind.contains("markdown"), "markdown")
        .when(name.rlike(r"\.(txt|text|log)$") | kind.startswith("text/plain"), "text")
    )


def prompt_hash(c: Column) -> Column:
    return F.sha1(F.trim(text_of(c)).cast("binary"))


def context_prefix(title: Column, section: Column, page_start: Column, page_end: Column) -> Column:
    """``Document: … | Section: … | Pages: a-b``; pages are counted from 0 and shown from 1."""
    pages = F.when(page_start == page_end, F.concat(F.lit("Pages: "), (page_start + 1).cast("string"))).otherwise(F.concat(F.lit("Pages: "), (page_start + 1).cast("string"), F.lit("-"), (page_end + 1).cast("string")))
    return F.concat_ws(" | ", F.when(title != "", F.concat(F.lit("Document: "), title)), F.when(section != "", F.concat(F.lit("Section: "), section)), F.when(page_start.isNotNull() & page_end.isNotNull(), pages))


def embedding_text(prefix: Column, text: Column, snippets: Column) -> Column:
    return F.array_join(F.concat(F.array_compact(F.array(F.nullif(prefix, F.lit("")))), F.array(text), F.slice(snippets, 1, 6)), "\n\n")


def name_key(c: Column) -> Column:
    """Key of an entity's name: lower case, punctuation, white space and a leading article gone."""
    t = F.trim(F.lower(text_of(c)))
    t = F.regexp_replace(t, r"(?U)[^\w\s-]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(t, r"^(the|a|an) ", ""))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer, as text: fences go, else the widest ``{…}``; null where none parses."""
    t = F.trim(text_of(c))
    bare = F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))).otherwise(t)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(bare), valid(inner))


def match_norm(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text_of(c))), "[,$%]", "")
    return F.regexp_replace(t, r"\s+", " ")


def quick_match(reference: Column, answer: Column) -> Column:
    """The reference answer stands in the answer, or all of its parts do where it has three at most."""
    r, a = match_norm(reference), match_norm(answer)
    parts = F.filter(F.split(r, r"\s+"), lambda p: p != "")
    return (r != "") & (a != "") & (F.contains(a, r) | ((F.size(parts) <= 3) & F.forall(parts, lambda p: F.contains(a, p))))
