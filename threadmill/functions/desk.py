"""Columns for support-desk records: names, keywords, messages, dates, payload parts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Forms that stored data has to agree on.
ATTACHMENT_TYPES = ["file", "audio", "animation"]
CHOICE_TYPES = ["picker", "field"]
TABS = ["needs-reply", "needs-resolved", "drafted", "dismissed", "all"]
MARKDOWN_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
PLUGIN_PATH = r"(?i)/support/plugin/([a-z0-9-]+)"
PAGE_CEILING = (400, "page_number_too_high")
VECTOR_WIDTH = 1536
# End of fixed values.


def nonempty(c: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    t = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return F.when(t != "", t)


def one_of(c: Column, known: list[str], default: str) -> Column:
    """c if it is a known value, else the default."""
    return F.when(c.isin(known), c).otherwise(default)


def page_ceiling(status: Column, reason: Column) -> Column:
    """Whether a failed page request only says that the pages have ended."""
    return F.coalesce((status == PAGE_CEILING[0]) & (reason == PAGE_CEILING[1]), F.lit(False))


def short_name(name: Column) -> Column:
    """A product's name up to its tagline; 100 characters at most, and the whole name
    if fewer than two would be left."""
    head = F.regexp_extract(name, r"\A(.{2,}?)(?: [–—-] |: )", 1)
    return F.substring(F.trim(F.when(head != "", head).otherwise(name)), 1, 100)


def initials(name: Column) -> Column:
    """Two capital letters: of the first two words, or of the only one."""
    words = F.filter(F.split(name, r"[\s._@-]+"), lambda w: w != "")
    two = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1))
    return F.upper(F.when(F.size(words) > 1, two).otherwise(F.substring(F.get(words, F.lit(0)), 1, 2)))


def clean_keywords(words: Column) -> Column:
    """Trimmed, without blanks, each once whatever its case; the first spelling stays."""
    words = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")

    def once(words: Column, low: Column) -> Column:
        return F.filter(words, lambda w, i: F.array_position(low, F.get(low, i)) == i + 1)

    return bound(words, lambda w: bound(F.transform(w, F.lower), lambda low: once(w, low)))


def matcher_key(word: Column) -> Column:
    """What keywords are compared by: lower case, no white space."""
    return F.lower(F.regexp_replace(word, r"\s+", ""))


def new_keywords(proposed: Column, current: Column, name: Column, slug: Column) -> Column:
    """Proposed keywords of 2 to 100 characters that say something new."""
    taken = F.array_append(F.array_append(F.transform(current, matcher_key), matcher_key(name)), matcher_key(slug))
    keyed = F.transform(clean_keywords(proposed), lambda w: F.struct(w.alias("w"), matcher_key(w).alias("k")))
    fresh = bound(taken, lambda known: F.filter(keyed, lambda p: F.length(p["w"]).between(2, 100) & ~F.array_contains(known, p["k"])))

    def once(fresh: Column, keys: Column) -> Column:
        return F.transform(F.filter(fresh, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["w"])

    return bound(fresh, lambda f: bound(F.transform(f, lambda p: p["k"]), lambda keys: once(f, keys)))


def slugify(text: Column) -> Column:
    """Lower-case letters and digits of the decomposed text, joined by single hyphens."""

    def run(s: pd.Series) -> pd.Series:
        plain = s.str.normalize("NFKD").map(lambda t: "".join(c for c in t if not unicodedata.combining(c)), na_action="ignore")
        return plain.str.lower().str.replace(re.compile(r"[^a-z0-9]+"), "-", regex=True).str.strip("-")

    return F.pandas_udf(run, "string")(text)


def plugin_slug(page: Column) -> Column:
    slug = F.lower(F.regexp_extract(page, PLUGIN_PATH, 1))
    return F.when(slug != "", slug)


def promise_answer(text: Column) -> Column:
    """Whether a model's answer to "is a follow-up promised" begins with yes."""
    return F.coalesce(text.rlike(r"(?i)\A\s*yes(?![A-Za-z0-9_])"), F.lit(False))


def json_slice(text: Column) -> Column:
    """The outermost braces of a text and what is between them, or null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner)


def session_hash(text: Column) -> Column:
    """A bounded number of a text: h * 33 + byte in 32 bits, modulo a million."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda a, c: F.pmod(a * 33 + c, F.lit(1 << 32)))
    return h % 1_000_000


def message_line(kind: Column, content: Column) -> Column:
    """A message as a line of a transcript.  content: its JSON, a string or an object.

    Texts are trimmed, attachments named, choices give their text or value; other
    kinds, and what is empty, give null.
    """
    part = lambda name: nonempty(F.get_json_object(content, f"$.{name}"))
    text = F.when(kind == "text", nonempty(F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")))
    named = F.concat(F.lit("[attachment: "), F.coalesce(part("name"), part("type"), kind), F.lit("]"))
    return F.coalesce(text, F.when(kind.isin(ATTACHMENT_TYPES), named), F.when(kind.isin(CHOICE_TYPES), F.coalesce(part("text"), part("value"))))


def attached_file(kind: Column, content: Column) -> Column:
    """url, name and type of an attachment with an address; null for all else."""
    url = nonempty(F.get_json_object(content, "$.url"))
    found = F.struct(url.alias("url"), F.get_json_object(content, "$.name").alias("name"), F.get_json_object(content, "$.type").alias("type"))
    return F.when(kind.isin(ATTACHMENT_TYPES) & url.isNotNull(), found)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def parse_month(text: Column) -> Column:
    """The index of a YYYY-MM, or null for anything else."""
    fits = text.rlike(r"\A[0-9]{4}-(0[1-9]|1[0-2])\z")
    return F.when(fits, month_index(F.substring(text, 1, 4).cast("int"), F.substring(text, 6, 2).cast("int")))


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def end_of_month(day: Column) -> Column:
    """The last millisecond of a date's month, UTC."""
    return F.add_months(F.trunc(day, "month"), 1).cast("timestamp") - F.expr("INTERVAL 1 MILLISECOND")


def real_day(text: Column) -> Column:
    """The date that a YYYY-MM-DD names, or null where there is no such day."""
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def range_problem(start: Column, end: Column) -> Column:
    """What is wrong with a pair of days, or null: both or neither, real, in order."""
    a, b = real_day(start), real_day(end)
    return (
        F.when(start.isNull() & end.isNull(), None)
        .when(start.isNull() | end.isNull(), "one end is missing")
        .when(a.isNull() | b.isNull(), "not a day")
        .when(a > b, "ends before it starts")
    )


def valid_vector(vector: Column, width: int = VECTOR_WIDTH) -> Column:
    """The vector, or null if it has another width, a gap or a number that is not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when((F.size(vector) == width) & F.forall(vector, fine), vector)


def stops_walk(inside: Column, outside: Column) -> Column:
    """A page with dated rows, none of them in the window, ends a walk over a range."""
    return (inside == 0) & (outside > 0)


def feed_text(html: Column) -> Column:
    """A feed's description as plain lines."""
    text = F.regexp_replace(html, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    text = F.regexp_replace(text, r"(?i)<(?:/(?:p|div|li|h[1-6]|blockquote)|br\s*/?)>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def followup_query(title: Column, body: Column, n: int = 400) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, n))


def title_or_start(title: Column, content: Column, n: int = 80) -> Column:
    return F.coalesce(nonempty(title), F.substring(content, 1, n))


def docs_header(forum: Column, plugin: Column, title: Column, url: Column) -> Column:
    """[Docs: plugin | title | url] or [Forum Q&A: ...], without what is missing."""
    kind = F.when(forum, "Forum Q&A: ").otherwise("Docs: ")
    return F.concat(F.lit("["), F.concat_ws(" | ", F.concat(kind, plugin), nonempty(title), url), F.lit("]"))


def escaped(text: Column) -> Column:
    """Text for a chat message: the three characters of its markup as entities."""
    for raw, by in MARKDOWN_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(by))
    return text


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100 / whole)).otherwise(0).cast("int")


def unnamed_posts_resolved(fragment: Column) -> Column:
    """Whether a fragment of a forum page calls its topic resolved: a [resolved]
    prefix, a class of that name, or a tooltip that does not say "not resolved"."""
    classes = F.array_join(F.regexp_extract_all(fragment, F.lit(r"""(?i)class=["']([^"']*)["']"""), F.lit(1)), " ")
    titles = F.regexp_extract_all(fragment, F.lit(r"""(?i)(?:title|aria-label)=["']([^"']*)["']"""), F.lit(1))
    says = F.exists(titles, lambda t: t.rlike(r"(?i)(?<![a-z])resolved") & ~t.rlike(r"(?i)(?<![a-z])not\s+(?:a\s+)?resolved"))
    marked = F.coalesce(fragment.rlike(r"(?i)\[resolved\]") | F.concat(F.lit(" "), classes, F.lit(" ")).rlike(r"(?i)\sresolved\s") | says, F.lit(False))
    return F.when(F.contains(F.lower(fragment), F.lit("resolved")), marked).otherwise(False)


def transcript(title: Column, resolved: Column, posts: Column) -> Column:
    """A topic as text.  posts: array of struct(author, role, body) in order."""
    head = F.concat(F.when(resolved, "[Resolved] ").otherwise(""), title)
    role = lambda p: F.when(p["role"].isNotNull(), F.concat(F.lit(" ("), p["role"], F.lit(")"))).otherwise("")
    who = lambda p, i: F.when(i == 0, F.concat(F.lit("Question from "), p["author"])).otherwise(F.concat(F.lit("Reply from "), p["author"], role(p)))
    return F.array_join(F.concat(F.array(head), F.transform(posts, lambda p, i: F.concat(who(p, i), F.lit(":\n"), p["body"]))), "\n\n")
