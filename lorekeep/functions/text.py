"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a question.
STOPWORDS = ("the", "and", "for", "with", "what", "how", "did", "was", "were", "you", "about", "tell", "this", "that", "are", "can")

#: Length limits of extracted fields.
EXCERPT, SUMMARY, AGENT_SUMMARY, MOST_TAGS, MOST_FACTS = 4000, 240, 300, 8, 8


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: Column, most: int = 8) -> Column:
    """The first ``most`` words of three characters or more that are no stopwords; repeated ones stay."""
    return F.slice(F.filter(tokens(query), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)), 1, most)


def term_overlap(terms: Column, haystack: Column) -> Column:
    """How many of the terms are substrings of the text; a repeated term counts again."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    return F.aggregate(F.transform(terms, lambda t: F.contains(low, t).cast("int")), F.lit(0), lambda s, x: s + x)


def haystack(content: Column, summary: Column) -> Column:
    return F.concat_ws(" ", content, summary)


def normalize_label(label: Column) -> Column:
    """Small letters, runs of blanks, underscores and hyphens as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(label)), "[ _-]+", "-"), "^-+|-+$", "")


def query_labels(query: Column) -> Column:
    """Tag labels that a question may name: each of its terms, and the whole of it."""
    terms = F.transform(query_terms(query), normalize_label)
    return F.array_distinct(F.filter(F.concat(terms, F.array(normalize_label(query))), lambda x: x != ""))


def scope_key(user: Column, agent: Column, project: Column) -> Column:
    return F.concat_ws("|", user.cast("string"), agent, F.when(F.coalesce(project, F.lit("")) == "", "global").otherwise(project))


def first_nonblank(*values: Column) -> Column:
    """The first value that is not only white space; an empty text if there is none."""
    return F.coalesce(*(F.when(F.length(F.regexp_replace(v, r"\s+", "")) > 0, v) for v in values), F.lit(""))


def normalize_text(text: Column) -> Column:
    """Answer comparison form: small letters, no ASCII punctuation, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def render_turn(occurred_at: Column, speaker: Column, text: Column) -> Column:
    when = F.coalesce(F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("?"))
    return F.concat(F.lit("["), when, F.lit("] "), speaker, F.lit(": "), text)


def numbered_context(summaries: Column, empty: str = "(no memories found)") -> Column:
    lines = F.array_join(F.transform(summaries, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.size(summaries) > 0, lines).otherwise(empty)


def context_line(summary: Column, date: Column, scope: Column) -> Column:
    """``- [date · scope] summary``, with what is there of date and scope."""
    head = F.concat_ws(" · ", date, scope)
    return F.concat(F.lit("- "), F.when(head != "", F.concat(F.lit("["), head, F.lit("] "))).otherwise(""), summary)


def facts_block(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n")


def escape_markup(text: Column) -> Column:
    """``& < >`` and both quotes as character references, the ampersand first."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def splice_date(prompt: Column, date: Column, before: str) -> Column:
    """A ``Current Date:`` line before the first occurrence of a marker, if there is a date."""
    at = F.instr(prompt, before)
    spliced = F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit("Current Date: "), date, F.lit("\n"), F.substring(prompt, at, F.length(prompt)))
    return F.when(date.isNotNull() & (at > 0), spliced).otherwise(prompt)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda p: p != "")


def word_windows(text: Column, size: int = 200, most: int = 200) -> Column:
    """Paragraphs, those of more than ``size`` words cut into windows of as many; ``most`` chunks at most."""

    def windows(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, r"\s+"), lambda w: w != "")
        count = F.ceil(F.size(words) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "))
        return F.when(count <= 1, F.array(paragraph)).otherwise(cut)

    return F.slice(F.flatten(F.transform(paragraphs(text), windows)), 1, most)


def split_tags(text: Column) -> Column:
    return F.filter(F.split(text, r"[,\s]+"), lambda t: t != "")


def evidence_ids(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "[;,]"), lambda t: F.trim(t)), lambda t: t != ""))


def decimal_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9.]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
