"""Web pages: routes, hosts and visible text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that hold no text; elements that hold no content.
BINARY = ("png", "jpg", "jpeg", "gif", "svg", "zip", "gz", "mp4", "mp3", "exe", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
DROPPED = ("script", "style", "nav", "footer", "aside", "form", "header")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host(url: Column) -> Column:
    """Host in small letters, without a leading ``www.``"""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def route(url: Column, snippet: Column) -> Column:
    """``skip``, ``snippet``, ``pdf`` or ``html``."""
    bare = F.element_at(F.split(F.lower(url), r"\?"), 1)
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "skip")
        .when(bare.rlike(rf"\.({'|'.join(BINARY)})$"), "skip")
        .when(snippet.isNotNull() & (F.trim(snippet) != ""), "snippet")
        .when(bare.endswith(".pdf"), "pdf")
        .otherwise("html")
    )


def visible_text(html: Column, least_words: int = 4) -> Column:
    """Text of paragraphs, list items, cells and headings with enough words, joined by spaces."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED)})\b.*?</\1\s*>", " ")
    kept = F.regexp_extract_all(bare, F.lit(r"(?is)<(p|li|td|h[1-3])\b[^>]*>(.*?)</\1\s*>"), F.lit(2))

    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
        for entity, sign in ENTITIES:
            x = F.replace(x, F.lit(entity), F.lit(sign))
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return F.array_join(F.filter(F.transform(kept, plain), lambda x: F.size(F.split(x, " ")) >= least_words), " ")


def form_feed_pages(markdown: Column, n_pages: Column) -> Column:
    """Pages of a document's Markdown by form feeds; null unless there are ``n_pages``."""
    parts = F.split(markdown, "\f")
    return F.when(F.size(parts) == n_pages, parts)
