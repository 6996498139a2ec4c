"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searches ignore.
FILLER_WORDS = "a an the of and or in on at to for from by with is are was were be been it its this that as".split()
#: Mark that stands for a boundary inside expressions.
MARK = "\u0001"


def tokens(text: Column) -> Column:
    """Small-letter words and numbers, ASCII white space and punctuation dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def white_split(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def clean_pdf_text(text: Column) -> Column:
    """Glyphs of symbol fonts to spaces, NUL and soft hyphen dropped, blank lines squeezed, trimmed."""
    spaced = F.regexp_replace(text, r"[\x{E000}-\x{FFFF}]", " ")
    bare = F.regexp_replace(spaced, r"[\x00\x{AD}]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def clean_ocr_pipes(text: Column) -> Column:
    """Pipes read for table rules become spaces, and runs of spaces one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ ]*\|[ ]*", " "), r" {2,}", " "))


def collapse_repeats(text: Column) -> Column:
    """``very very good`` to ``very good``."""
    return F.regexp_replace(text, r"(?i)\b(\w+)(?: \1\b)+", "$1")


def sentences(text: Column, least_words: int = 6) -> Column:
    """Sentences by end mark and white space, those under ``least_words`` dropped."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1" + MARK)
    trimmed = F.transform(F.split(marked, MARK), lambda s: F.regexp_replace(s, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""))
    return F.filter(trimmed, lambda s: F.size(white_split(s)) >= least_words)


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Fig Figs Eq Eqs Ref Refs Sec Sect No Nos Vol Dr Mr Mrs Prof vs etc approx al pp ca".split()


def recut(sentences: Column, most_words: int) -> Column:
    """Sentences of more than ``most_words`` words in pieces of as many, the last one with what is left."""
    part = lambda w, k: F.array_join(F.slice(w, k * most_words + 1, most_words), " ")
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most_words).cast("int")), lambda k: part(w, k))
    return F.flatten(F.transform(sentences, lambda s: F.when(F.size(white_split(s)) > most_words, pieces(white_split(s))).otherwise(F.array(s))))


def protected_sentences(text: Column, least_words: int = 5, most_words: int = 420) -> Column:
    """Sentences that neither an abbreviation, an initial such as ``i.e.`` nor a decimal point ends.

    Longer ones than ``most_words`` are cut again; a short last piece stays, so no word of them is lost.
    """
    guarded = F.regexp_replace(text, rf"\b({'|'.join(ABBREVIATIONS)}|[A-Za-z](?:\.[A-Za-z])+)\.", "$1\u0002")
    guarded = F.regexp_replace(guarded, r"(?<=\d)\.(?=\d)", "\u0002")
    parts = F.split(guarded, r"(?<=[.!?])[ \t\n\r\f]+(?=[\p{Lu}\p{N}])")
    whole = F.filter(F.transform(parts, lambda s: F.replace(F.trim(s), F.lit("\u0002"), F.lit("."))), lambda s: F.size(white_split(s)) >= least_words)
    return recut(whole, most_words)


#: Words that a keyword search drops; question words are kept.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves which whom this that that'll these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up down in out on off over under again
further then once here there all any both each few more most other some such no nor not only own same so than too very s t
will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn
hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
wasn't weren weren't won won't wouldn wouldn't
search tell me about look up information pull provide youtube do you know
""".split()


def keywords(text: Column) -> Column:
    """Quoted phrases as they are, other runs without white space in small letters unless they are stop words, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\"[^\"\n]+\"|'[^'\n]+'|[^ \t\n\r\f]+"), F.lit(0))
    quoted = lambda w: w.rlike(r"^(\"[^\"\n]+\"|'[^'\n]+')$")
    words = F.transform(found, lambda w: F.when(quoted(w), F.substring(w, F.lit(2), F.length(w) - 2)).otherwise(F.when(~F.lower(w).isin(STOP_WORDS), F.lower(w))))
    return F.array_compact(words)


def markdown_lines(table: Column) -> Column:
    return F.filter(F.transform(F.split(table, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))


def markdown_cells(line: Column) -> Column:
    inner = F.regexp_replace(line, r"^\|[ ]*|[ ]*\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def is_rule(line: Column) -> Column:
    """The separator row of a Markdown table."""
    return line.rlike(r"^\|[-| :]+\|$")


#: What stands for an empty cell.
EMPTY_CELLS = ("", "None", "nan", "N/A")


def table_faults(table: Column, least_rows: int = 2, most_empty: float = 0.7, least_words: int = 30) -> Column:
    """Reasons why a Markdown table is not worth keeping; empty for a good one."""
    rows = F.filter(markdown_lines(table), lambda x: ~is_rule(x))
    data = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))
    data = F.when(F.size(rows) > 1, data).otherwise(F.array().cast("array<string>"))
    cells = F.flatten(F.transform(data, markdown_cells))
    empty = F.size(F.filter(cells, lambda c: c.isin(*EMPTY_CELLS)))
    words = F.size(F.regexp_extract_all(table, F.lit(r"[^ \t\n\r\f|]+"), F.lit(0)))
    return F.array_compact(
        F.array(
            F.when(F.size(data) < least_rows, "too few rows"),
            F.when(empty > most_empty * F.size(cells), "too many empty cells"),
            F.when(words < least_words, "too few words"),
        )
    )


def text_faults(text: Column, least_words: int = 10, most_glyphs: int = 10, most_breaks: float = 0.5, most_formula: int = 20) -> Column:
    """Reasons why an extracted page text should be read again."""
    words = F.size(white_split(text))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return F.array_compact(
        F.array(
            F.when(words < least_words, "few words"),
            F.when(count(r"[\x{E000}-\x{F8FF}]") >= most_glyphs, "symbol glyphs"),
            F.when(count(r"\n") > most_breaks * F.greatest(words, F.lit(1)), "broken lines"),
            F.when(count(r"[∑∫√∂≈≠≤≥±∞∏÷]") >= most_formula, "formula signs"),
        )
    )


def valid_label(label: Column) -> Column:
    """Whether a phrase can name an entity."""
    parts = white_split(label)
    single = F.size(F.filter(parts, lambda w: F.length(w) == 1))
    return (
        ~F.lower(label).isin(FILLER_WORDS)
        & F.length(label).between(4, 100)
        & ~label.contains("|")
        & label.rlike(r"\p{L}")
        & ~((F.size(parts) >= 3) & (single > 0.4 * F.size(parts)))
        & F.exists(parts, lambda w: F.length(w) >= 3)
    )


#: Phrases that open a question, dropped one after the other, and words that name its setting.
OPENINGS = (
    "(please|can you|could you|would you)[ \\t\\n\\r\\f]+(explain|tell me|show me|define|compare|calculate|compute|find|describe)",
    "i want to know",
    "give me[ \\t\\n\\r\\f]+information[ \\t\\n\\r\\f]+about",
    "help me understand",
    "what is the meaning of",
    "(pull up|find|show me|look up|search for|provide)[ \\t\\n\\r\\f]+(information|details|details)[ \\t\\n\\r\\f]+(on|about)",
    "tell me about",
)
SETTING_WORDS = "according to the provided documentation files manual text given below following source".split()


def clean_query(text: Column) -> Column:
    """A search query in small letters without openings, setting words and punctuation."""
    low = F.lower(text)
    for opening in OPENINGS:
        low = F.regexp_replace(low, opening, "")
    words = F.filter(F.split(low, "[ \\t\\n\\r\\f]+"), lambda w: (w != "") & ~w.isin(SETTING_WORDS))
    bare = F.regexp_replace(F.array_join(words, " "), r"[^\p{L}\p{N}_ ?]+", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


#: Kinds of questions by the words that tell them, in order of trial.
QUESTION_WORDS = {
    "why": ["why", "reason", "cause", "explain", "mechanism", "principle", "because"],
    "what": ["what", "which", "definition", "meaning", "stand for", "expand"],
    "how": ["how", "process", "method", "procedure", "steps", "way", "means", "how to"],
    "when": ["when", "date", "time", "schedule", "timeline", "period"],
    "where": ["where", "location", "place", "site", "area", "region"],
    "who": ["who", "person", "people", "author", "creator", "founder"],
    "can": ["can", "could", "may", "might", "is it possible", "does it work"],
}


def question_type(text: Column) -> Column:
    """The first kind of question with a word of its anywhere in the text, else ``general``."""
    out = None
    for kind, words in QUESTION_WORDS.items():
        rule = F.lower(text).rlike(rf"\b(?:{'|'.join(words)})\b")
        out = F.when(rule, kind) if out is None else out.when(rule, kind)
    return out.otherwise("general")


#: How a request for a definition begins.
DEFINITION_OPENINGS = ("what is", "define", "meaning of", "explain", "who is", "describe")


def definition_term(text: Column) -> Column:
    """What a request for a definition asks for, in small letters; null for other texts."""
    low = F.lower(text)
    return F.when(low.rlike(rf"^(?:{'|'.join(DEFINITION_OPENINGS)})"), F.trim(F.regexp_replace(low, rf"^(?:{'|'.join(DEFINITION_OPENINGS)})", "")))


#: Where a request goes, by the first row with a word that the text contains anywhere.
INTENTS = (
    ("video", ("youtube", "yt video", "yt", "watch video", "video")),
    ("search", ("search", "look up", "pull up information", "find info", "information")),
)


def intent(text: Column) -> Column:
    """Where a request goes by its words, else ``unknown``."""
    out = None
    for name, words in INTENTS:
        rule = F.lit(False)
        for w in words:
            rule = rule | F.contains(F.lower(text), F.lit(w))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("unknown")


def bullet_points(text: Column, most: int = 10) -> Column:
    """The first ``most`` sentences of three and more words, each behind a bullet, on lines of their own."""
    return F.array_join(F.transform(F.slice(sentences(text, 3), 1, most), lambda s: F.concat(F.lit("\u2022 "), s)), "\n")


def plain_sentences(text: Column, least_words: int = 5) -> Column:
    """Sentences without braces and angle brackets."""
    return F.filter(sentences(text, least_words), lambda s: ~s.rlike(r"[{}<>]"))


def excerpt(text: Column, words: int | None = None, chars: int | None = None) -> Column:
    """The first words, or the first characters, of a text."""
    cut = text if chars is None else F.substring(text, 1, chars)
    return cut if words is None else F.array_join(F.slice(white_split(cut), 1, words), " ")


def statements_of(text: Column, term: str) -> Column:
    """What is said from each mention of a word to the next full stop on the line."""
    return F.regexp_extract_all(text, F.lit(rf"\b{term}\b[^\n]*?\."), F.lit(0))


#: A Markdown table: header row, rule, one and more rows.
MARKDOWN_TABLE = r"\|[^\n]+\|\n\|[-|: ]+\|\n(?:\|[^\n]+\|\n?)+"


def _unbroken(markdown: Column) -> Column:
    return F.replace(F.replace(F.replace(markdown, F.lit("<br>"), F.lit(" ")), F.lit("\u2014_"), F.lit("")), F.lit("\u2014"), F.lit("-"))


def markdown_tables(markdown: Column) -> Column:
    """The tables inside a Markdown text without empty rows; those of less than three lines are none."""
    found = F.regexp_extract_all(F.concat(_unbroken(markdown), F.lit("\n")), F.lit(MARKDOWN_TABLE), F.lit(0))
    full = lambda x: F.regexp_replace(x, r"[| \t\r]", "") != ""
    lines = F.transform(found, lambda t: F.filter(F.split(F.rtrim(t, F.lit("\n")), "\n"), lambda x: full(x) | is_rule(F.trim(x))))
    return F.transform(F.filter(lines, lambda x: F.size(x) >= 3), lambda x: F.array_join(x, "\n"))


def without_tables(markdown: Column) -> Column:
    """A Markdown text without its tables and stray table rows, cleaned."""
    bare = F.regexp_replace(_unbroken(markdown), MARKDOWN_TABLE, "")
    return clean_pdf_text(F.regexp_replace(bare, r"(?m)^[ \t]*\|.*\|[ \t]*$", ""))


#: Groups of reasons, in order of trial, by what the reason's name contains.
REASON_GROUPS = (
    ("empty cells", "Table: mostly empty cells"),
    ("few rows", "Table: too few rows"),
    ("few words", "Too short"),
    ("symbol glyphs", "Text: glyphs of symbol fonts"),
    ("broken lines", "Text: broken lines"),
    ("formula", "Text: formulas"),
    ("cut off", "Table: cut off"),
)


def reason_group(reason: Column) -> Column:
    out = None
    for part, name in REASON_GROUPS:
        rule = F.contains(reason, F.lit(part))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("Other")
