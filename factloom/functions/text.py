"""Tokenisers and normalisers as columns. Four tokenisers differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and irregular forms of the conversation tokeniser.
STOP = (
    "a an the and or of to in on at for with as is are was were be been did does do has have had "
    "when what which who how would could should might can will about from by his her their "
    "its he she they it i me my you your we our s t"
).split()
IRREGULAR = {
    "lost": "lose", "left": "leave", "went": "go", "got": "get", "bought": "buy", "began": "begin", "met": "meet",
    "told": "tell", "married": "marry", "reading": "read", "wrote": "write", "won": "win", "children": "child",
}
# Stop words of the benchmark tokeniser.
BENCHMARK_STOP = (
    "a an and are as at be by did do does for from had has have in is it of on or that "
    "the their to was were what when where which who whose with"
).split()


# Tokens of code; stamps of memories and days in questions.
CODE_WORD = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
CAMEL_PART = r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[A-Za-z_][A-Za-z0-9_]*|\d+"
MEMORY_STAMP = r"\b([A-Z][a-z]{2})\s+(\d{1,2}),\s+(20\d{2}).*?(\d{2}:\d{2}:\d{2})\s*$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMED_DAY = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)(?:\s+(\d{1,2}))?,?\s+(20\d{2})\b"
ISO_DAY = r"\b20\d{2}-\d{2}-\d{2}\b"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def conversation_terms(text: Column) -> Column:
    """Letter runs or digit runs in lower case, without stop words, each stripped of one ending at most."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])

    def stem(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w.isin(*IRREGULAR), irregular[w])
            .when((n > 5) & w.endswith("ing"), F.left(w, n - 3))
            .when((n > 4) & w.endswith("ed"), F.left(w, n - 2))
            .when((n > 4) & w.endswith("s"), F.left(w, n - 1))
            .otherwise(w)
        )

    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|\d+"), 0)
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP)), stem)


def code_tokens(text: Column) -> Column:
    """Identifiers and numbers: each whole word in lower case, then its camel-case pieces, then its underscore pieces; repeats stay."""

    def pieces(w: Column) -> Column:
        camel = F.transform(F.regexp_extract_all(w, F.lit(CAMEL_PART), 0), F.lower)
        under = F.when(F.contains(w, F.lit("_")), F.filter(F.transform(F.split(w, "_"), F.lower), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lower(w)), F.filter(camel, lambda p: p != F.lower(w)), under)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CODE_WORD), 0), pieces))


def benchmark_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin(*BENCHMARK_STOP))


def normalised(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def question_clause(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"[.!?]\s+|\s[-–—]\s"), -1)


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading dots or slashes."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))


def tail_of(symbol: Column) -> Column:
    return F.trim(F.element_at(F.split(symbol, "/"), -1))


def display_name(symbol: Column) -> Column:
    """The last descriptor identifier after the last slash, or all that stands there."""
    names = F.regexp_extract_all(tail_of(symbol), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)(?=[#.:()]|$)"), 1)
    return F.coalesce(F.try_element_at(names, F.lit(-1)), tail_of(symbol))


# The grammar of symbols.
PARAMETER = r"\.\([A-Za-z_][A-Za-z0-9_]*\)$"
METHOD = r"\([^()]*\)\.$"


def symbol_kind(symbol: Column) -> Column:
    """Kinds by the suffix grammar, tested in this order."""
    tail = tail_of(symbol)
    return (
        F.when(symbol.startswith("file:"), "file")
        .when(tail.rlike(PARAMETER) | (tail.startswith("(") & tail.endswith(")")), "parameter")
        .when(tail.rlike(METHOD), "function")
        .when(tail.endswith("#"), "struct")
        .when(tail.endswith(":"), "module")
        .when(tail.endswith("."), "term")
        .otherwise("symbol")
    )


def descriptor_path(symbol: Column) -> Column:
    """The tail without method suffix and closing characters; empty for parameters."""
    tail = tail_of(symbol)
    return F.when(tail.rlike(PARAMETER), "").otherwise(F.rtrim(F.regexp_replace(tail, METHOD, ""), F.lit("#.")))


def dialogue_ids(text: Column) -> Column:
    """Ids D<n>:<n> in text, without leading zeros, distinct and sorted as strings."""
    found = F.regexp_extract_all(text, F.lit(r"D0*(\d+):0*(\d+)"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"D0*(\d+):0*(\d+)", "D$1:$2"))))


def gold_date(text: Column) -> Column:
    """A full date in one of five forms, null otherwise."""
    plain = F.replace(F.regexp_replace(F.trim(text), r"(?<=\d)(st|nd|rd|th)\b", ""), F.lit(","), F.lit(""))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in ("d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d yyyy", "yyyy-MM-dd")])


def memory_time(text: Column) -> Column:
    """`Mon d, yyyy … HH:MM:SS` at the end of a text as a timestamp; another text is an error, null stays null."""
    parts = [F.regexp_extract(text, MEMORY_STAMP, i) for i in (1, 2, 3, 4)]
    got = F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit("MMM d yyyy HH:mm:ss"))
    return F.when(text.isNotNull(), F.coalesce(got, F.raise_error(F.concat(F.lit("not a memory time: "), text)).cast("timestamp")))


def question_time(question: Column, session_end: Column) -> Column:
    """The latest day that a question names, at its end; a month without a day is its last day, a day beyond the month's end is that end; else the session's end."""
    iso = F.transform(F.regexp_extract_all(question, F.lit(ISO_DAY), 0), lambda d: F.try_to_date(d, "yyyy-MM-dd"))

    def named(hit: Column) -> Column:
        month = F.lower(F.left(F.regexp_extract(hit, NAMED_DAY, 1), F.lit(3)))
        number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])[month]
        day, year = F.regexp_extract(hit, NAMED_DAY, 2), F.regexp_extract(hit, NAMED_DAY, 3)
        first = F.make_date(year.cast("int"), number, F.lit(1))
        asked = F.when(day == "", 31).otherwise(F.greatest(day.try_cast("int"), F.lit(1)))
        return F.least(F.date_add(first, asked - 1), F.last_day(first))

    days = F.concat(iso, F.transform(F.regexp_extract_all(question, F.lit(NAMED_DAY), 0), named))
    last = F.array_max(days)
    return F.when(last.isNotNull(), F.date_add(last, 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")).otherwise(session_end)


def nested_question(text: Column) -> Column:
    """Whether a question asks along a chain: ` of ` twice, or ` whose `."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return (F.size(F.split(padded, " of ")) - 1 >= 2) | F.contains(padded, F.lit(" whose "))
