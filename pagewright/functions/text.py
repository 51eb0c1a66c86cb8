"""Text functions of pages as Column expressions, all built in, with the same in DuckDB's SQL for comparison.

Whitespace, letters and digits are Unicode's, written out for each regular-expression dialect: Java's ``\\s`` and
``\\w`` are ASCII by default and RE2's always.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str

WS = r"(?U)[\s\x1c-\x1f]"
LETTER, ALNUM, WORD, DIGIT = r"[\p{L}\p{Nl}\p{No}]", r"[\p{L}\p{N}]", r"[\p{L}\p{N}_]", r"\p{Nd}"
LINE = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
NUMERIC = rf"^[-+]?{DIGIT}[{DIGIT}.,:/%–—-]*$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HYPHEN = rf"({WORD})-\n[ \t]*({WORD})"
RULE_LINE = rf"^\|?(?:(?U)[\s\x1c-\x1f:|-])+\|?$"
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}

# RE2
WS_D = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
LINE_D = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NUMERIC_D = r"^[-+]?\p{Nd}[\p{Nd}.,:/%\x{2013}\x{2014}-]*$"


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of x, which is evaluated once a row however often ``then`` names it, also in the lambdas within."""
    return F.transform(F.array(x), then)[0]


def strip(x: Str) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(_c(x), rf"\A{WS}+|{WS}+\z", "")


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS_D}+|{WS_D}+\z', '', 'g')"


def squeeze(x: Str) -> Column:
    """Without any white space."""
    return F.regexp_replace(_c(x), f"{WS}+", "")


def squeeze_sql(x: str) -> str:
    return f"regexp_replace({x}, '{WS_D}+', '', 'g')"


def nonspace_bytes(x: Str) -> Column:
    """UTF-8 bytes that are not white space: the density of a page."""
    return F.octet_length(squeeze(x)).cast("long")


def nonspace_bytes_sql(x: str) -> str:
    return f"strlen({squeeze_sql(x)})"


def readability_counts(x: Str) -> Column:
    """Struct of chars, alnum, bad, tokens, wordlike: the whole numbers behind readability."""

    def counts(s: Column, tokens: Column) -> Column:
        like = F.filter(tokens, lambda t: t.rlike(LETTER + "{3,}") | t.rlike(NUMERIC))
        return F.struct(
            F.char_length(s).cast("long").alias("chars"),
            F.char_length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")).cast("long").alias("alnum"),
            F.char_length(F.regexp_replace(s, r"[^\x{FFFD}\x00-\x1f]+", "")).cast("long").alias("bad"),
            F.size(tokens).cast("long").alias("tokens"),
            F.size(like).cast("long").alias("wordlike"),
        )

    split = F.filter(F.split(_c(x), f"{WS}+"), lambda t: t != "")
    return once(split, lambda tokens: once(F.array_join(tokens, ""), lambda s: counts(s, tokens)))


def readability_counts_sql(x: str) -> str:
    """Columns rather than a struct."""
    s = squeeze_sql(x)
    tokens = f"list_filter(regexp_split_to_array({x}, '{WS_D}+'), lambda t: t <> '')"
    return rf"""length({s}) AS chars, length(regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum,
length(regexp_replace({s}, '[^\x{{FFFD}}\x00-\x1f]', '', 'g')) AS bad, len({tokens}) AS tokens,
len(list_filter({tokens}, lambda t: regexp_matches(t, '{LETTER}{{3,}}') OR regexp_matches(t, '{NUMERIC_D}'))) AS wordlike"""


def four_places(x: Column) -> Column:
    """To four places as DuckDB rounds: by the double that is 10,000 times x. Spark would go by x's shortest decimal, and
    take 57 / 800, which is a little less than 0.07125, up."""
    return F.round(x * 10_000.0) / 10_000.0


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, four_places(part / whole)).otherwise(0.0)


def readability(x: Str) -> Column:
    """Struct of letter_digit_ratio, word_score, replacement_ratio, each to ``four_places``; zeros for no text."""
    return ratios(readability_counts(x))


def ratios(counts: Column) -> Column:
    return once(
        counts,
        lambda c: F.struct(
            ratio(c["alnum"], c["chars"]).alias("letter_digit_ratio"),
            F.when(c["chars"] > 0, ratio(c["wordlike"], c["tokens"])).otherwise(0.0).alias("word_score"),
            ratio(c["bad"], c["chars"]).alias("replacement_ratio"),
        ),
    )


def cleanup(x: Str) -> Column:
    """Ligatures spelt out, controls dropped, hyphenated line ends joined, runs of blanks and of empty lines cut."""
    t = _c(x)
    for code, plain in LIGATURES.items():
        t = F.replace(t, F.lit(chr(code)), F.lit(plain))
    t = F.regexp_replace(t, CONTROL, "")
    t = F.regexp_replace(t, HYPHEN, "$1$2")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def cleanup_sql(x: str) -> str:
    for code, plain in LIGATURES.items():
        x = f"replace({x}, chr({code}), '{plain}')"
    x = f"regexp_replace({x}, '{CONTROL}', '', 'g')"
    x = rf"regexp_replace({x}, '{HYPHEN}', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    return strip_sql(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def lines(x: Str) -> Column:
    """Lines by any Unicode line end; a final end makes no empty line."""
    return once(F.split(_c(x), LINE, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def lines_sql(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{LINE_D}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def _table_row(line: Column) -> Column:
    inner = F.regexp_replace(line, r"\A\|+|\|+\z", "")
    return F.when(F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")), F.array_join(F.transform(F.split(inner, r"\|", -1), strip), "\t")).otherwise(line)


def _unmarked(line: Column) -> Column:
    line = F.regexp_replace(_table_row(line), r"\A#{1,6}(?U)[\s\x1c-\x1f]+", "")
    return F.regexp_replace(F.regexp_replace(line, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`~]", "")


def markdown_to_text(x: Str) -> Column:
    """Markdown as plain text: table rows tab-joined, rules dropped, headings, links and emphasis unmarked."""
    kept = F.filter(F.transform(lines(x), strip), lambda v: ~(v.rlike(RULE_LINE) & F.contains(v, F.lit("-"))))
    return cleanup(F.array_join(F.transform(kept, _unmarked), "\n"))


def markdown_to_text_sql(x: str) -> str:
    strip_v = strip_sql("v")
    inner = r"regexp_replace(v, '\A\|+|\|+\z', '', 'g')"
    cells = rf"array_to_string(list_transform(regexp_split_to_array({inner}, '\|'), lambda c: {strip_sql('c')}), chr(9))"
    row = f"CASE WHEN starts_with(v, '|') AND ends_with(v, '|') THEN {cells} ELSE v END"
    bare = rf"regexp_replace(regexp_replace(regexp_replace({row}, '\A#{{1,6}}{WS_D}+', ''), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~]', '', 'g')"
    rule = rf"regexp_matches(v, '^\|?[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}:|-]+\|?$') AND contains(v, '-')"
    kept = f"list_filter(list_transform({lines_sql(x)}, lambda v: {strip_v}), lambda v: NOT ({rule}))"
    return cleanup_sql(f"array_to_string(list_transform({kept}, lambda v: {bare}), chr(10))")


def joined_markdown(parts: Str) -> Column:
    """Markdown of a result's parts (an array of arrays of strings): each part by lines, blanks dropped, paragraphs between."""
    each = F.transform(_c(parts), lambda p: strip(F.array_join(p, "\n")))
    return F.array_join(F.filter(each, lambda p: p != ""), "\n\n")


DEFAULT_PROMPT = "Transcribe everything legible on this page, top to bottom, as Markdown; give tables as Markdown tables and state what charts show. Add nothing of your own."


def prompt(x: Str) -> Column:
    """The prompt given, unchanged, or the default for a blank one."""
    return F.when(F.coalesce(strip(x), F.lit("")) == "", F.lit(DEFAULT_PROMPT)).otherwise(_c(x))


def checks(text: Str, kind: Str, value: Str, options: Str) -> Column:
    """Whether a text meets an assertion: contains a value, contains any of some, or has a length of at least a value."""
    t = _c(text)
    return (
        F.when(_c(kind) == "contains", F.contains(t, _c(value)))
        .when(_c(kind) == "contains_any", F.exists(_c(options), lambda o: F.contains(t, o)))
        .when(_c(kind) == "min_length", F.char_length(t) >= F.try_to_number(_c(value), F.lit("999999999")).cast("long"))
    )


def mapped(x: Str, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, _c(x)), default)

