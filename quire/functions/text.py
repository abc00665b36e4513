"""Text expressions: normalising, tokens, stems, edit distances, passages.

NFKC and NFC have no built-in expression, so texts with characters beyond ASCII go through a pandas
UDF; the others reach it as nulls and are handled within the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

# fixed values: search terms must equal the reference's
TOKEN = "[a-z0-9]+(?:['-][a-z0-9]+)*"
STOP_WORDS = "a an and are as at be by did do does for from how i in is it of on or that the this to was were what when where which who why will with".split()
IRREGULAR = {
    "giving": "give", "renewal": "renew", "terminated": "terminate", "terminates": "terminate", "terminating": "terminate",
    "termination": "terminate"
}


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _beyond_ascii(text: Column) -> Column:
    """The text if it holds a character beyond ASCII, else null: all that a UDF need see."""
    return F.when(F.length(text) != F.octet_length(text), text)


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(_beyond_ascii(text)), text)


def folded(text: Column, exact: bool = True) -> Column:
    """NFKC and case folding. With exact=False lower case alone, all within the JVM; equal for
    texts without compatibility characters."""
    return F.coalesce(_nfkc(_beyond_ascii(text)), F.lower(text)) if exact else F.lower(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def normalize_text(text: Column, exact: bool = True) -> Column:
    """SC1 for strings: null is empty, punctuation and separators are spaces, symbols stay."""
    return F.coalesce(collapse(F.regexp_replace(folded(text, exact), "[\\p{P}\\p{Z}]", " ")), F.lit(""))


def normalize_list(values: Column, exact: bool = False) -> Column:
    """SC1 for lists: the sorted normalised items, joined by a bar."""
    return F.array_join(F.sort_array(F.filter(F.transform(values, lambda v: normalize_text(v, exact)), lambda v: v != "")), " | ")


def shortest(number: Column) -> Column:
    """A double in the fewest digits that give it back; a cast to string may take more before Java 19."""
    real = number.cast("double")
    tries = [F.format_string(f"%.{digits}e", real) for digits in (14, 15, 16)]
    return F.coalesce(*[F.when(t.cast("double") == real, t) for t in tries[:2]], tries[2])


def canonical_number(number: Column) -> Column:
    """SC2: all digits, no exponent, no trailing zeros, no negative zero."""
    plain = F.lower(F.when(F.typeof(number) == "double", shortest(number)).otherwise(number.cast("string")))
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.substring_index(plain, "e", 1), "^-", "")
    power = F.when(plain.contains("e"), F.substring_index(plain, "e", -1)).otherwise("0").try_cast("int")
    whole = F.substring_index(mantissa, ".", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    point = F.length(whole) + power
    n = F.length(digits)
    placed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    )
    cut = F.when(placed.contains("."), F.regexp_replace(placed, "\\.?0+$", "")).otherwise(placed)
    cut = F.when(
        F.regexp_replace(cut, "^0+(?=\\d)", "").isin("0", ""), "0"
    ).otherwise(F.concat(sign, F.regexp_replace(cut, "^0+(?=\\d)", "")))
    return F.when(plain.rlike("^-?(nan|inf)"), F.replace(plain, F.lit("infinity"), F.lit("inf"))).otherwise(cut)


def normalize_typed(value: Column, kind: DataType, exact: bool = False) -> Column:
    """SC1 by type: flags, numbers, lists (sorted items), maps and structs (sorted pairs), texts."""
    joined = lambda items: F.array_join(F.sort_array(F.filter(items, lambda v: F.trim(v) != "")), " | ")
    pair = lambda k, v: F.concat(k, F.lit(" "), v)
    if isinstance(kind, BooleanType):
        return F.coalesce(value.cast("string"), F.lit(""))
    if isinstance(kind, NumericType):
        return F.coalesce(canonical_number(value), F.lit(""))
    if isinstance(kind, ArrayType):
        return F.coalesce(joined(F.transform(value, lambda v: normalize_typed(v, kind.elementType, exact))), F.lit(""))
    if isinstance(kind, MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: pair(normalize_typed(e["key"], kind.keyType, exact), normalize_typed(e["value"], kind.valueType, exact))
        )
        return F.coalesce(joined(pairs), F.lit(""))
    if isinstance(kind, StructType):
        return joined(
            F.array(
                *[
                    pair(
                        normalize_text(F.lit(f.name), exact), normalize_typed(value[f.name], f.dataType, exact)
                    ) for f in kind.fields
                ]
            )
        )
    return normalize_text(value.cast("string"), exact)


def substantive(value: Column, kind: DataType) -> Column:
    """Null, blank texts and empty collections are no value; false and 0 are."""
    if isinstance(kind, StringType):
        return F.coalesce(~value.rlike("(?U)^\\s*$"), F.lit(False))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def stem(token: Column) -> Column:
    """SC8: the first rule that applies."""
    n, cut = F.length(token), lambda k: F.left(token, F.greatest(F.length(token) - k, F.lit(0)))
    out = F.when(token == F.lit("giving"), "give")
    for word, base in IRREGULAR.items():
        out = out.when(token == word, base)
    out = out.when(
        token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))
    ).when(token.endswith("ing") & (n > 5), cut(3)).when(token.endswith("ed") & (n > 4), cut(2))
    out = out.when(token.rlike("(sses|xes|zes|ches|shes)$") & (n > 4), cut(2)).when(
        token.endswith("s") & ~token.endswith("ss") & (n > 3), cut(1)
    )
    return out.otherwise(token)


def raw_tokens(text: Column, exact: bool = True) -> Column:
    return F.regexp_extract_all(folded(text, exact), F.lit(TOKEN), F.lit(0))


def is_term(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(STOP_WORDS)


def tokenize(text: Column, exact: bool = True) -> Column:
    """SC7: stems of the tokens that are no stop word and longer than one character. Where tokens are rows,
    ``raw_tokens``, ``is_term`` and ``stem`` give the same within compiled code, which lambdas leave."""
    return F.transform(F.filter(raw_tokens(text, exact), is_term), stem)


def tokens_f1(a: Column, b: Column) -> Column:
    """SC4 over two token arrays: both empty 1, one empty 0, repeats count."""
    both = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda s,
        t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )
    return F.when(
        (F.size(a) == 0) & (F.size(b) == 0), 1.0
    ).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def with_token_f1(df, reference: str, prediction: str, name: str = "token_f1", exact: bool = True):
    """Adds SC4 of two columns. The token arrays are columns of their own first, as an expression
    inside a lambda may hold no Python UDF."""
    for c, at in ((reference, "_a"), (prediction, "_b")):
        df = df.withColumn(at, split_words(normalize_text(F.col(c), exact)))
    return df.withColumn(name, tokens_f1(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def exact_match(reference: Column, prediction: Column, exact: bool = True) -> Column:
    return (normalize_text(reference, exact) == normalize_text(prediction, exact)).cast("double")


def word_errors(a: Column, b: Column) -> Column:
    """SC9 over words: each distinct word of the pair becomes one private code point, then levenshtein."""
    words = F.array_distinct(F.concat(split_words(a), split_words(b)))
    as_chars = lambda t: F.array_join(F.transform(split_words(t), lambda w: _char(F.array_position(words, w) + 0xF0000)), "")
    return F.levenshtein(as_chars(a), as_chars(b))


def _char(code: Column) -> Column:
    """The code point as UTF-8: four bytes."""
    byte = lambda shift, base: F.lpad(
        F.hex((F.call_function("shiftright", code, F.lit(shift)).bitwiseAND(F.lit(0x3F).cast("long")) + base).cast("long")), 2,
        "0"
    )
    lead = F.lpad(F.hex((F.call_function("shiftright", code, F.lit(18)) + 0xF0).cast("long")), 2, "0")
    return F.decode(F.unhex(F.concat(lead, byte(12, 0x80), byte(6, 0x80), byte(0, 0x80))), "UTF-8")


def error_rate(errors: Column, length: Column) -> Column:
    """An empty reference has rate 0 without errors, else 1."""
    return F.when(length == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / length)


HEADING_LINE = "^\\s*\\d+\\.\\s+.+$"


def heading_line(text: Column) -> Column:
    """At most eight words, no sentence mark, and numbered, all upper or Title Case."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    shape = text.rlike(HEADING_LINE) | (F.upper(text) == text) | F.forall(words, lambda w: w.rlike("^[A-Z]"))
    return F.size(words).between(1, 8) & ~text.rlike("[.!?]") & shape


def passages(text: Column) -> Column:
    """SC12: sentences without the heading lines before them."""
    stripped = lambda t: F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")

    def body(part: Column) -> Column:
        lines = F.split(part, "\n")
        # blank lines among the headings go with them; the last line always stays
        lead = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: heading_line(stripped(x)) | (stripped(x) == ""))
        stop = F.array_position(lead, False)
        at = F.when(stop > 0, stop.cast("int")).otherwise(F.size(lines))
        return F.when(part.contains("\n"), stripped(F.array_join(F.slice(lines, at, F.size(lines)), "\n"))).otherwise(part)

    parts = F.transform(F.split(text, "(?<=[.!?])(?U:\\s+)"), stripped)
    return F.filter(F.transform(parts, body), lambda p: p != "")
