"""Scalar text functions as Columns.  Only NFKC needs Python, and only texts with characters that it may change go there."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches

#: White space as Unicode has it; Java's \s alone is ASCII.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same as characters, for trims: they look at both ends only, where a pattern looks at every blank of the text.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What NFKC may change: all but ASCII, letters and marks of Latin, Greek and Cyrillic that have no other form, common
#: punctuation, kana, ideographs and Hangul syllables.
UNSTABLE = r"[^\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u02AF\u0388-\u03CE\u0400-\u0482\u048A-\u052F\u2010\u2012-\u2016\u2018-\u2023\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]"
#: Words that are no entity by themselves.
STOPWORDS = "The A An This That These Those He She It They We I You In On At By For From To With Of And Or But If Then So As Is Are Was Were Be Been Being Chapter Section Figure Table".split()
#: Last words of organisations, and words of places.
ORG_SUFFIXES = "Inc Ltd LLC Company Corporation Corp University Institute Agency Bank Labs Lab Technologies Systems".split()
LOCATION_HINTS = "City Town Village State Country Street Road River Mountain Lake Park".split()
#: Pronouns, and those of them that are possessive.
PRONOUNS = "he him his she her hers they them their theirs it its you your yours we us our ours i me my mine".split()
POSSESSIVES = "his her hers their theirs its your yours our ours my mine".split()

#: Fixed value: what a capitalised phrase is.
CAPITALISED = r"(?U)\b(?:[A-Z][a-zA-Z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-zA-Z]+|[A-Z]{2,}))*\b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"[^\s\x1c-\x1f\x85\p{{Z}}]+"))


def token_estimate(c: Column) -> Column:
    """Words times 1.3, halves to even."""
    return F.bround(word_count(c) * F.lit(1.3)).cast("int")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def may_change(c: Column) -> Column:
    """Whether NFKC may change a text.  ASCII texts are known by their lengths; in others only characters beyond ASCII
    meet the long list of ranges."""
    return (F.octet_length(c) != F.char_length(c)) & c.rlike(f"(?=[^\\x00-\\x9F]){UNSTABLE}")


def normalize(c: Column, nfkc: bool = True) -> Column:
    """NFKC; one line-end style; runs of blanks to one; single line breaks to blanks; at most one empty line; strip.
    Blanks go first, so a blank beside a line break leaves two, and a line of blanks is no empty line.

    As a Column it sends every row past Python if ``nfkc``; :func:`normalized` doesn't."""
    text = F.coalesce(c, F.lit(""))
    if nfkc:
        text = F.coalesce(_nfkc(F.when(may_change(text), text)), text)
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    # texts without what a pattern looks for don't meet it
    has = lambda part: F.contains(text, F.lit(part))
    text = F.when(has("  ") | has("\t"), F.regexp_replace(text, "[ \t]+", " ")).otherwise(text)
    broken = F.regexp_replace(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "), r"\n{3,}", "\n\n")
    return strip(F.when(F.contains(text, F.lit("\n")), broken).otherwise(text))


def normalized(docs: DataFrame, column: str = "text", nfkc: bool = True) -> DataFrame:
    """``docs`` with the column normalised.  Rows that NFKC may change are a branch of their own, so no others are near
    Python; the price is a second scan of the column, which costs less than a worker for every row."""
    if not nfkc:
        return docs.withColumn(column, normalize(F.col(column), False))
    small_batches(docs.sparkSession)
    odd = may_change(F.coalesce(column, F.lit("")))
    plain = docs.where(~odd).withColumn(column, normalize(F.col(column), False))
    changed = docs.where(odd).withColumn(column, _nfkc(column)).withColumn(column, normalize(F.col(column), False))
    return plain.unionByName(changed)


#: Lengths that are summed in one go: within a block the work grows with its square, so an array's with its length.
SUM_BLOCK = 256


def prefix_sums(df: DataFrame, lengths: Column, name: str) -> DataFrame:
    """``df`` with an array of 0 and the sums of the first 1, 2, ... lengths: sums within blocks, then on top of them the
    sums of the blocks before.  Each step is a projection of its own, so that none is computed twice."""
    running = lambda values: F.aggregate(values, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    last = F.greatest(F.size("_lengths") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / SUM_BLOCK).cast("int")), lambda b: F.slice("_lengths", b * SUM_BLOCK + 1, SUM_BLOCK))
    df = df.withColumn("_lengths", lengths).withColumn("_within", F.transform(blocks, running))
    df = df.withColumn("_before", running(F.transform("_within", lambda x: F.element_at(x, -1))))
    shifted = F.flatten(F.transform("_within", lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get("_before", i))))
    return df.withColumn(name, F.concat(shifted, F.array(F.element_at("_before", -1)))).drop("_lengths", "_within", "_before")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Parts between empty lines, which may hold blanks."""
    return F.filter(F.transform(F.split(c, rf"\n{WS}*\n"), strip), lambda s: s != "")


def capitalised_phrases(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(CAPITALISED), F.lit(0)), collapse)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def valid_candidate(name: Column) -> Column:
    return (F.char_length(name) >= 2) & ~name.isin(STOPWORDS) & ~name.rlike("^[0-9]+$")


def guess_label(name: Column) -> Column:
    w = F.split(name, " ")
    return (
        F.when((F.size(w) >= 2) & F.element_at(w, -1).isin(ORG_SUFFIXES), "Organization")
        .when(F.arrays_overlap(w, F.array(*map(F.lit, LOCATION_HINTS))), "Location")
        .when((F.size(w) == 1) & name.rlike("^[A-Z]{2,}$"), "Organization")
        .when(F.size(w) >= 2, "Person")
        .otherwise("Concept")
    )


def surface(c: Column) -> Column:
    """Lower case, letters, digits, hyphens and apostrophes only, one leading article dropped."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    text = strip(F.regexp_replace(F.regexp_replace(text, rf"[^a-z0-9\-'\s\x1c-\x1f\x85\p{{Z}}]", " "), f"{WS}+", " "))
    return F.regexp_replace(text, rf"^(?:the|a|an) +", "")


def singular_word(w: Column) -> Column:
    """Suffix rules: -ies to -y; -es after s, x, z, ch and sh; -s but not -ss, -us or -is."""
    n = F.char_length(w)
    return (
        F.when(w.rlike("[^aeiou]ies$") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.rlike("(?:s|x|z|ch|sh)es$") & (n > 4), F.left(w, n - 2))
        .when(w.rlike("[^sui]s$") & (n > 2), F.left(w, n - 1))
        .otherwise(w)
    )


def last_word(phrase: Column) -> Column:
    return F.regexp_extract(phrase, r"([^ ]*)$", 1)


def but_last_word(phrase: Column) -> Column:
    """All before the last word, with the blank between."""
    return F.regexp_extract(phrase, r"^(.* )?[^ ]*$", 1)


def singular(phrase: Column) -> Column:
    """The last word in the singular."""
    return F.concat(but_last_word(phrase), singular_word(last_word(phrase)))


def restore_case(normal: Column, original: Column) -> Column:
    """All capitals, or a capital for each word, as the original begins."""
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))
    return (
        F.when(normal == "", original)
        .when((F.upper(original) == original) & (F.lower(original) != original), F.upper(normal))
        .when(F.left(original, F.lit(1)).rlike(r"^\p{Lu}"), F.array_join(F.transform(F.split(normal, " "), capital), " "))
        .otherwise(normal)
    )


def bare_mention(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z']", ""))


def is_pronoun(c: Column) -> Column:
    return bare_mention(c).isin(PRONOUNS)


def pronoun_form(canonical: Column, mention: Column) -> Column:
    owned = F.concat(canonical, F.when(canonical.endswith("s"), "'").otherwise("'s"))
    return F.when(bare_mention(mention).isin(POSSESSIVES), owned).otherwise(canonical)


def relation_type(c: Column) -> Column:
    """A type as the graph store takes it."""
    text = F.upper(strip(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.when(text == "", "RELATED_TO").when(text.rlike("^[0-9]"), F.concat(F.lit("REL_"), text)).otherwise(text)


def spoken_type(c: Column) -> Column:
    return F.replace(F.upper(c), F.lit(" "), F.lit("_"))


def without_fence(c: Column) -> Column:
    """A model's answer without its code fence."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text.startswith("```"), strip(F.regexp_replace(F.regexp_replace(text, rf"^```[a-zA-Z]*{WS}*", ""), rf"{WS}*```$", ""))).otherwise(text)


def outer_json(c: Column) -> Column:
    """From the first opening brace to the last closing one; an error if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.raise_error(F.lit("the model did not return a JSON object")))


def snippet(source: Column, terms: list[Column], window: int = 140) -> Column:
    """About ``window`` characters around the first term that is found; else the beginning."""
    text = strip(F.coalesce(source, F.lit("")))
    low, half = F.lower(text), window // 2
    at, length = F.lit(-1), F.lit(0)
    for t in reversed(terms):
        clean = strip(F.coalesce(t, F.lit("")))
        found = F.when(clean == "", 0).otherwise(F.instr(low, F.lower(clean)))
        at, length = F.when(found > 0, found - 1).otherwise(at), F.when(found > 0, F.char_length(clean)).otherwise(length)
    n = F.char_length(text)
    start, end = F.greatest(F.lit(0), at - half), F.least(n, at + length + half)
    inner = strip(F.substring(text, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < n, "...").otherwise(""))
    head = F.when(n <= window, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(window)), F.lit(BLANKS)), F.lit("...")))
    return F.when(text == "", "").when(at < 0, head).otherwise(around)


def node_id(document_id: Column, label: Column, name: Column) -> Column:
    return F.concat(document_id.cast("string"), F.lit(":"), label, F.lit(":"), name)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit("-"), kind, F.lit("-"), target)


def safe_filename(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def progress(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


#: Display colours of labels.
COLOURS = {"Person": "#3b82f6", "Location": "#10b981", "Organization": "#f59e0b", "Concept": "#6b7280"}


def colour(label: Column) -> Column:
    out = F.lit("#8b5cf6")
    for k, v in COLOURS.items():
        out = F.when(label == k, v).otherwise(out)
    return out
