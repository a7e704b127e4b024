"""Column functions of the cleaning rules: text, identifiers, numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, Unicode separators, U+0085 and the four information separators.
BLANK = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"
#: The dashes that alone make an identifier unusable.
DASHES = r"[\x{2D}\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}\x{2212}]"
MONEY = "decimal(38,6)"


def strip(c: Column) -> Column:
    """SF1: without wide blanks at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column) -> Column:
    """SF1: nothing but wide blanks."""
    return strip(c) == ""


def text(c: Column) -> Column:
    """SF2: null if null or blank, else stripped."""
    return F.nullif(strip(c), F.lit(""))


def null_if_blank(c: Column) -> Column:
    """SF14: null if blank, else exactly as it came."""
    return F.when(~is_blank(c), c)


def collapse(c: Column) -> Column:
    """SF3: runs of blanks become one space; ends stripped."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def label(c: Column) -> Column:
    """SF3: collapsed, empty when null."""
    return F.coalesce(collapse(c), F.lit(""))


def duration(c: Column, most: int = 64) -> Column:
    """SF4: at most ``most`` UTF-16 units, no surrogate pair split, stripped again.

    Characters beyond the basic plane count two: the cut is the longest prefix that fits.
    """
    t = text(c)
    wide = F.regexp_replace(t, r"([^\x{0}-\x{FFFF}])", "$1\u0000")  # one more place for each of them
    cut = F.regexp_replace(F.regexp_replace(F.substring(wide, 1, most), r"[^\x{0}-\x{FFFF}]$", ""), "\u0000", "")
    return F.when(F.char_length(wide) > most, strip(cut)).otherwise(t)


def code_of(c: Column) -> Column:
    """SF5: a cell up to its first blank."""
    return F.nullif(F.regexp_extract(strip(c), rf"^(\S+?)(?:{BLANK}|$)", 1), F.lit(""))


def description_of(c: Column) -> Column:
    """SF5: what follows the first blank, collapsed."""
    return F.nullif(collapse(F.regexp_extract(strip(c), rf"^\S+?{BLANK}+(?s)(.*)$", 1)), F.lit(""))


def fiscal_id(c: Column) -> Column:
    """SF6: canonical form: stripped, upper case."""
    return F.upper(strip(c))


def usable_fiscal_id(c: Column) -> Column:
    """SF7: canonical form, or null where it identifies nobody."""
    x = fiscal_id(c)
    return F.when((x != "") & ~x.rlike(f"^{DASHES}$") & ~x.rlike(f"^TEMP{DASHES}"), x)


def identifier_shaped(c: Column) -> Column:
    """SF8: 8 to 14 letters and digits with six digits at least."""
    return c.rlike("^[A-Za-z0-9]{8,14}$") & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 6)


def contractor_name(c: Column) -> Column:
    """SF10: the name in ``name TOKEN``; the whole cell if the token is no identifier."""
    token = F.regexp_extract(strip(c), rf"^(?s).*{BLANK}(\S+)$", 1)
    return F.when(identifier_shaped(token), strip(F.regexp_extract(strip(c), rf"^(?s)(.*){BLANK}\S+$", 1))).otherwise(strip(c))


def contractor_id(c: Column) -> Column:
    """SF10: the identifier in ``name TOKEN``, or null."""
    token = F.regexp_extract(strip(c), rf"^(?s).*{BLANK}(\S+)$", 1)
    return F.when(identifier_shaped(token), token)


def member_id(c: Column) -> Column:
    """SF11: the identifier in ``TOKEN - name``, or null."""
    return F.nullif(F.regexp_extract(strip(c), rf"^(\S+){BLANK}+-{BLANK}+(?s)(.+)$", 1), F.lit(""))


def member_name(c: Column) -> Column:
    """SF11: the name in ``TOKEN - name``, else the whole entry."""
    return F.coalesce(F.nullif(F.regexp_extract(strip(c), rf"^(\S+){BLANK}+-{BLANK}+(?s)(.+)$", 2), F.lit("")), strip(c))


def lot_key(c: Column) -> Column:
    """SF12: null for the whole procedure; leading zeros dropped, the last character kept."""
    x = strip(c)
    return F.when(~x.isin("", "_", "-"), F.regexp_replace(x, "^0+(?=.)", ""))


def published_key(c: Column) -> Column:
    """SF13: stripped; an error if nothing is left."""
    x = strip(c)
    return F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(F.raise_error(F.lit("a published key is missing")))


def echo(c: Column) -> Column:
    """SF17: on one line, 40 characters at most."""
    return F.substring(F.regexp_replace(c, r"[\r\n]+", " "), 1, 40)


def parse_amount(c: Column) -> Column:
    """NU1: 1.234.567,89 or 123,4 with an optional euro sign and tax remark; else null; no sign."""
    found = F.regexp_extract(collapse(c), r"^((?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?) ?€?(?: ?\(?(?:con|sen) [Ii][Vv][Ee]\)?)?$", 1)
    plain = F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.nullif(plain, F.lit("")).try_cast(MONEY)


def vat_basis(c: Column) -> Column:
    """NU2: the remark's con or sen."""
    word = F.lower(F.regexp_extract(collapse(c), r"(?i)\b(con|sen) IVE\b", 1))
    return F.when(word == "con", "INCLUSIVE").when(word == "sen", "EXCLUSIVE")


def parse_count(c: Column) -> Column:
    """NU3: a non-negative int or null."""
    x = strip(c).try_cast("int")
    return F.when(x >= 0, x)


def numeric_id(c: Column) -> Column:
    """NU4: a long or null."""
    return F.when(strip(c).rlike(r"^-?\d+$"), strip(c).try_cast("bigint"))


def listing_date(c: Column) -> Column:
    """DT1: dd-MM-yyyy, strictly; impossible dates are null."""
    return F.try_to_date(F.when(strip(c).rlike(r"^\d{2}-\d{2}-\d{4}$"), strip(c)), "dd-MM-yyyy")


def record_date(c: Column) -> Column:
    """DT2: as DT1, with an optional time that is checked and dropped."""
    x = collapse(c)
    forms = ((r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}$", "dd-MM-yyyy HH:mm"), (r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$", "dd-MM-yyyy HH:mm:ss"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.when(x.rlike(shape), x), F.lit(form))) for shape, form in forms])


def madrid_date(c: Column) -> Column:
    """DT4: the calendar date in Madrid of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(c, "Europe/Madrid"))


def publication_url(base: str, c: Column) -> Column:
    """PRJ2: the page of a publication."""
    return F.concat(F.lit(base.rstrip("/") + "/licitacion?N="), c.cast("string"))


def failure_reason(c: Column, most: int = 500) -> Column:
    """PRJ4: collapsed, null if empty, at most ``most`` characters with an ellipsis."""
    x = F.nullif(collapse(c), F.lit(""))
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)
