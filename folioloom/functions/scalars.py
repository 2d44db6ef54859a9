"""Column expressions; everything here stays inside whole-stage code generation unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Runs of spaces as one space."""
    return F.regexp_replace(col(c), " {2,}", " ")


def to_int(c: Column | str) -> Column:
    """Integer of a decimal string, or null; '2.0' is not one."""
    return F.expr("null") if c is None else strip(c).try_cast("int")


def natural_key(c: Column | str) -> Column:
    """Sort key of a number with a suffix: 999 < 1000 < 1053 < 1053A; null first of all."""
    digits = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^\d*", 0)
    rest = F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\d*", ""))
    return F.struct(F.coalesce(blank_to_null(digits).try_cast("bigint"), F.lit(0)).alias("number"), rest.alias("suffix"))


def natural_text(c: Column | str) -> Column:
    """The same key as text: ten digits, a bar, the suffix."""
    k = natural_key(c)
    return F.concat(F.format_string("%010d", k.getField("number")), F.lit("|"), k.getField("suffix"))


def scan_order(filename: Column | str) -> Column:
    """Number at the end of a file name, before trailing letters: …_0571A is 571, …_P01 none."""
    return blank_to_null(F.regexp_extract(col(filename), r"_(\d+)[A-Za-z]*$", 1)).try_cast("int")


def scan_type(c: Column | str) -> Column:
    v = F.lower(strip(c))
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(None)).when(v == "single", "Single").when(v == "double", "Double").otherwise("Other")


def effective_end(start: Column | str, end: Column | str) -> Column:
    """End of a folio range; a missing or smaller end means one folio."""
    return F.when(col(end) >= col(start), col(end)).otherwise(col(start))


def folio_numbers(c: Column | str) -> Column:
    """Whole numbers of a comma-separated list; other parts are dropped."""
    parts = F.transform(F.split(col(c), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    numbers = F.filter(F.transform(F.filter(parts, lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    # Most pages have one number, which needs no list to be taken apart.
    return F.when(col(c).rlike(r"^[0-9]{1,9}\z"), F.array(col(c).try_cast("int"))).otherwise(numbers)


def confidence_rank(c: Column | str) -> Column:
    """0 is strongest; an unknown value ranks weakest."""
    at = F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), col(c))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(CONFIDENCE) - 1)).cast("int")


def confidence_from_number(c: Column | str) -> Column:
    """A legacy numeric confidence as a named one; named ones stay."""
    v = col(c).cast("string").try_cast("double")
    return F.when(col(c).cast("string").isin(CONFIDENCE), col(c).cast("string")).when(v == 1.0, "DEFINITIVE").when(v == 0.8, "FOLIO_RANGE").otherwise("CANDIDATE")


def day(c: Column | str) -> Column:
    """A full ISO date, else null."""
    c = col(c)
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))


def _compact(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def day_from(c: Column) -> Column:
    """First day that a year, month, compact or full date means inside a range."""
    n = F.length(c)
    return F.when(n == 4, F.try_to_date(F.concat(c, F.lit("-01-01")))).when(n == 7, F.try_to_date(F.concat(c, F.lit("-01")))).when(n == 8, _compact(c)).otherwise(day(c))


def day_to(c: Column) -> Column:
    """Last day that it means."""
    n = F.length(c)
    return F.when(n == 4, F.try_to_date(F.concat(c, F.lit("-12-31")))).when(n == 7, F.last_day(F.try_to_date(F.concat(c, F.lit("-01"))))).when(n == 8, _compact(c)).otherwise(day(c))


def dates_of(strings: Column | str) -> Column:
    """(first, last) day of a list of date strings; a bare year and month, or anything unreadable, voids the whole list."""

    def pair(s: Column) -> Column:
        a, b = F.split_part(s, F.lit("/"), F.lit(1)), F.split_part(s, F.lit("/"), F.lit(2))
        ranged = F.struct(day_from(a).alias("a"), day_to(b).alias("b"))
        single = F.struct(F.when(F.length(s) != 7, day_from(s)).alias("a"), F.when(F.length(s) != 7, day_to(s)).alias("b"))
        return F.when(s.contains("/"), ranged).otherwise(single)

    pairs = F.transform(col(strings), pair)
    bad = F.exists(pairs, lambda p: p.a.isNull() | p.b.isNull()) | (F.size(col(strings)) <= 0)
    days = F.concat(F.transform(pairs, lambda p: p.a), F.transform(pairs, lambda p: p.b))
    return F.when(~bad, F.struct(F.array_min(days).alias("first"), F.array_max(days).alias("last")))


def date_range(c: Column | str) -> Column:
    """(begin, end) of 'X/Y' or of one date, which is both."""
    s = strip(c)
    begin = day(F.split_part(s, F.lit("/"), F.lit(1)))
    end = F.when(s.contains("/"), day(F.split_part(s, F.lit("/"), F.lit(2)))).otherwise(begin)
    return F.struct(begin.alias("begin"), end.alias("end"))


def year_start(c: Column | str) -> Column:
    y = to_int(c)
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))


def year_end(c: Column | str) -> Column:
    y = to_int(c)
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(12), F.lit(31)))


def uuid_or_null(c: Column | str) -> Column:
    """A UUID in lower case with dashes; braces, urn: and missing dashes are accepted, anything else is null."""
    hexes = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^urn:|uuid:|[{}]", ""), "-", "")
    return F.when(hexes.rlike("^[0-9a-f]{32}$"), F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def type_ids(c: Column | str) -> Column:
    """UUIDs at the ends of a ';' list of URIs, distinct, in order."""
    ids = F.transform(F.split(col(c), ";"), lambda u: uuid_or_null(F.element_at(F.split(F.regexp_replace(u, r"^\s+|\s+$|/+\s*$", ""), "/"), -1)))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def image_url(info: Column | str, size: str = "full") -> Column:
    return F.replace(col(info), F.lit("info.json"), F.lit(f"full/{size}/0/default.jpg"))


def slug(c: Column | str) -> Column:
    """Lower case, spaces and underscores as dashes, other marks dropped; 'unknown' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[\s_]+", "-"), r"[^a-z0-9-]", "")
    return F.coalesce(blank_to_null(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")), F.lit("unknown"))


def date_label(text: Column, earliest_begin: Column, latest_begin: Column, earliest_end: Column, latest_end: Column) -> Column:
    """Human-readable dates of a document. Equal end dates are told only where there is no beginning."""
    begin = F.when(earliest_begin.isNotNull() & latest_begin.isNotNull(), F.when(earliest_begin == latest_begin, earliest_begin.cast("string")).otherwise(F.concat_ws(" - ", earliest_begin, latest_begin))).when(earliest_begin.isNotNull(), F.concat(F.lit("From "), earliest_begin))
    end = F.when(
        earliest_end.isNotNull() & latest_end.isNotNull(),
        F.when(earliest_end == latest_end, F.when(begin.isNull(), F.concat(F.lit("Until "), earliest_end))).otherwise(F.concat(F.lit("to "), F.concat_ws(" - ", earliest_end, latest_end))),
    )
    return F.coalesce(blank_to_null(text), blank_to_null(F.concat_ws(" ", begin, end)), F.lit("Unknown date"))


def inventory_date_label(start: Column, end: Column) -> Column:
    """An inventory with an end date only counts as unknown."""
    return F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" - ", start, end)).when(start.isNotNull(), F.concat(F.lit("From "), start)).otherwise("Unknown")


def feature_labels(is_blank: Column, marginalia: Column, table: Column, illustration: Column, printed: Column, signatures: Column) -> Column:
    found = F.concat_ws(", ", F.when(is_blank, "Blank"), F.when(marginalia, "Marginalia"), F.when(table, "Table"), F.when(illustration, "Illustration"), F.when(printed, "Print"), F.when(F.coalesce(signatures, F.lit("")) != "", "Signature"))
    return F.coalesce(blank_to_null(found), F.lit("No features"))


def folio_label(start: Column, end: Column) -> Column:
    return F.when(end.isNotNull() & (end != start), F.concat_ws(" – ", start, end)).otherwise(start.cast("string"))


def page_label(number: Column, side: Column, page_id: Column) -> Column:
    """Fol. 12r, Page 12, or Physical Page with the beginning of the id."""
    have = F.coalesce(number, F.lit("")) != ""
    return F.when(have & side.isin("Recto", "Verso"), F.concat(F.lit("Fol. "), number, F.lower(F.substring(side, 1, 1)))).when(have, F.concat(F.lit("Page "), number)).otherwise(F.concat(F.lit("Physical Page "), F.substring(page_id, 1, 8)))


def side_order(side: Column | str) -> Column:
    """Verso before recto before the rest: on a double scan the left page is the verso of the leaf before."""
    return F.when(col(side) == "Verso", 1).when(col(side) == "Recto", 2).otherwise(3)


def inventory_of_file(filename: Column | str) -> Column:
    """Second-last part of a file name whose last part is a number."""
    parts = F.split(col(filename), "_")
    return F.when((F.size(parts) >= 2) & F.element_at(parts, -1).rlike(r"^\d+$"), F.try_element_at(parts, F.lit(-2)))


def padded_filename(filename: Column | str) -> Column:
    """The file name with its last number at four digits at least."""
    n = F.regexp_extract(col(filename), r"_(\d+)$", 1).try_cast("int")
    padded = F.when(n < 1000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return F.when(n.isNotNull(), F.concat(F.regexp_replace(col(filename), r"_\d+$", "_"), padded)).otherwise(col(filename))


def placeholder(c: Column | str) -> Column:
    """Whether a value is a spreadsheet error or a dash, with or without question marks."""
    return F.coalesce(F.rtrim(F.lower(strip(c)), F.lit("?")).isin("#name", "-"), F.lit(False))


def languages(c: Column | str) -> Column:
    """Codes of a comma list, lower-case, distinct, in order, without empty and unknown ones."""
    codes = F.transform(F.split(col(c), ","), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(codes, lambda x: ~x.isin("", "unknown")))


def same_as(c: Column | str) -> Column:
    return blank_to_null(strip(F.regexp_extract(col(c), r"(?i)^\s*SAME AS\s+(.+)$", 1)))


def contains_folded(c: Column | str, wanted: str) -> Column:
    """Case-insensitive substring test; % and _ are ordinary characters."""
    return F.coalesce(F.lower(col(c)).contains(wanted.lower()), F.lit(False))


def coverage(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total * 100).otherwise(F.lit(0.0))


def name_id(*parts: Column | str) -> Column:
    """Deterministic id of a natural key: a name-based hash in UUID form."""
    h = F.md5(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("\u001e")) for p in parts]))
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
