"""Scalar functions: parsing, rounding, ratios, dates, labels, levels. All are column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bourse.functions.frames import clamp, col, ratio

MISSING = ("", "NA", "N/A", "-", "NULL", "NONE", "NAN")
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}


def clean_text(c) -> Column:
    text = F.trim(col(c))
    return F.when(~F.upper(text).isin(*MISSING), text)


def parse_number(c) -> Column:
    """'79,580,500', '28.41m', '-12.48' to double; anything unreadable is NULL, never zero."""
    text = F.regexp_replace(F.lower(clean_text(c)), r"[,%\s]", "")
    scale = F.when(text.endswith("k"), 1e3).when(text.endswith("m"), 1e6).when(text.endswith("b"), 1e9).otherwise(1.0)
    return F.regexp_replace(text, "[kmb]$", "").try_cast("double") * scale


def round_decimal(c, digits: int) -> Column:
    """ROUND as on an exact decimal: half away from zero on the written digits."""
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def round_js(c, digits: int) -> Column:
    """Math.round: halves go towards positive infinity."""
    return F.floor(col(c) * 10**digits + 0.5) / 10**digits


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def pct_change_abs(now, before) -> Column:
    return 100 * ratio(col(now) - col(before), F.abs(col(before)))


def cagr(latest, base, years: float) -> Column:
    """Annual growth in percent; undefined unless both ends are positive."""
    return F.when((col(latest) > 0) & (col(base) > 0), (F.pow(ratio(latest, base), F.lit(1.0 / years)) - 1) * 100)


def bounded_revision(now, before, limit: float = 1.0) -> Column:
    change = ratio(now, before) - 1
    return F.when((F.signum(col(now)) == F.signum(col(before))) & (F.abs(change) <= limit), change)


def title_key(c) -> Column:
    """Lower case, one space between words, nothing but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", " "))


def fiscal_year(c) -> Column:
    """'FY2024', 'Mar 24', 'fy 24' to a four-digit year."""
    digits = F.regexp_extract(F.lower(col(c)), r"(?:fy|mar)\s*'?(\d{4}|\d{2})\b", 1)
    return F.when(F.length(digits) == 4, digits.cast("int")).when(F.length(digits) == 2, 2000 + digits.cast("int"))


def surveillance_stage(c) -> Column:
    """'Stage IV' or 'stage 2' in a text; 0 when no stage is named."""
    token = F.upper(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)\bstage\s+([ivx]+|\d+)\b", 1))
    roman = F.coalesce(*[F.when(token == r, n) for r, n in ROMAN.items()])
    return F.coalesce(token.try_cast("int"), roman, F.lit(0))


DATE_FORMATS = ("yyyy-MM-dd", "d MMM yyyy", "d-MMM-yyyy", "dd/MM/yy")
TIME_FORMATS = ("d-MMM-yyyy HH:mm:ss", "d-MMM-yyyy HH:mm")


def _month_case(text: Column) -> Column:
    """Month names as the formatter wants them: one capital."""
    return F.initcap(F.regexp_replace(F.lower(F.regexp_replace(text, "[,]", " ")), r"\s+", " "))


def parse_date(c) -> Column:
    """The first format that fits, in a fixed order; 'JUN 2026' is its month's last day."""
    text = F.trim(col(c))
    # initcap only capitals after blanks, so a dashed month is split first.
    dashed = F.regexp_replace(text, r"^(\d{1,2})-([A-Za-z]{3})[a-z]*-(\d{4}).*$", "$1 $2 $3")
    worded = _month_case(dashed)
    tries = [F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(worded, F.lit("d MMM yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yy"))]
    month = F.last_day(F.try_to_timestamp(F.concat(F.lit("1 "), worded), F.lit("d MMM yyyy")).cast("date"))
    return F.coalesce(*[t.cast("date") for t in tries], month)


def parse_timestamp(c) -> Column:
    """'05-Feb-2022 22:37[:04]'; a bare date gives NULL rather than a made-up midnight."""
    text = _month_case(F.regexp_replace(F.trim(col(c)), r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})", "$1 $2 $3"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm")))


def quarter_end(d) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "quarter"), 2))


def fiscal_year_end(d, month: int = 3) -> Column:
    d = col(d)
    return F.last_day(F.make_date(F.year(d) + F.when(F.month(d) > month, 1).otherwise(0), F.lit(month), F.lit(1)))


def last_weekday_of_month(d, day: str) -> Column:
    """Last Thursday, Tuesday, … of the date's month."""
    return F.next_day(F.date_sub(F.last_day(col(d)), 7), day)


def liquidity_tier(adt_cr, thin: float = 5.0, floor: float = 1.0) -> Column:
    a = col(adt_cr)
    return F.when(a < floor, "untradable").when(a < thin, "thin").when(a.isNotNull(), "ok")


def bucket(c, edges, labels) -> Column:
    """First label whose edge the value reaches, highest edge first."""
    out = F.lit(None).cast("string")
    for edge, label in sorted(zip(edges, labels)):
        out = F.when(col(c) >= edge, label).otherwise(out)
    return out


HORIZONS = {"INTRADAY": "INTRADAY", "DAY": "INTRADAY", "1D": "INTRADAY", "SWING": "SWING", "SHORT_TERM": "SWING", "POSITIONAL": "POSITIONAL",
            "MEDIUM_TERM": "POSITIONAL", "LONG_TERM": "LONG_TERM", "INVESTMENT": "LONG_TERM"}


def canonical_horizon(c, default: str = "POSITIONAL") -> Column:
    key = F.regexp_replace(F.upper(F.trim(col(c))), r"[\s-]+", "_")
    return F.coalesce(*[F.when(key == k, v) for k, v in HORIZONS.items()], F.lit(default))


def reward_risk(entry, stop, target) -> Column:
    """Long-side reward over risk; NULL for inverted levels."""
    e, s, t = col(entry), col(stop), col(target)
    return F.when((s > 0) & (e > s) & (t > e), ratio(t - e, e - s))


def atr_levels(price, atr, long: Column, digits: int | None = 2) -> tuple[Column, Column]:
    """Target and stop as ATR multiples within percent guard rails; without ATR the rails' floor."""
    # Multiples, floors and caps of the barriers.
    stop_mult, target_mult, stop_floor, stop_cap, target_floor, target_cap = 1.5, 2.5, 0.02, 0.08, 0.03, 0.15
    price = col(price)
    share = F.coalesce(F.when(col(atr) > 0, col(atr) / price), F.lit(0.0))
    stop, target = clamp(stop_mult * share, stop_floor, stop_cap), clamp(target_mult * share, target_floor, target_cap)
    side = F.when(long, 1.0).otherwise(-1.0)
    levels = price * (1 + side * target), price * (1 - side * stop)
    return levels if digits is None else tuple(F.round(x, digits) for x in levels)


def content_id(*cols) -> Column:
    return F.sha2(F.concat_ws("|", *cols), 256)


def norm(c) -> Column:
    """Lower-case tokens with single blanks; the ampersand stays for names such as L&T."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9&]+", " "))
