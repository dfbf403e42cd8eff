"""Dates and times in mixed notations, precisions and zones, normalised to one unambiguous form.

Steps: (1) one alternation of anchored notations cuts the dates out of a line; (2) each token is
taken apart by the expression of its notation; (3) the zone of times written without one is
estimated, for the whole table or for each group of records (an entity, a source, an account), by
choosing, among candidate offset histories, the one with the fewest violations of sequence order (a
start after its end) and of ingestion time (an event after it was stored); (4) local times are
converted with that history. All steps are JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.session import durable, small_enough_to_broadcast

# Notations of dates and zones.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)[a-z]*"
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "CST": "+08:00", "EST": "-05:00", "EDT": "-04:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "WET": "+00:00", "WEST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "BST": "+01:00", "MSK": "+03:00",
    "IST": "+05:30", "HKT": "+08:00", "SGT": "+08:00", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00",
    "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
}
AREAS = "Africa|America|Antarctica|Asia|Atlantic|Australia|Etc|Europe|Indian|Pacific"
ZONE = (
    r"(?:\s?(Z(?![A-Za-z])|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[+-](?:0\d|1[0-4]):?[0-5]\d(?![\d./年-])"
    rf"|(?:{'|'.join(sorted(ABBREVIATIONS, key=lambda z: (-len(z), z)))})(?![A-Za-z])|(?:{AREAS})/[A-Z][A-Za-z_]+))?"
)
CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)"
CN_DIGITS = "〇零一二三四五六七八九"
OPEN_END = r"(?i)至今|现在|目前|迄今|\b(?:present|current|now)\b|[-–—~～→至到]\s*今"


@dataclass(frozen=True)
class Notation:
    """A notation's pattern and, per part, the number of its group (0: the part is absent)."""

    name: str
    pattern: str
    y: int = 0
    m: int = 0
    d: int = 0
    clock: int = 0
    half: int = 0
    zone: int = 0
    epoch: int = 0


NOTATIONS = (
    Notation("mail", rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{{1,2}}) ((?i:{MONTH})) (\d{{4}}) {CLOCK}{ZONE}", 3, 2, 1, 4, 0, 5),
    Notation("iso", rf"(?<!\d)(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{CLOCK}{ZONE}", 1, 2, 3, 4, 0, 5),
    Notation("basic", rf"(?<!\d)(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{6}}|\d{{4}})(?:\.\d+)?{ZONE}", 1, 2, 3, 4, 0, 5),
    Notation("slash_time", rf"(?<!\d)(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}) {CLOCK}{ZONE}", 1, 2, 3, 4, 0, 5),
    Notation("cn_time", rf"(?<!\d)(\d{{4}})\s?年\s?(\d{{1,2}})\s?月\s?(\d{{1,2}})\s?日\s?(上午|下午|晚上|凌晨|中午)?\s?{CLOCK}{ZONE}", 1, 2, 3, 5, 4, 6),
    Notation("day_month_time", rf"(?<!\d)(\d{{1,2}}) ((?i:{MONTH}))\.?,? (\d{{4}}),? {CLOCK}(?: ?([AP]M))?{ZONE}", 3, 2, 1, 4, 5, 6),
    Notation("month_day_time", rf"((?i:{MONTH}))\.? (\d{{1,2}}), ?(\d{{4}}),? {CLOCK}(?: ?([AP]M))?{ZONE}", 3, 1, 2, 4, 5, 6),
    Notation("numeric_time", rf"(?<!\d)(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {CLOCK}(?: ?([AP]M))?{ZONE}", 3, 1, 2, 4, 5, 6),
    Notation("day_month", rf"(?<!\d)(\d{{1,2}}) ((?i:{MONTH}))\.?,? (\d{{4}})(?!\d)", 3, 2, 1),
    Notation("month_day", rf"((?i:{MONTH}))\.? (\d{{1,2}}), ?(\d{{4}})(?!\d)", 3, 1, 2),
    Notation("month_year", rf"(?<![A-Za-z])((?i:{MONTH}))\.?,? ?(\d{{4}})(?!\d)", 2, 1),
    Notation("epoch", r"(?<!\d)(\d{12,13}|\d{9,10})(?!\d)", epoch=1),
    Notation("cn_day", r"(?<!\d)(\d{4})\s?年\s?(\d{1,2})\s?月\s?(\d{1,2})\s?日", 1, 2, 3),
    Notation("cn_month", r"(?<!\d)(\d{4})\s?年\s?(\d{1,2})\s?月", 1, 2),
    Notation("han", rf"([{CN_DIGITS}]{{4}})年([一二三四五六七八九十]{{1,2}})月(?:([一二三四五六七八九十]{{1,3}})日)?", 1, 2, 3),
    Notation("ymd", r"(?<!\d)(\d{4})([./-])(\d{1,2})\2(\d{1,2})(?!\d)", 1, 3, 4),
    Notation("numeric", r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", 3, 1, 2),
    Notation("slash_month", r"(?<!\d)(\d{1,2})/(\d{4})(?!\d)", 2, 1),
    Notation("ym", r"(?<!\d)(\d{4})[./-](\d{1,2})(?!\d)", 1, 2),
    Notation("compact_day", r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])([0-3]\d)(?!\d)", 1, 2, 3),
    Notation("compact_month", r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(?!\d)", 1, 2),
)


def _alternation() -> str:
    """All notations in one pattern; capturing groups become plain ones (the one back reference keeps its group)."""
    parts = []
    for n in NOTATIONS:
        if n.name == "ymd":
            parts.append(r"(?<!\d)\d{4}([./-])\d{1,2}\1\d{1,2}(?!\d)")
            continue
        out, i, p = [], 0, n.pattern
        while i < len(p):
            if p[i] == "\\":
                out.append(p[i : i + 2])
                i += 2
                continue
            out.append("(?:" if p[i] == "(" and p[i + 1] != "?" else p[i])
            i += 1
        parts.append("".join(out))
    return "|".join(parts)


DATE = _alternation()


def widen(line: Column) -> Column:
    """Full-width digits and signs as their ASCII forms."""
    return F.translate(line, "０１２３４５６７８９．／－：　", "0123456789./-: ")


def _han_number(s: Column) -> Column:
    digits = F.translate(s, CN_DIGITS, "00123456789")
    tens, ones = F.substring_index(digits, "十", 1), F.substring_index(digits, "十", -1)
    return F.when(s.contains("十"), (
        F.coalesce(F.nullif(tens, F.lit("")).try_cast("int"), F.lit(1)) * 10 + F.coalesce(F.nullif(ones, F.lit("")).try_cast("int"), F.lit(0)))
    ).otherwise(digits.try_cast("int"))


def _month(s: Column) -> Column:
    named = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(s, 1, 3))) + 2) / 3
    return F.when(s.rlike("^[A-Za-z]"), named.cast("int")).when(s.rlike("[一二三四五六七八九十]"), _han_number(s)).otherwise(s.try_cast("int"))


def parts_of(token: Column) -> Column:
    """Struct of year, month, day, h, mi, s, zone and epoch seconds of a token; null for no date."""

    def group(n: Notation, k: int) -> Column:
        return F.nullif(F.regexp_extract(token, f"^(?:{n.pattern})$", k), F.lit("")) if k else F.lit(None).cast("string")

    def build(n: Notation) -> Column:
        y, m, d, clock, half, zone, epoch = (group(n, k) for k in (n.y, n.m, n.d, n.clock, n.half, n.zone, n.epoch))
        if n.name == "han":
            y = F.translate(y, CN_DIGITS, "00123456789")
        month, day = _month(m), (_han_number(d) if n.name == "han" else d.try_cast("int"))
        if n.name.startswith("numeric"):  # day or month first: only the reading with a real month counts
            month, day = F.when(month > 12, day).otherwise(month), F.when(month > 12, month).otherwise(day)
        if n.name == "basic":
            h, mi, s = F.substring(clock, 1, 2), F.substring(clock, 3, 2), F.nullif(F.substring(clock, 5, 2), F.lit(""))
        else:
            h, mi, s = (F.try_element_at(F.split(clock, "[:.,]"), F.lit(i)) for i in (1, 2, 3))
        hour = h.try_cast("int")
        if n.half:
            pm = half.isin("下午", "晚上", "PM")
            hour = F.when(pm & (hour < 12), hour + 12).when(half.isin("AM", "上午", "凌晨") & (hour == 12), F.lit(0)).otherwise(hour)
        seconds = F.when(F.length(epoch) >= 12, F.expr("0") + (epoch.try_cast("bigint") / 1000)).otherwise(epoch.try_cast("bigint"))
        return F.struct(
            y.try_cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"), hour.cast("int").alias("h"),
            mi.try_cast("int").alias("mi"), s.try_cast("int").alias("s"), zone.alias("zone"), F.floor(seconds).cast("bigint").alias("epoch"),
        )

    first, *rest = NOTATIONS
    chain = F.when(token.rlike(f"^(?:{first.pattern})$"), build(first))
    return reduce(lambda c, n: c.when(token.rlike(f"^(?:{n.pattern})$"), build(n)), rest, chain)


def zone_id(zone: Column) -> Column:
    """A written zone as an offset or region that the JVM knows."""
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    sign, hour, minute = (F.regexp_extract(zone, r"^(?:UTC|GMT)?([+-])(\d{1,2}?):?(\d{2})?$", k) for k in (1, 2, 3))
    return (
        F.when(zone == "Z", F.lit("+00:00"))
        .when(zone.rlike(r"^(?:UTC|GMT)?[+-]\d"), F.concat(sign, F.lpad(hour, 2, "0"), F.lit(":"), F.coalesce(F.nullif(minute, F.lit("")), F.lit("00"))))
        .when(zone.contains("/"), zone)
        .otherwise(F.try_element_at(known, zone))
    )


def _instant(p: str, zone: str) -> Column:
    """Epoch seconds of a local time in a zone: of a time that occurs twice the first, a skipped one moves on by the skip."""
    made = F.expr(f"unix_seconds(try_make_timestamp({p}.y, {p}.m, {p}.d, {p}.h, {p}.mi, coalesce({p}.s, 0), {zone}))")
    return F.coalesce(F.col(f"{p}.epoch"), made)


def _seconds(df: DataFrame, name: str) -> Column:
    """Epoch seconds of a stored time; one without zone is in UTC."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_seconds(F.col(name).cast("timestamp"))


def date_tokens(df: DataFrame, fields: list[str], keep: list[str], only: str | None = None) -> DataFrame:
    """One row per date in the lines of array columns; with ``only``, of the lines that match this pattern.

    Columns: ``field_name``, ``keep``..., ``line_no`` (int, from 0), ``bound_no`` (int, from 1), ``p``
    (parts), ``n_bounds``, ``open_end``. Null arrays, null lines and lines without a date give no rows.
    """
    lines = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("lines")) for f in fields])
    exploded = (
        df.select(*keep, F.explode(lines).alias("_f"))
        .select(*keep, F.col("_f.field_name").alias("field_name"), F.posexplode("_f.lines").alias("line_no", "_line"))
        .where(F.col("_line").rlike("[0-9０-９]{4}|年") & (F.col("_line").rlike(only) if only else F.lit(True)))
        .withColumn("_line", widen(F.col("_line")))
        .withColumn("_tokens", F.regexp_extract_all("_line", F.lit(DATE), F.lit(0)))
        .where(F.size("_tokens") > 0)
    )
    open_end = F.regexp_replace("_line", DATE, "@").rlike("@[^@]*(?:" + OPEN_END.removeprefix("(?i)") + ")") | F.lower("_line").rlike(r"@?\b(?:present|current|now)\b")
    return (
        exploded.select(*keep, "field_name", F.col("line_no").cast("int").alias("line_no"), F.size("_tokens").alias("n_bounds"),
                        open_end.alias("open_end"), F.posexplode(F.transform("_tokens", parts_of)).alias("_k", "p"))  # below the generator, so that it is evaluated once
        .where(_valid(F.col("p")))
        .select(*keep, "field_name", "line_no", (F.col("_k") + 1).cast("int").alias("bound_no"), "n_bounds", "open_end", "p")
    )


def _valid(p: Column) -> Column:
    epoch = p["epoch"].between(-315619200, 4102444800)
    return epoch | (p["y"].between(1900, 2100) & p["m"].between(1, 12) & (p["d"].isNull() | p["d"].between(1, 31)))


#: Candidate offset histories for times without zone; the first is the declared one.
CANDIDATE_ZONES = ("Asia/Shanghai", "UTC", "Europe/London", "America/New_York", "America/Los_Angeles", "Asia/Tokyo", "Asia/Kolkata")


#: What a line with a time of day holds; other lines say nothing about zones.
HAS_TIME = "[0-9０-９][:：][0-9０-９]|T[0-9０-９]{4}"


def _violations(tokens: DataFrame, line_key: list[str], ingested_at: str, candidates: tuple[str, ...]) -> DataFrame:
    """Per line with a time without zone: ``line_key``..., ``v``, an array with 1 where the candidate violates an order.

    A violation is a start after its end within a line, or an event after ``ingested_at``.
    """
    p, local = F.col("p"), "p.zone IS NULL AND p.h IS NOT NULL"
    per = F.array(*[
        F.when(F.expr("p.h IS NOT NULL OR p.epoch IS NOT NULL"),
               _instant("p", f"coalesce(_zone, '{z}')")).alias(z) for z in candidates
    ])
    lines = (
        tokens.withColumn("_zone", zone_id(p["zone"])).withColumn("_at", per)
        .groupBy(*line_key).agg(
            F.max(F.when(F.col("bound_no") == 1, F.col("_at"))).alias("a"), F.max(F.when(F.col("bound_no") == 2, F.col("_at"))).alias("b"),
            F.max(F.expr(local)).alias("_local"), F.max(_seconds(tokens, ingested_at)).alias("_in"))
        .where("_local")
    )
    broken = lambda i: F.when((F.col("a")[i] > F.col("b")[i]) | (F.greatest(F.col("a")[i], F.col("b")[i]) > F.col("_in")), 1).otherwise(0)
    return lines.select(*line_key, F.array(*[broken(i) for i in range(len(candidates))]).alias("v"))


def _better(declared: Column, other: Column) -> Column:
    """Whether ``other`` has fewer violations by more than three standard deviations of the difference."""
    return declared - other > 3 * F.sqrt(declared + other)


def estimate_zone(tokens: DataFrame, line_key: list[str], ingested_at: str, candidates: tuple[str, ...] = CANDIDATE_ZONES) -> tuple[str, dict[str, int]]:
    """The candidate history with the fewest violations in the whole table, and the violations of each.

    The declared (first) candidate is kept unless another one is clearly better, so that a tie or an
    empty table gives the declared zone. One aggregation, one row to the driver.
    """
    sums = [F.coalesce(F.sum(F.col("v")[i]), F.lit(0)).alias(f"v{i}") for i in range(len(candidates))]
    row = _violations(tokens, line_key, ingested_at, candidates).agg(*sums).first()
    counts = {z: int(row[i]) for i, z in enumerate(candidates)}
    best = min(candidates, key=lambda z: (counts[z], candidates.index(z)))
    gain = counts[candidates[0]] - counts[best]
    return (best if gain > 3 * (counts[candidates[0]] + counts[best]) ** 0.5 else candidates[0]), counts


def estimate_zones(tokens: DataFrame, group: str, line_key: list[str], ingested_at: str, candidates: tuple[str, ...] = CANDIDATE_ZONES) -> DataFrame:
    """(group, zone) of the groups whose times without zone follow another history than the declared (first) one.

    Each group is judged by its own lines alone, with the same rule as a table; a group with a third of all rows is
    aggregated partially in every task. A null group keeps the declared zone.
    """
    lines = _violations(tokens, [group, *[k for k in line_key if k != group]], ingested_at, candidates).where(F.col(group).isNotNull())
    counts = lines.groupBy(group).agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(len(candidates))])
    least = F.array_min(F.array(*[F.struct(F.col(f"v{i}").alias("n"), F.lit(i).alias("i")) for i in range(len(candidates))]))
    chosen = counts.select(group, "v0", least.alias("best")).where((F.col("best.i") > 0) & _better(F.col("v0"), F.col("best.n")))
    return chosen.select(group, F.element_at(F.array(*[F.lit(z) for z in candidates]), F.col("best.i") + 1).alias("zone"))


def with_zone(df: DataFrame, fields: list[str], key: str, ingested_at: str, group: str, candidates: tuple[str, ...] = CANDIDATE_ZONES) -> DataFrame:
    """Add ``_home``, the zone of the record's times without zone, estimated per ``group``.

    Only lines with a time of day are looked at. The groups that leave the declared zone are few or none; their table is
    written once, and joined by broadcast if it measures small.
    """
    tokens = date_tokens(df, fields, list(dict.fromkeys([key, group, ingested_at])), HAS_TIME)
    chosen = durable(estimate_zones(tokens, group, ["field_name", key, "line_no"], ingested_at, candidates))
    n = chosen.count()
    if not n:
        return df.withColumn("_home", F.lit(candidates[0]))
    other = chosen.select(F.col(group).alias("_group"), F.col("zone").alias("_home"))
    joined = df.join(F.broadcast(other) if small_enough_to_broadcast(n, 128) else other, F.col(group) == F.col("_group"), "left").drop("_group")
    return joined.withColumn("_home", F.coalesce("_home", F.lit(candidates[0])))


def normalise(tokens: DataFrame, zone: str = CANDIDATE_ZONES[0]) -> DataFrame:
    """Add ``norm_value`` (the precision written is kept; times in UTC) and ``month`` (ordinal year*12+month, local to ``zone``).

    A column ``_home`` gives the zone of times without zone; without it, that is ``zone``, too.
    """
    p = F.col("p")
    home = "_home" if "_home" in tokens.columns else f"'{zone}'"
    at = F.when(p["h"].isNotNull() | p["epoch"].isNotNull(), _instant("p", f"coalesce(_zone, {home})"))
    utc = F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, _at) as string)")
    local = F.expr(f"cast(convert_timezone('UTC', '{zone}', timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, _at)) as string)")
    day = F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])
    return (
        tokens.withColumn("_zone", zone_id(p["zone"])).withColumn("_at", at)
        .withColumn("norm_value", F.when(F.col("_at").isNotNull(), F.concat(F.translate(F.substring(utc, 1, 19), " ", "T"), F.lit("Z")))
                    .when(p["d"].isNotNull(), day).otherwise(F.format_string("%04d-%02d", p["y"], p["m"])))
        .withColumn("month", F.when(F.col("_at").isNotNull(), F.substring(local, 1, 4).cast("int") * 12 + F.substring(local, 6, 2).cast("int"))
                    .otherwise(p["y"] * 12 + p["m"]))
        .drop("_zone", "_at")
    )


def normalised_dates(df: DataFrame, fields: list[str], key: str = "doc_id", ingested_at: str = "parsed_at", zone: str | None = None, group: str | None = None) -> DataFrame:
    """Distinct (field_name, key, line_no, bound_no, norm_value) of all dates; the zone is estimated unless given, per ``group`` if that is given."""
    if zone is None and group is not None:
        tokens = date_tokens(with_zone(df, fields, key, ingested_at, group), fields, [key, "_home"])
        return normalise(tokens).select("field_name", key, "line_no", "bound_no", "norm_value").distinct()
    keep = [key] if zone else [key, ingested_at]
    tokens = date_tokens(df, fields, keep)
    if zone is None:
        zone, _ = estimate_zone(tokens, ["field_name", key, "line_no"], ingested_at)
    return normalise(tokens, zone).select("field_name", key, "line_no", "bound_no", "norm_value").distinct()
