"""Column expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import schema as S


def season_start(day: Column) -> Column:
    """A season runs from July to June."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def season_label(day: Column) -> Column:
    y = season_start(day)
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_code(label: Column) -> Column:
    """2018/19 as 1819."""
    return F.concat(F.substring(label, 3, 2), F.substring(label, 6, 2))


def season_span(label: Column) -> Column:
    """2026/27 as 2026-2027."""
    y = F.substring(label, 1, 4).cast("int")
    return F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))


def season_dash(label: Column) -> Column:
    """2024/25 as 2024-25."""
    return F.translate(label, "/", "-")


def outcome(home: Column, away: Column) -> Column:
    """1 home, 2 draw, 3 away; null without both scores."""
    return F.when(home > away, 1).when(away > home, 3).when(home == away, 2)


def outcome_from_letter(letter: Column, home: Column, away: Column) -> Column:
    mark = F.upper(F.trim(letter))
    return F.coalesce(F.when(mark == "H", 1).when(mark == "D", 2).when(mark == "A", 3), outcome(home, away))


def match_key(day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), home, away)


def status_group(status: Column) -> Column:
    s = F.upper(F.trim(status))
    return F.when(s.isin(*S.FINISHED), "finished").when(s.isin(*S.IN_PLAY), "in_play").when(s.isin(*S.OFF), "off").otherwise("scheduled")


def progress(group: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in S.PROGRESS.items():
        out = F.when(group == name, rank).otherwise(out)
    return out


def trust(source: Column, table: dict[str, int] = S.SOURCE_PRIORITY) -> Column:
    out = F.lit(S.UNKNOWN_PRIORITY)
    for name, rank in table.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def likeliest(home: Column, draw: Column, away: Column) -> Column:
    """The outcome with the largest probability; of equals home comes before draw before away. Null if any is missing."""
    some = home.isNotNull() & draw.isNotNull() & away.isNotNull()
    return F.when(some, F.when((home >= draw) & (home >= away), 1).when(draw >= away, 2).otherwise(3))


def of_outcome(code: Column, home: Column, draw: Column, away: Column) -> Column:
    return F.when(code == 1, home).when(code == 2, draw).when(code == 3, away)


def top_probability(home: Column, draw: Column, away: Column) -> Column:
    """greatest() skips nulls; here any missing probability makes it null."""
    return F.when(home.isNotNull() & draw.isNotNull() & away.isNotNull(), F.greatest(home, draw, away))


def log_loss(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(0.999)))


def devig(home: Column, draw: Column, away: Column) -> Column:
    """Shares of the implied probabilities of three odds; null unless all are there and their total is positive."""
    implied = [F.when(o > 0, 1 / o).otherwise(F.when(o.isNotNull(), F.lit(0.0))) for o in (home, draw, away)]
    total = implied[0] + implied[1] + implied[2]
    return F.when(total > 0, F.struct(*((x / total).alias(n) for x, n in zip(implied, ("home", "draw", "away")))))


def blend(model: list[Column], market: list[Column], weight: float = 0.45) -> list[Column]:
    """Model and market probabilities mixed and made to sum to 1; the model alone where there's no market."""
    w = min(1.0, max(0.0, weight))
    mixed = [F.when(k.isNull(), m).otherwise(w * m + (1 - w) * k) for m, k in zip(model, market)]
    total = mixed[0] + mixed[1] + mixed[2]
    return [F.try_divide(x, total) for x in mixed]


def perm_advice(home: Column, draw: Column, away: Column, manual: Column | None = None) -> Column:
    """(pick, perm, covered): the pick alone, or two outcomes where the draw is likely or nothing is; a drawn pick is
    joined by the likelier side. manual: a choice by hand of one or two outcomes, which goes before the rule unless it is null; the
    pick stays."""
    pick = likeliest(home, draw, away)
    permed = (draw >= S.PERM_DRAW) | (F.greatest(home, draw, away) < S.PERM_TOP)
    if manual is not None:
        permed = F.coalesce(manual, permed)
    side = F.when(home >= away, 1).otherwise(3)
    other = F.when(pick == 2, side).otherwise(2)
    covered = of_outcome(pick, home, draw, away) + F.when(permed, of_outcome(other, home, draw, away)).otherwise(0.0)
    return F.when(pick.isNotNull(), F.struct(pick.alias("pick"), permed.alias("perm"), F.when(permed, other).alias("other"), covered.alias("covered")))


def result_letter(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, "W").when(scored == conceded, "D").when(scored < conceded, "L")


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / S.ELO["scale"]))


def elo_margin(goals: Column) -> Column:
    g = F.abs(goals)
    return F.when(g <= 1, 1.0).when(g == 2, 1.5).otherwise((11 + g) / 8)


def pi_expected(rating: Column) -> Column:
    return F.signum(rating) * (F.pow(F.lit(10.0), F.abs(rating) / S.PI["c"]) - 1)


def minute(raw: Column) -> Column:
    """90+5 as 90; anything else that is no number, such as HT, as null."""
    return F.regexp_replace(F.split(raw, r"\+")[0], "'$", "").try_cast("int")


def local_day(instant: Column, zone: str = "Africa/Johannesburg") -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


#: Latin letters with marks, and those that they are without.
_MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśşšșťţțùúûüūůűųýÿžźż"
_BARE = "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorrsssstttuuuuuuuuyyzzz"


def folded(text: Column) -> Column:
    """Lower case, without marks: those of composed Latin letters, and all that stand as characters of their own."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), _MARKED, _BARE)


def has_all_words(text: Column, query: Column) -> Column:
    """Every word of the query is somewhere in the text, without regard to case and accents."""
    words = F.filter(F.split(folded(query), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(folded(text), w))


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def hue(name: Column) -> Column:
    """A colour from a 31-hash of the name's characters, in 32 bits, made positive, modulo 360."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + c))) % 360


def ago(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def stale_label(hours: Column) -> Column:
    """How old a row is: in minutes below an hour, in hours below two days, then in days; unknown where that isn't known."""
    unit = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(f"{u} ago"))
    return F.when(hours.isNull(), "unknown").when(hours < 1, unit(hours * 60, "m")).when(hours < 48, unit(hours, "h")).otherwise(unit(hours / 24, "d"))


def insight(reply: Column) -> Column:
    """A language model's reply as a struct: the JSON object in it, with or without fences and words around it; factors at most
    six, rationales of the three known tiers in their order, texts trimmed. Null where there is no object."""
    bare = F.trim(F.regexp_replace(reply, r"(?i)```(?:json)?", ""))
    kind = "summary string, key_factors array<string>, tier_rationales array<struct<tier: string, rationale: string>>, model_commentary string, confidence_notes string"
    raw = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), kind)
    text = lambda c, other="": F.when(F.trim(c) != "", F.trim(c)).otherwise(F.lit(other))
    tiers = F.coalesce(raw["tier_rationales"], F.array().cast("array<struct<tier: string, rationale: string>>"))
    said = lambda t: F.element_at(F.filter(tiers, lambda x: F.lower(F.trim(x["tier"])) == t), -1)["rationale"]
    last = lambda t: F.when(F.exists(tiers, lambda x: F.lower(F.trim(x["tier"])) == t), text(said(t))).otherwise("")
    factors = F.filter(F.coalesce(raw["key_factors"], F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.when(
        F.regexp_like(bare, F.lit(r"(?s)\{.*\}")),
        F.struct(text(raw["summary"], "No summary produced.").alias("summary"), F.slice(factors, 1, 6).alias("key_factors"), *(last(t).alias(t) for t in ("low", "medium", "high")), text(raw["model_commentary"]).alias("model_commentary"), text(raw["confidence_notes"]).alias("confidence_notes")),
    )
