"""String functions on station and place names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place-name tokens and what they stand for; legal designators at the end of a place name.
PLACE_ALIAS = {"ST": "SAINT", "MT": "MOUNT", "FT": "FORT", "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST"}
LEGAL = ("CITY", "TOWN", "VILLAGE", "BOROUGH", "CDP", "MUNICIPALITY", "GOVERNMENT", "COUNTY", "CORPORATION", "BALANCE")
#: Chain names by phrase.
CHAINS = {
    "pilot": "PILOT", "pilot travel center": "PILOT", "flying j": "FLYING J", "flying j travel center": "FLYING J", "loves": "LOVES",
    "loves travel stop": "LOVES", "ta": "TA", "ta travel center": "TA", "ta petro": "TA", "travelcenters of america": "TA", "petro": "PETRO",
    "petro travel center": "PETRO", "sapp bros": "SAPP BROS", "roadys": "ROADYS",
}
#: Marks of mis-decoded names, alternative fuels, closed states.
MOJIBAKE = ("�", "Ã¢â‚¬", "Ã©", "Ã±", "Ã¢€™")
ALT_FUELS = ("cng", "lng", "hydrogen", "h2", "supercharger", "chargepoint", "evgo", "blink", "alternative energy", "ev charging", "electrify america")
CLOSED = ("permanently_closed", "temporarily_closed")


def place_key(name: Column) -> Column:
    """Upper case, words only, aliases replaced, legal designators dropped from the end."""
    words = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^\\p{L}\\p{N}_\\s]", " ")
    table = F.create_map(*[F.lit(x) for pair in PLACE_ALIAS.items() for x in pair])
    swapped = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(words, "\\s+", " ")), " "), lambda t: F.coalesce(table[t], t)), " ")
    legal = "|".join(LEGAL)
    return F.regexp_replace(swapped, f"(^| )({legal})( ({legal}))*$", "")


def padded_tokens(name: Column) -> Column:
    """Lower-case tokens between single blanks, a blank at both ends, so that `contains(' x y ')` matches whole tokens."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’]", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), F.lit(" "))


def chain_of(name: Column) -> Column:
    """The chain whose phrase stands in the name as whole tokens; of several the one with most tokens."""
    text = padded_tokens(name)
    found = F.lit(None).cast("string")
    for phrase in sorted(CHAINS, key=lambda p: len(p.split())):
        found = F.when(text.contains(f" {phrase} "), CHAINS[phrase]).otherwise(found)
    return found


def is_alt_fuel(name: Column) -> Column:
    text = padded_tokens(F.regexp_replace(name, "['’]", " "))
    return F.coalesce(_any(text.contains(f" {p} ") for p in ALT_FUELS), F.lit(False))


def has_mojibake(name: Column) -> Column:
    return F.coalesce(_any(name.contains(m) for m in MOJIBAKE), F.lit(False))


def is_closed(status: Column) -> Column:
    """Null and blank mean unknown, not closed."""
    return F.coalesce(F.lower(F.trim(status)).isin(*CLOSED), F.lit(False))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def duration(seconds: Column) -> Column:
    """``2h 5m`` or ``45m``."""
    minutes = F.floor((seconds + 30) / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60)).otherwise(F.format_string("%dm", minutes))


def grouped(value: Column, places: int) -> Column:
    """A decimal with thousands separators."""
    return F.format_number(value, places)


def station_note(total: Column, recorded: Column, estimates: Column) -> Column:
    """What a data set consists of; the parts are told only where they add up, and nothing of nothing."""
    stations = F.concat(F.format_number(total, 0), F.when(total == 1, " station").otherwise(" stations"))
    parts = F.concat(stations, F.lit(" — "), F.format_number(recorded, 0), F.lit(" recorded, "), F.format_number(estimates, 0), F.when(estimates == 1, " regional estimate.").otherwise(" regional estimates."))
    whole = F.concat(stations, F.lit(" — all with recorded prices."))
    return F.when(total == 0, "").when(recorded == total, whole).when(recorded + estimates == total, parts).otherwise(F.concat(stations, F.lit(".")))


def freshness_note(state: Column, week: Column, snapshot: str | None = None) -> Column:
    """What week prices are indexed to; for a frozen table or an unknown week the sentence about the dated snapshot, if there is one."""
    note = F.concat(F.lit("Station prices indexed to the EIA week of "), F.date_format(week, "MMM d, yyyy"))
    return F.when(week.isNotNull() & (state == "stale"), F.concat(note, F.lit(" (latest available)."))).when(week.isNotNull() & (state == "current"), F.concat(note, F.lit("."))).otherwise(F.lit(snapshot))


def csv_field(s: Column) -> Column:
    """A CSV field, quoted if it holds a comma, a quote or a line end."""
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
